"""Trades as columns and joins: fills, sizes, exit resolution, compounding, stress and leverage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import pathsearch
from tidemark.operators.asof import asof
from tidemark.operators.pieces import numbered
from tidemark.operators.selection import non_overlapping
from tidemark.scratch import discard, root

#: Most trades of a run that a task folds, and what a fold hands on.
FOLD_PIECE = 1 << 19
STATE = pa.struct([("equity", pa.float64()), ("peak", pa.float64()), ("last", pa.list_(pa.float64()))])


def checked_side(side: Column) -> Column:
    """+1 for LONG, -1 for SHORT; any other side raises."""
    return F.when(side == "LONG", 1.0).when(side == "SHORT", -1.0).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("null")))).cast("double"))


def fill_price(price: Column, side: Column, slippage: float, entry: bool) -> Column:
    """An entry pays the slippage in the direction of its side, an exit against it."""
    sign = checked_side(side)
    return price * (1 + sign * slippage * (1 if entry else -1))


def costs(rows: DataFrame, fee: float, slippage: float) -> DataFrame:
    """entry_fill, exit_fill, fees, slippage_cost, gross_pnl and net_pnl of rows(side, entry_price, exit_price, quantity)."""
    side = F.col("side")
    rows = rows.withColumn("entry_fill", fill_price(F.col("entry_price"), side, slippage, True)).withColumn("exit_fill", fill_price(F.col("exit_price"), side, slippage, False))
    q = F.col("quantity")
    rows = rows.withColumn("fees", (F.col("entry_fill") + F.col("exit_fill")) * q * fee)
    rows = rows.withColumn("slippage_cost", (F.abs(F.col("entry_fill") - F.col("entry_price")) + F.abs(F.col("exit_fill") - F.col("exit_price"))) * q)
    rows = rows.withColumn("gross_pnl", (F.col("exit_fill") - F.col("entry_fill")) * q * checked_side(side))
    return rows.withColumn("net_pnl", F.col("gross_pnl") - F.col("fees"))


def exposure(mode: str, entry: Column, stop: Column | None = None, leverage: float = 1.0, risk: float = 0.01) -> Column:
    """Notional per unit of equity: fixed leverage, or fixed risk over the stop distance capped by the leverage; 0 if
    the stop is invalid."""
    if mode == "fixed":
        return F.lit(float(leverage))
    distance = F.abs(entry - stop) / F.nullif(entry, F.lit(0.0))
    return F.when(distance > 0, F.least(risk / distance, F.lit(float(leverage)))).otherwise(0.0)


def stop_level(entry: Column, atr: Column, k: float, cap: float = 0.014) -> Column:
    return entry - F.least(k * atr, cap * entry)


def resolve_exits(events: DataFrame, bars: DataFrame, exit_flag: str, stop: str, ts: str = "bar_ts") -> DataFrame:
    """For long events(symbol, event_id, entry_time, entry_price, stop): the first bar whose low reaches the stop, before the first
    bar after the entry on which exit_flag holds, else that bar's close, else the last bar: exit_time, exit_price,
    exit_reason, path_high and path_low to the exit. Exits do not depend on other trades, so each is a search of its own
    through the bars' block extremes."""
    columns = [F.col(f"`{c}`") for c in events.columns]
    index = pathsearch.build(bars, exit_flag, ts)
    rows = pathsearch.first_touch(events, index, "entry_time", None, stop)
    stopped = F.coalesce(F.col("found.low") <= F.col(stop), F.lit(False))
    return rows.join(index.last(), "symbol", "left").select(
        *columns,
        F.coalesce("found.ts", "last_time").alias("exit_time"),
        F.when(stopped, F.col(stop)).otherwise(F.coalesce("found.close", "last_close")).alias("exit_price"),
        F.when(stopped, "stop").when(F.col("found.flag"), "signal").otherwise("end_of_data").alias("exit_reason"),
        "path_high",
        "path_low",
    )


def resolve_liquidations(events: DataFrame, bars: DataFrame, exit_flag: str, stop: str, leverage: float, maintenance: float = 0.005) -> DataFrame:
    """resolve_exits() of leveraged longs: the trigger is the higher of stop and liquidation price, and a bar that reaches
    the latter liquidates at it, whether it reaches the stop too or not."""
    rows = events.withColumn("__liq", liquidation_price(F.col("entry_price"), leverage, F.lit("LONG"), maintenance)).withColumn("trigger", F.greatest(F.col(stop), F.col("__liq")))
    rows = resolve_exits(rows, bars, exit_flag, "trigger")
    # the path's low up to the exit is the exit bar's own where a trigger ended it
    gone = (F.col("exit_reason") == "stop") & (F.col("path_low") <= F.col("__liq"))
    price = F.when(gone, F.col("__liq")).when(F.col("exit_reason") == "stop", F.col(stop)).otherwise(F.col("exit_price"))
    return rows.withColumn("exit_price", price).withColumn("exit_reason", F.when(gone, "liquidation").otherwise(F.col("exit_reason"))).drop("__liq")


def gate_downshift(leverage: Column, risky: Column, factor: float) -> Column:
    """The leverage, times factor where a gate finds a high risk."""
    return F.when(F.coalesce(risky, F.lit(False)), leverage * factor).otherwise(leverage)


def resolve_target_exits(events: DataFrame, bars: DataFrame, max_seconds: int, ts: str = "bar_ts") -> DataFrame:
    """Long events(symbol, event_id, entry_time, entry_price, target, stop): stop first on a bar that reaches both, else
    target, else the last close within max_seconds (time)."""
    columns = [F.col(f"`{c}`") for c in events.columns]
    rows = events.withColumn("__end", F.expr(f"timestampadd(SECOND, {max_seconds}, entry_time)"))
    rows = pathsearch.first_touch(rows, pathsearch.build(bars, ts=ts), "entry_time", "__end", "stop", "target")
    stopped, reached = F.col("found.low") <= F.col("stop"), F.col("found.high") >= F.col("target")
    return rows.select(
        *columns,
        F.col("found.ts").alias("exit_time"),
        F.when(stopped, F.col("stop")).when(reached, F.col("target")).otherwise(F.col("found.close")).alias("exit_price"),
        F.when(F.col("found").isNull(), "no_path").when(stopped, "stop").when(reached, "target").otherwise("time").alias("exit_reason"),
    )


def compound(trades: DataFrame, keys: list[str], order: list[str], ret: str, start: float) -> DataFrame:
    """balance_before and balance_after of trades that reinvest: a cumulative product, 0 from a loss of all on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wiped = F.max((F.col(ret) <= -1).cast("int")).over(w) == 1
    growth = F.sum(F.when(F.col(ret) > -1, F.log1p(F.col(ret))).otherwise(0.0)).over(w)
    rows = trades.withColumn("balance_after", F.when(wiped, 0.0).otherwise(start * F.exp(growth)))
    before = F.coalesce(F.lag("balance_after").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(float(start)))
    return rows.withColumn("balance_before", before)


def backtest(events: DataFrame, keys: list[str], ret: str, start: float, tie: str = "event_id") -> DataFrame:
    """The non-overlapping trades of each run, compounded."""
    kept = non_overlapping(events, keys, "entry_time", "exit_time", tie)
    return compound(kept, keys, ["entry_time", tie], ret, start)


def conversion_status(events: DataFrame, kept: DataFrame, ident: str = "event_id") -> DataFrame:
    """Why each event became a trade or not."""
    rows = events.join(kept.select(ident, F.lit(True).alias("__kept")), ident, "left")
    status = F.when(F.col("entry_price").isNull(), "missing_execution").when(F.col("stop").isNull(), "invalid_atr").when(F.col("__kept"), "traded")
    return rows.withColumn("status", status.otherwise("ignored_due_to_position")).drop("__kept")


def liquidation_price(entry: Column, leverage: Column | float, side: Column, maintenance: float = 0.005) -> Column:
    x = leverage if isinstance(leverage, Column) else F.lit(float(leverage))
    return entry * (1 - checked_side(side) * (1 / x - maintenance))


def leverage_ladder(drawdown: Column, losses: Column, rank: Column, table: list[tuple[float, int, float, float]], default: float) -> Column:
    """The leverage of the first rule (most drawdown, most recent losses, most volatility rank, leverage) that holds."""
    out = F
    for dd, n, r, x in table:
        out = out.when((drawdown >= -dd) & (losses <= n) & (F.coalesce(rank, F.lit(1.0)) <= r), x)
    return out.otherwise(default)


def leveraged_fold(trades: DataFrame, keys: list[str], order: list[str], ret: str, modes: dict[str, list[float]], start: float, floor: float = 0.05, each: Callable[[DataFrame], DataFrame] | None = None, by: tuple[str, ...] = (), size: int = FOLD_PIECE) -> DataFrame:
    """Path-dependent leverage: each mode's [base, reduced after 2 losses of the last 3, reduced in a 20 % drawdown]; a
    trade that loses 1 / leverage or more liquidates to the floor of the balance. `each` may make several rows of a trade, told apart by
    the columns `by`, for runs of their own. The first column of order is a time or a number.

    Runs are folded piece by piece: a task gets at most `size` trades of a run, all runs' n-th pieces are folded at once, and their state
    (equity, peak, last three results) goes on to the next pieces, so that no task holds a run, however long."""
    spark, each = trades.sparkSession, each or (lambda rows: rows)
    run = [*keys, *by, "mode"]
    placed = numbered(trades, keys, order, "__i")
    top = placed.agg(F.max("__i").alias("i")).first().i
    pieces, folded = f"{root(spark)}/fold-{uuid.uuid4().hex}", f"{root(spark)}/folded-{uuid.uuid4().hex}"
    placed.withColumn("__piece", F.floor(F.col("__i") / size)).write.partitionBy("__piece").parquet(pieces)
    discard(placed)
    options = F.explode(F.array(*map(F.lit, modes)))
    shaped = lambda rows: each(rows).withColumn("mode", options)
    columns = each(placed.drop("__i")).columns
    kind = shaped(placed).select(*[F.col(f"`{c}`") for c in columns], "mode", *[F.lit(1.0).alias(c) for c in ("leverage", "equity_before", "equity_after")], F.lit(True).alias("liquidated"))
    state = F.expr("cast(null as struct<equity: double, peak: double, last: array<double>>)")
    schema, names = kind.withColumn("__state", state).schema, [*columns, "mode"]

    def fold(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("__i").to_numpy()))) if len(rows) else rows
        equity, peak, last = start, start, []
        if len(before):
            equity, peak, last = before.column("__state")[0].as_py().values()
        base, after_losses, in_drawdown = modes[rows.column("mode")[0].as_py()] if len(rows) else (0, 0, 0)
        out = []
        for r in rows.column(ret).to_pylist():
            x = in_drawdown if equity < 0.8 * peak else after_losses if sum(v <= 0 for v in last) >= 2 else base
            gone = r * x <= -(1 - floor)
            was, equity = equity, equity * (floor if gone else 1 + r * x)
            peak, last = max(peak, equity), [*last, r][-3:]
            out.append((x, was, equity, gone))
        cols = list(zip(*out, strict=True)) or [()] * 4
        more = [*(pa.array(c, pa.float64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())]
        states = pa.array([None] * (len(out) - 1) + [{"equity": equity, "peak": peak, "last": last}] * bool(out), STATE)
        return pa.Table.from_arrays([*(rows.column(c) for c in names), *more, states], schema.names)

    known = spark.createDataFrame([], T.StructType([f for f in schema if f.name in (*run, "__state")])).select(*run, "__state")
    for piece in range(-1 if top is None else int(top) // size + 1):
        rows = shaped(spark.read.schema(placed.schema).parquet(f"{pieces}/__piece={piece}"))
        found = rows.groupBy(*run).cogroup(known.groupBy(*run)).applyInArrow(fold, schema)
        found.write.parquet(f"{folded}/piece={piece}")
        known = spark.read.schema(schema).parquet(f"{folded}/piece={piece}").where("__state is not null").select(*run, "__state")
    if top is None:
        return spark.createDataFrame([], kind.schema)
    return spark.read.schema(schema).parquet(f"{folded}/piece=*").drop("__state")


#: Stress cases: name, entry drift, extra slippage, fee multiple, liquidation shift.
STRESS = [
    ("base", 0.0, 0.0, 1.0, 0.0),
    ("delay", 0.001, 0.0, 1.0, 0.0),
    ("slippage", 0.0, 0.0005, 1.0, 0.0),
    ("fees_x2", 0.0, 0.0, 2.0, 0.0),
    ("liquidation", 0.0, 0.0, 1.0, 0.001),
    ("all", 0.001, 0.0005, 2.0, 0.001),
]


def stress(trades: DataFrame, cases: list[tuple] = STRESS) -> DataFrame:
    """One row per trade and case: stressed return = ret - drift - 2 * slippage - (fee multiple - 1) * fee_rate."""
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(v)).alias(k) for k, v in zip(("drift", "slip", "fee_x", "liq_shift"), x, strict=True)]) for n, *x in cases])
    rows = trades.select("*", F.inline(options))
    return rows.withColumn("stressed_ret", F.col("ret") - F.col("drift") - 2 * F.col("slip") - (F.col("fee_x") - 1) * F.col("fee_rate"))


def cost_multiples(trades: DataFrame, multiples: list[float]) -> DataFrame:
    """One row per trade and multiple of costs: adjusted_pnl = net_pnl - (m - 1) * total_fee."""
    rows = trades.withColumn("multiple", F.explode(F.array(*map(F.lit, map(float, multiples)))))
    return rows.withColumn("adjusted_pnl", F.col("net_pnl") - (F.col("multiple") - 1) * F.col("total_fee"))


def partial_take_profit(trades: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """One row per trade and (target, fraction): if the path's high reached the target before the exit, that fraction
    was sold there: blended return of a long."""
    options = F.array(*[F.struct(F.lit(float(t)).alias("target_pct"), F.lit(float(f)).alias("fraction")) for t, f in grid])
    rows = trades.select("*", F.inline(options))
    touched = F.col("path_high") >= F.col("entry_price") * (1 + F.col("target_pct"))
    plain = F.col("exit_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1
    blended = F.col("fraction") * F.col("target_pct") + (1 - F.col("fraction")) * plain
    return rows.withColumn("touched", F.coalesce(touched, F.lit(False))).withColumn("blended_ret", F.when(F.coalesce(touched, F.lit(False)), blended).otherwise(plain))


def volatility_leverage(atr_pct: Column, steps: list[tuple[float, float]], default: float) -> Column:
    """Leverage by steps of volatility (upper edge, leverage)."""
    out = F
    for edge, x in steps:
        out = out.when(atr_pct <= edge, x)
    return out.otherwise(default)


def risk_parity_leverage(base: float, target: float, sigma: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(base * target / F.nullif(sigma, F.lit(0.0))).cast("double")))


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], pnl: str, start: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("equity", start + F.sum(pnl).over(w))


def mark_to_market(bars: DataFrame, trades: DataFrame, balance: float, ts: str = "bar_ts") -> DataFrame:
    """Balance plus unrealised result at each bar, for non-overlapping long trades(symbol, entry_time, exit_time,
    entry_price, quantity)."""
    rows = asof(bars, trades.withColumn("__e", F.col("entry_time")), ts, "__e", ["entry_time", "exit_time", "entry_price", "quantity"])
    held = F.coalesce(F.col(ts) <= F.col("exit_time"), F.lit(False))
    return rows.withColumn("in_trade", held).withColumn("marked", balance + F.when(held, (F.col("close") - F.col("entry_price")) * F.col("quantity")).otherwise(0.0))
