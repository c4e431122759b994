"""Compositions over several operators: confirmation entries, timing modes, pairs, monthly proxies, scenario grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, indicators, labels, ledger, metrics
from tidemark.operators.patterns import true


def confirmed_entries(events: DataFrame, fine: DataFrame, seconds: int, bucket_seconds: int, ts: str = "ts") -> DataFrame:
    """Per event(event_id, symbol, signal_time, signal_high): the first finer bar within `seconds` after the signal that closes above
    the signal's high, and the close then; nulls if none does. wait_s is the delay."""
    spans = events.withColumn("__a", F.expr("signal_time + interval 1 microsecond")).withColumn("__b", F.expr(f"timestampadd(SECOND, {seconds}, signal_time)"))
    path = asof.interval_join(spans, fine, "__a", "__b", ts, bucket_seconds, ["close"])
    hit = F.when(F.col("close") > F.col("signal_high"), F.struct("path_ts", "close"))
    found = path.groupBy("event_id").agg(F.min(hit).alias("x")).select("event_id", F.col("x.path_ts").alias("confirm_time"), F.col("x.close").alias("confirm_price"))
    out = events.join(found, "event_id", "left")
    return out.withColumn("wait_s", F.expr("timestampdiff(SECOND, signal_time, confirm_time)"))


def confirmation_cost(confirmed: DataFrame, entry: str, risk: str) -> DataFrame:
    """Per symbol: how many events were confirmed, the mean wait, and the mean price paid for waiting in units of risk."""
    paid = (F.col("confirm_price") - F.col(entry)) / F.nullif(F.col(risk), F.lit(0.0))
    return confirmed.groupBy("symbol").agg(F.count("*").alias("n"), F.count("confirm_time").alias("n_confirmed"), F.avg("wait_s").alias("mean_wait_s"), F.avg(paid).alias("mean_cost_r"))


def timing_modes(rows: DataFrame, state: str, delays: list[int], ts: str = "bar_ts") -> DataFrame:
    """Entries of each in-state segment at its first bar and at fixed delays while it lasts, and at one bar drawn by a hash."""
    inside = rows.where(F.col(state) == 1)
    seg = Window.partitionBy("symbol").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("segment", F.sum(F.col(f"{state}_first").cast("int")).over(seg))
    fixed = F.array_compact(F.array(*[F.when(F.col(f"{state}_age") == k, F.lit(f"delay_{k}")) for k in delays]))
    out = inside.withColumn("timing", F.explode(fixed))
    stamp = F.unix_timestamp(F.col(ts).cast("timestamp"))
    drawn = F.row_number().over(Window.partitionBy("symbol", "segment").orderBy(F.pmod(stamp * 48271, F.lit(2147483629)), ts))
    return out.unionByName(inside.withColumn("__r", drawn).where("__r = 1").drop("__r").withColumn("timing", F.lit("drawn")))


def pair_events(ratio: DataFrame, horizon: int, far: float = 1.5, touch: float = 0.005, ts: str = "bar_ts") -> DataFrame:
    """Relative-value events of a ratio series (symbol, ratio, z): side by the sign of z, the ratio's path over the horizon and
    whether it first rises or falls by `touch`."""
    rows = ratio.withColumns({c: F.col("ratio") for c in ("high", "low", "close")})
    rows = labels.forward_labels(rows, [horizon], ts=ts).withColumn("up", F.col("ratio") * (1 + touch)).withColumn("down", F.col("ratio") * (1 - touch))
    rows = rows.withColumn("touch", labels.first_touch("up", "down", horizon, ts=ts)).where(F.abs("z") >= far)
    return rows.withColumn("side", F.when(F.col("z") > 0, "SHORT").otherwise("LONG")).drop("high", "low", "close", "up", "down")


def holdout_symbols(available: DataFrame, discovery: DataFrame, n: int) -> DataFrame:
    """The first n symbols with data that discovery did not use (a selection)."""
    return available.select("symbol").distinct().join(discovery.select("symbol").distinct(), "symbol", "left_anti").orderBy("symbol").limit(n)


def warm_up(bars: DataFrame, lookbacks: list[int], span: int, ts: str = "bar_ts") -> DataFrame:
    """Per symbol and look-back: the exponential mean at the last bar when only that many bars are used, and its distance
    from the longest look-back's."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(ts)))
    rows = bars.select("symbol", ts, "close").withColumn("__back", back).where(F.col("__back") <= max(lookbacks))
    rows = rows.withColumn("lookback", F.explode(F.array(*map(F.lit, lookbacks)))).where("__back <= lookback")
    keyed = rows.select(F.concat_ws("|", "symbol", F.col("lookback").cast("string")).alias("symbol"), ts, "close")
    last = indicators.ema(keyed, {"mean": span}, ts=ts).groupBy("symbol").agg(F.max_by("mean", ts).alias("mean"))
    last = last.select(F.substring_index("symbol", "|", 1).alias("symbol"), F.substring_index("symbol", "|", -1).cast("int").alias("lookback"), "mean")
    longest = F.max_by("mean", "lookback").over(Window.partitionBy("symbol"))
    return last.withColumn("delta", F.col("mean") - longest)


def monthly_proxy(rows: DataFrame, state: str, ts: str = "bar_ts") -> DataFrame:
    """A strategy that enters at the next open when a state begins and leaves at the next open when it ends: the sum of returns
    and count per symbol and exit month, with negative and weak flags (under the symbol's lower quartile)."""
    w = Window.partitionBy("symbol").orderBy(ts)
    before = F.coalesce(F.lag(state).over(w), F.lit(0))
    rows = rows.withColumn("__on", (F.col(state) == 1) & (before == 0)).withColumn("__off", (F.col(state) == 0) & (before == 1))
    rows = rows.withColumn("__open", F.lead("open").over(w)).withColumn("__time", F.lead(ts).over(w))
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__entry", F.last(F.when(F.col("__on"), F.col("__open")), ignorenulls=True).over(run))
    done = rows.where("__off and __open is not null and __entry is not null")
    out = done.groupBy("symbol", F.date_format("__time", "yyyy-MM").alias("month")).agg(F.sum(F.col("__open") / F.nullif(F.col("__entry"), F.lit(0.0)) - 1).alias("ret"), F.count("*").alias("n"))
    quartile = F.percentile("ret", F.lit(0.25)).over(Window.partitionBy("symbol"))
    return out.withColumn("negative", F.col("ret") < 0).withColumn("weak", F.col("ret") <= quartile)


def portfolio_comparison(monthly: DataFrame, a: str, b: str, share: float, month: str = "month", value: str = "ret") -> DataFrame:
    """Two monthly series of one table (component, month, value) and their blend: total, mean, worst month, correlation, and how often b
    gains in a's losing months; a missing month counts as 0."""
    wide = monthly.where(F.col("component").isin(a, b)).groupBy(month).pivot("component", [a, b]).agg(F.sum(value)).na.fill(0.0)
    rows = wide.select(month, F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).withColumn("mix", share * F.col("a") + (1 - share) * F.col("b"))
    return rows.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("a", "b", "mix") for n, f in (("total", F.sum), ("mean", F.avg), ("worst", F.min))],
        F.corr("a", "b").alias("corr"),
        F.avg(F.when(F.col("a") < 0, (F.col("b") > 0).cast("double"))).alias("b_gains_when_a_loses"),
        F.count_if((F.col("a") < 0) & (F.col("b") < 0)).alias("both_negative"),
    )


def best_and_worst_removed(trades: DataFrame, keys: list[str], pnl: str, tie: str, n: int) -> DataFrame:
    """Net and profit factor as they are, without the best n trades, and with the worst n counted twice."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pnl), tie))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(pnl, tie))
    rows = trades.withColumn("__b", best).withColumn("__w", worst)
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("__b") > n, "without_best"), F.lit("worst_twice"), F.when(F.col("__w") <= n, "worst_twice")))
    rows = rows.withColumn("scenario", F.explode(names))
    return rows.groupBy(*keys, "scenario").agg(F.count("*").alias("n"), F.sum(pnl).alias("net"), metrics.profit_factor(pnl, "b").alias("profit_factor"))


def cost_sensitivity(trades: DataFrame, keys: list[str], scenarios: dict[str, float]) -> DataFrame:
    """Per scenario (multiple of the fees): net result, profit factor, and the break-even cost per notional."""
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("fee_x")) for n, m in scenarios.items()])
    rows = trades.select("*", F.inline(options)).withColumn("__p", F.col("gross_pnl") - F.col("fee_x") * F.col("total_fee"))
    return rows.groupBy(*keys, "scenario").agg(F.sum("__p").alias("net"), metrics.profit_factor("__p", "b").alias("profit_factor"), (F.sum("gross_pnl") / F.nullif(F.sum("notional"), F.lit(0.0))).alias("break_even"))


def risk_sweep(trades: DataFrame, keys: list[str], order: list[str], ret: str, risks: list[float], start: float) -> DataFrame:
    """Final balance and deepest drawdown when every trade's return is scaled by each risk level."""
    rows = trades.withColumn("risk", F.explode(F.array(*map(F.lit, risks)))).withColumn("__r", F.col("risk") * F.col(ret))
    run = [*keys, "risk"]
    rows = metrics.drawdowns(ledger.compound(rows, run, order, "__r", start), run, order, "balance_after")
    return rows.groupBy(*run).agg(F.max_by("balance_after", F.struct(*order)).alias("final"), F.min("drawdown").alias("max_drawdown"))


def leverage_stress_grid(trades: DataFrame, keys: list[str], order: list[str], modes: dict[str, list[float]], start: float) -> DataFrame:
    """The leveraged fold under every stress case: final equity and liquidations per run, case and mode."""
    rows = trades.select(*keys, *order, "ret", "fee_rate")
    # the cases are made of each piece of the trades, which are put in order once
    cases = lambda rows: ledger.stress(rows).drop("ret", "fee_rate", "drift", "slip", "fee_x", "liq_shift")
    folded = ledger.leveraged_fold(rows, keys, order, "stressed_ret", modes, start, each=cases, by=("scenario",))
    return folded.groupBy(*keys, "scenario", "mode").agg(F.max_by("equity_after", F.struct(*order)).alias("final"), F.count_if("liquidated").alias("n_liquidated"))


def weak_month_overlap(a: DataFrame, b: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """How b does in the months in which a loses: months in common, b's positive rate there, both negative, correlation."""
    rows = a.select(*keys, month, F.col(value).alias("a")).join(b.select(*keys, month, F.col(value).alias("b")), [*keys, month])
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_months"),
        F.avg(F.when(F.col("a") < 0, (F.col("b") > 0).cast("double"))).alias("positive_in_negative"),
        F.count_if((F.col("a") < 0) & (F.col("b") < 0)).alias("both_negative"),
        F.corr("a", "b").alias("corr"),
    )


def context_events(rows: DataFrame, context: Column, ts: str = "bar_ts") -> DataFrame:
    """Every bar in a context with the next bar's open as a candidate entry."""
    w = Window.partitionBy("symbol").orderBy(ts)
    out = rows.withColumn("entry_time", F.lead(ts).over(w)).withColumn("entry_price", F.lead("open").over(w))
    return out.where(true(context) & F.col("entry_time").isNotNull())
