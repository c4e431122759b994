"""Stateful sequences as window functions: set / reset states, islands, streaks and held states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import series
from tidemark.operators.patterns import true
from tidemark.operators.pieces import carried, numbered, rows_until, with_halo
from tidemark.operators.selection import non_overlapping
from tidemark.scratch import written

#: Bars of a piece of a long series.
PIECE = 4096


def set_reset(rows: DataFrame, on: Column, off: Column, name: str, keys: list[str] | None = None, ts: str = "bar_ts") -> DataFrame:
    """Adds name (1 from a row where `on` holds until a row where `off` does; `off` wins), name_first (first row of a
    run of 1) and name_age (rows since the run's first row, null outside)."""
    keys = keys or ["symbol"]
    rows = rows.withColumn("__e", F.when(F.coalesce(off, F.lit(False)), 0).when(F.coalesce(on, F.lit(False)), 1))
    rows = carried(numbered(rows, keys, [ts], "__rn"), keys, [ts], {"__before": "__e"})
    rows = rows.withColumn(name, F.coalesce("__e", "__before", F.lit(0)))
    rows = rows.withColumn(f"{name}_first", (F.col(name) == 1) & (F.coalesce("__before", F.lit(0)) == 0))
    rows = rows.withColumn("__start", F.when(F.col(f"{name}_first"), F.col("__rn")))
    rows = carried(rows, keys, [ts], {"__opened": "__start"})
    age = F.col("__rn") - F.coalesce("__start", "__opened")
    return rows.withColumn(f"{name}_age", F.when(F.col(name) == 1, age)).drop("__e", "__rn", "__before", "__start", "__opened")


def segments(rows: DataFrame, state: str, ts: str = "bar_ts") -> DataFrame:
    """One row per run of state = 1: segment_id (per symbol), start, end, bars, return, run-up and in-segment drawdown."""
    run = series(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment_id", F.sum(F.col(f"{state}_first").cast("int")).over(run)).where(F.col(state) == 1)
    inside = Window.partitionBy("symbol", "segment_id").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__dd", F.col("close") / F.nullif(F.max("close").over(inside), F.lit(0.0)) - 1)
    out = rows.groupBy("symbol", "segment_id").agg(
        F.min(ts).alias("segment_start"),
        F.max(ts).alias("segment_end"),
        F.count("*").alias("n_bars"),
        F.min_by("close", ts).alias("start_price"),
        F.max_by("close", ts).alias("end_price"),
        F.max("high").alias("top"),
        F.min("__dd").alias("drawdown"),
    )
    out = out.withColumn("segment_return", F.col("end_price") / F.nullif(F.col("start_price"), F.lit(0.0)) - 1)
    return out.withColumn("run_up", F.col("top") / F.nullif(F.col("start_price"), F.lit(0.0)) - 1).drop("top")


def post_exit_phase(rows: DataFrame, state: str, edges: tuple[int, int, int] = (4, 16, 64), ts: str = "bar_ts") -> DataFrame:
    """bars_since_exit and phase: held, 0-4, 5-16, 17-64, idle; before any exit idle."""
    w = series(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    left = (F.col(state) == 0) & (F.lag(state).over(w) == 1)
    rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__x", F.when(left, F.col("__rn")))
    since = F.col("__rn") - F.last("__x", ignorenulls=True).over(run)
    rows = rows.withColumn("bars_since_exit", F.when(F.col(state) == 0, since))
    a, b, c = edges
    b_since = F.col("bars_since_exit")
    phase = F.when(F.col(state) == 1, "held").when(b_since.isNull(), "idle").when(b_since <= a, f"0-{a}").when(b_since <= b, f"{a + 1}-{b}")
    return rows.withColumn("phase", phase.when(b_since <= c, f"{b + 1}-{c}").otherwise("idle")).drop("__rn", "__x")


def islands(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """The rows where flag holds, with island: the number of the maximal run they lie in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    start = F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))
    rows = rows.withColumn("__s", start)
    rows = rows.withColumn("island", F.sum(F.col("__s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__f").drop("__f", "__s")


def longest_run(rows: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Per key the length of the longest run of flag, 0 if none."""
    found = islands(rows, keys, order, flag).groupBy(*keys, "island").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias(name))
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def longest_loss_values(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the values of the first longest run of losses."""
    found = islands(rows, keys, order, F.col(value) <= 0)
    runs = found.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, value))).alias("v"))
    best = runs.groupBy(*keys).agg(F.max_by("v", F.struct("n", (-F.col("island")).alias("i"))).alias("v"), F.max("n").alias("n"))
    return best.select(*keys, F.col("n").alias("run_length"), F.transform("v", lambda x: x[value]).alias("losses"))


def loss_streaks(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = 3) -> DataFrame:
    """Runs of at least that many losses: start, end, rows, total and mean."""
    found = islands(rows, keys, order, F.col(value) <= 0)
    out = found.groupBy(*keys, "island").agg(
        F.min(order[0]).alias("start_time"),
        F.max(order[0]).alias("end_time"),
        F.count("*").alias("n_losses"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
    )
    return out.where(F.col("n_losses") >= least).drop("island")


def underwater(curve: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key: longest run of rows below the running peak, and its longest time from the peak before to recovery or
    the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("__peak", F.max(value).over(run)).withColumn("__prev", F.lag(order[0]).over(w)).withColumn("__next", F.lead(order[0]).over(w))
    found = islands(rows, keys, order, F.col(value) < F.col("__peak")).groupBy(*keys, "island").agg(
        F.count("*").alias("n"), F.min("__prev").alias("a"), F.max(F.coalesce("__next", order[0])).alias("b")
    )
    found = found.withColumn("sec", F.expr("timestampdiff(SECOND, a, b)")).groupBy(*keys).agg(F.max("n").alias("underwater_rows"), F.max("sec").alias("underwater_seconds"))
    out = curve.select(*keys).distinct().join(found, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("underwater_rows", "underwater_seconds")})


def trading_pause(trades: DataFrame, keys: list[str], order: list[str], value: str, start: float = 1e6, deepest: float = 0.3) -> DataFrame:
    """paused after each closed trade: set by 4 losses in the last 5, under a quarter of wins or a negative sum in the
    last 10, or a balance (start plus all results) that deep under its peak; reset by 2 wins in the last 3."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n: w.rowsBetween(1 - n, 0)
    loss, win = (F.col(value) <= 0).cast("int"), (F.col(value) > 0).cast("int")
    rows = trades.withColumn("__l", loss).withColumn("__w", win).withColumn("__eq", start + F.sum(value).over(run))
    full = lambda n: F.count("*").over(last(n)) == n
    bad = (full(5) & (F.sum("__l").over(last(5)) >= 4)) | (full(10) & ((F.avg("__w").over(last(10)) < 0.25) | (F.sum(value).over(last(10)) < 0)))
    bad = bad | (F.col("__eq") < (1 - deepest) * F.greatest(F.lit(float(start)), F.max("__eq").over(run)))
    good = full(3) & (F.sum("__w").over(last(3)) >= 2)
    event = F.when(good, 0).when(bad, 1)
    rows = rows.withColumn("__e", event)
    paused = F.coalesce(F.last("__e", ignorenulls=True).over(run), F.lit(0)) == 1
    return rows.withColumn("paused", paused).drop("__l", "__w", "__e", "__eq")


def recent_losses(trades: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return trades.withColumn("recent_losses", F.coalesce(F.sum((F.col(value) <= 0).cast("int")).over(w), F.lit(0)))


def trailing_stop(path: DataFrame, keys: list[str], ts: str, entry: str, arm: float = 0.15, callback: float = 0.05) -> DataFrame:
    """Per trade path (rows with high, low): the first row whose low falls to the stop level, which is the entry once
    the running high before it has gained `arm`, or the high less `callback` if that is more; null if none."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    rows = path.withColumn("__top", F.max("high").over(w))
    level = F.when(F.col("__top") >= F.col(entry) * (1 + arm), F.greatest(F.col(entry), F.col("__top") * (1 - callback)))
    rows = rows.withColumn("__level", level)
    hit = F.when(F.col("low") <= F.col("__level"), F.struct(F.col(ts).alias("stop_time"), F.col("__level").alias("stop_level")))
    return rows.groupBy(*keys).agg(F.min(hit).alias("x")).select(*keys, "x.stop_time", "x.stop_level")


def daily_universe(bars: DataFrame, top: int, ts: str = "bar_ts") -> DataFrame:
    """Per day the symbols ranked by the day before's quote volume, those up to `top` as members."""
    day = bars.groupBy(F.date_add(F.to_date(ts), 1).alias("day"), "symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("quote_volume"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("quote_volume"), "symbol"))
    return day.withColumn("rank", rank).withColumn("member", F.col("rank") <= top)


def breakout_events(rows: DataFrame, max_age: int = 8, ts: str = "bar_ts") -> DataFrame:
    """Post-breakout state over trend_signals(): an event opens on a breakout when none is open, and closes by age, an
    exit signal, or an entry (a pull-back: lower low, then a bullish bar). event_no counts a symbol's events; event_state is
    opened, open, entered, invalid, expired or none, event_age the bars since the opening.

    An event closes within max_age + 1 bars whatever came before it, so each bar that could open one first gets the close that it would
    have, over pieces of the series; which of them open is then a greedy choice of events that do not overlap."""
    placed = numbered(rows, ["symbol"], [ts], "__i")
    ahead = Window.partitionBy("symbol").orderBy(ts).rowsBetween(1, max_age + 1)
    bar = F.struct(F.col(ts).alias("ts"), F.col("__i").alias("i"), "exit_signal", "low", "open", "close")

    def first_close(part: DataFrame) -> DataFrame:
        return part.withColumn("__ahead", F.collect_list(bar).over(ahead))

    may_open = true(F.col("breakout")) & ~true(F.col("exit_signal"))
    # symbols of the pieces are (symbol, piece), as in in_pieces, but the places stay
    pieces = with_halo(placed, "__i", PIECE, 0, max_age + 1).withColumn("symbol", F.struct("symbol", "__piece")).drop("__piece")
    starts = first_close(pieces).where("__own").where(may_open).withColumn("symbol", F.col("symbol.symbol"))
    step = f"""aggregate(__ahead, named_struct('age', 0, 'low', low, 'pulled', false, 'state', 'open', 'ts', {ts}, 'i', __i, 'bars', cast(array() as array<struct<i:bigint,age:int,state:string>>)),
      (s, b) -> if(s.state <> 'open', s, transform(array(case when coalesce(b.exit_signal, false) then 'invalid' when s.age + 1 > {max_age} then 'expired'
          when s.age >= 1 and s.pulled and coalesce(b.close > b.open, false) then 'entered' else 'open' end),
        x -> named_struct('age', s.age + 1, 'low', b.low, 'pulled', s.pulled or coalesce(b.low < s.low, false), 'state', x, 'ts', b.ts, 'i', b.i,
          'bars', concat(s.bars, array(named_struct('i', b.i, 'age', s.age + 1, 'state', x)))))[0]))"""
    starts = starts.withColumn("__close", F.expr(step)).select("symbol", F.col(ts).alias("__start"), F.col("__close.ts").alias("__end"), F.col("__i").alias("__open"), F.col("__close.bars").alias("__bars"))
    kept = written(non_overlapping(starts, ["symbol"], "__start", "__end", "__open"), "breakouts")
    own = F.array(F.struct(F.col("__open").alias("i"), F.lit(0).alias("age"), F.lit("opened").alias("state")))
    labels = kept.select("symbol", F.inline(F.concat(own, "__bars"))).select("symbol", F.col("i").alias("__i"), F.col("age").alias("event_age"), F.col("state").alias("event_state"))
    found = placed.join(labels, ["symbol", "__i"], "left")
    found = rows_until(found, kept, ["symbol"], ts, "__start", "event_no")
    return found.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col("event_no").cast("int").alias("event_no"),
        F.coalesce("event_state", F.lit("none")).alias("event_state"),
        F.coalesce("event_age", F.lit(0)).alias("event_age"),
    )
