"""Data quality of bars and ledgers: reports, guards and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.orderstats import Sliding, sliding


def merge_sources(sources: list[DataFrame], keys: list[str], order: str | None = None) -> DataFrame:
    """Union of sources in rising precedence; of rows with equal keys that of the last source stays (of one source's
    the largest `order`)."""
    rows = None
    for i, one in enumerate(sources):
        one = one.withColumn("__source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    by = [F.desc("__source"), *([F.desc(order)] if order else [])]
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.where("__rn = 1").drop("__rn", "__source")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key repeats, with the number of rows of the key."""
    return rows.withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys))).where("n_rows > 1")


def invalid_bar() -> Column:
    o, h, low, c, v = map(F.col, ("open", "high", "low", "close", "volume"))
    wrong = (low > F.least(o, c)) | (h < F.greatest(o, c)) | (F.least(o, h, low, c) <= 0) | (v < 0)
    return F.coalesce(wrong, F.lit(True))


def invalid_bars(bars: DataFrame) -> DataFrame:
    return bars.where(invalid_bar())


def gaps(bars: DataFrame, step_seconds: int, ts: str = "bar_ts") -> DataFrame:
    """prev_ts, next_ts and missing steps where two neighbours lie more than a step apart."""
    prev = F.lag(ts).over(Window.partitionBy("symbol").orderBy(ts))
    rows = bars.select("symbol", prev.alias("prev_ts"), F.col(ts).alias("next_ts"))
    seconds = F.expr("timestampdiff(SECOND, prev_ts, next_ts)")
    return rows.withColumn("missing", (seconds / step_seconds - 1).cast("bigint")).where(seconds > step_seconds)


def missing_islands(bars: DataFrame, step_seconds: int, ts: str = "bar_ts") -> DataFrame:
    """Missing steps of each symbol's calendar, compacted to (start_ts, end_ts, n_missing)."""
    found = gaps(bars, step_seconds, ts)
    start = F.expr(f"timestampadd(SECOND, {step_seconds}, prev_ts)")
    end = F.expr(f"timestampadd(SECOND, -{step_seconds}, next_ts)")
    return found.select("symbol", start.alias("start_ts"), end.alias("end_ts"), F.col("missing").alias("n_missing"))


def jumps(bars: DataFrame, limit: float = 0.10, ts: str = "bar_ts") -> DataFrame:
    """Bars whose close moved by more than `limit` on the bar before."""
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy(ts))
    return bars.withColumn("change", F.col("close") / F.nullif(prev, F.lit(0.0)) - 1).where(F.abs("change") > limit)


def robust_outliers(bars: DataFrame, window: int = 1440, least: int = 100, scale: float = 20.0, floor: float = 0.02, fill: float = 0.05, ts: str = "bar_ts") -> DataFrame:
    """Bars whose close lies further from the rolling median than scale times the rolling median absolute deviation,
    at least `floor` and `fill` where the window is short, all relative to the median."""
    rows = sliding(bars, {"median": Sliding("close", window, least, 0.5)}, [ts])
    rows = rows.withColumn("dev", F.abs(F.col("close") / F.nullif(F.col("median"), F.lit(0.0)) - 1))
    rows = sliding(rows, {"limit": Sliding("dev", window, least, 0.5)}, [ts])
    rows = rows.withColumn("limit", F.coalesce(F.greatest(F.col("limit") * scale, F.lit(floor)), F.lit(fill)))
    return rows.where(F.col("dev") > F.col("limit"))


def completeness(resampled: DataFrame, expected: int) -> DataFrame:
    """Per symbol: total, complete and incomplete bars and the first incomplete one."""
    return resampled.groupBy("symbol").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("n_ticks") >= expected).alias("complete"),
        F.count_if(F.col("n_ticks") < expected).alias("incomplete"),
        F.min(F.when(F.col("n_ticks") < expected, F.col("bar_ts"))).alias("first_incomplete"),
    )


def coverage(bars: DataFrame, least_days: int, ts: str = "bar_ts") -> DataFrame:
    """Per symbol: start, end, rows, days and whether they suffice."""
    rows = bars.groupBy("symbol").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"))
    rows = rows.withColumn("days", F.datediff("end_ts", "start_ts"))
    return rows.withColumn("status", F.when(F.col("days") >= least_days, "ok").otherwise("short"))


def coverage_decision(files: DataFrame, cut: str, least_days: int) -> DataFrame:
    """Of inventory rows (symbol, file, start_ts, end_ts) the file with most days after cut, or a block."""
    after = F.greatest(F.datediff("end_ts", F.greatest(F.col("start_ts"), F.lit(cut).cast("timestamp_ntz"))), F.lit(0))
    rows = files.withColumn("days_after", after)
    best = rows.groupBy("symbol").agg(F.max("days_after").alias("days_after"), F.max_by("file", F.struct("days_after", "file")).alias("file"))
    return best.withColumn("decision", F.when(F.col("days_after") >= least_days, "use").otherwise("blocked"))


def freshness(bars: DataFrame, expected: DataFrame, target: str, ts: str = "bar_ts") -> DataFrame:
    """Per expected(symbol): its last row, how many hours it is behind target, and missing / stale / fresh."""
    last = bars.groupBy("symbol").agg(F.max(ts).alias("last_ts"))
    rows = expected.select("symbol").distinct().join(last, "symbol", "left")
    hours = F.expr(f"timestampdiff(HOUR, last_ts, timestamp_ntz'{target}')")
    status = F.when(F.col("last_ts").isNull(), "missing").when(hours > 0, "stale").otherwise("fresh")
    return rows.withColumn("hours_behind", hours).withColumn("status", status)


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing rate, min, p05, p50, p95, max."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy("column").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
        F.min("value").alias("min"),
        q(0.05).alias("p05"),
        q(0.5).alias("p50"),
        q(0.95).alias("p95"),
        F.max("value").alias("max"),
    )


def no_overlap_guard(rows: DataFrame, ts: str, cut: str) -> DataFrame:
    """One row: whether all rows lie after the discovery period's end."""
    late = F.col(ts) > F.lit(cut).cast("timestamp_ntz")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~late).alias("n_leaks"), F.coalesce(F.bool_and(late), F.lit(True)).alias("passed"))


def required_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows in which it is null or empty."""
    blank = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in fields]
    return rows.agg(*blank).unpivot([], fields, "field", "n_blank")


def stage_inputs(rows: DataFrame, least_rows: int, forbidden: Column, symbols: list[str]) -> DataFrame:
    """One status row of a stage's input: enough rows, no forbidden states, all symbols."""
    out = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(forbidden).alias("n_forbidden"),
        F.size(F.array_except(F.lit(symbols), F.collect_set("symbol"))).alias("n_missing_symbols"),
    )
    good = (F.col("n_rows") >= least_rows) & (F.col("n_forbidden") == 0) & (F.col("n_missing_symbols") == 0)
    return out.withColumn("status", F.when(good, "pass").otherwise("blocked"))


def validate_schema(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """Per contract field (name, type): present, missing or of another type."""
    have = dict(df.dtypes)
    rows = [(n, t, "missing" if n not in have else "ok" if have[n] == t else f"is {have[n]}") for n, t in contract]
    return df.sparkSession.createDataFrame(rows, "field string, type string, status string")


def ledger_invariant(ledger: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Per run: the largest |balance_after - balance_before - net_pnl| and whether it is within tolerance."""
    off = F.abs(F.col("balance_after") - F.col("balance_before") - F.col("net_pnl"))
    return ledger.groupBy(*keys).agg(F.max(off).alias("max_off")).withColumn("passed", F.col("max_off") <= tolerance)


def execution_audit(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Per trade(symbol, trade_id, execution_time, entry_price): whether the recorded entry is that bar's open, and
    whether another trade entered at the same time."""
    opens = bars.select("symbol", F.col("bar_ts").alias("execution_time"), F.col("open").alias("bar_open"))
    rows = trades.join(opens, ["symbol", "execution_time"], "left")
    twice = F.count("*").over(Window.partitionBy("symbol", "execution_time")) > 1
    same = F.coalesce(F.abs(F.col("entry_price") - F.col("bar_open")) < 1e-9, F.lit(False))
    return rows.withColumn("entry_is_open", same).withColumn("duplicate_entry", twice)


def baseline_fairness(target: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows of the target and of the pool it is matched with, and whether the pool is larger."""
    a, b = target.groupBy(*keys).agg(F.count("*").alias("n_target")), pool.groupBy(*keys).agg(F.count("*").alias("n_pool"))
    rows = a.join(b, keys, "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
    return rows.withColumn("fair", F.col("n_pool") > F.col("n_target"))


def ledger_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two runs: rows on one side only and differing values."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    rows = a.join(b, keys, "full")
    kind = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only")
    return rows.withColumn("kind", kind.when(F.abs(F.col("left_value") - F.col("right_value")) > 1e-9, "differs").otherwise("same"))
