"""Forward labels of events: returns, excursions, first touches. A null label has no full horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import interval_join
from tidemark.operators.indicators import series


def forward(ts: str, h: int):
    return series(ts).rowsBetween(1, h)


def forward_labels(bars: DataFrame, horizons: list[int], require_full: bool = True, entry: str = "close", ts: str = "bar_ts") -> DataFrame:
    """fwd_ret_h, fwd_mfe_h, fwd_mae_h over the next h bars, relative to the entry column."""
    cols = {}
    for h in horizons:
        w = forward(ts, h)
        full = F.count("*").over(w) == h if require_full else F.count("*").over(w) > 0
        price = F.nullif(F.col(entry), F.lit(0.0))
        last = F.last("close").over(w)
        cols[f"fwd_ret_{h}"] = F.when(full, last / price - 1)
        cols[f"fwd_mfe_{h}"] = F.when(full, F.max("high").over(w) / price - 1)
        cols[f"fwd_mae_{h}"] = F.when(full, F.min("low").over(w) / price - 1)
    return bars.withColumns(cols)


def _inverse(move: Column) -> Column:
    """The move of 1 / price: without bound where the price falls to 0."""
    return F.when(1 + move == 0, F.lit(float("inf"))).otherwise(1 / F.nullif(1 + move, F.lit(0.0)) - 1)


def directional(rows: DataFrame, horizons: list[int], side: str = "side") -> DataFrame:
    """The labels as seen by each row's side: a short gains when prices fall."""
    short = F.col(side) == "SHORT"
    cols = {}
    for h in horizons:
        ret, mfe, mae = (F.col(f"fwd_{x}_{h}") for x in ("ret", "mfe", "mae"))
        cols[f"dir_ret_{h}"] = F.when(short, -ret).otherwise(ret)
        cols[f"dir_mfe_{h}"] = F.when(short, _inverse(mae)).otherwise(mfe)
        cols[f"dir_mae_{h}"] = F.when(short, _inverse(mfe)).otherwise(mae)
    return rows.withColumns(cols)


def bars_to_target(target: Column, side_up: Column, h: int, ts: str = "bar_ts") -> Column:
    """Bars until the first of the next h whose high reaches target (side_up) or whose low does; null if none."""
    w = forward(ts, h)
    highs, lows = F.collect_list("high").over(w), F.collect_list("low").over(w)
    up = F.array_position(F.transform(highs, lambda x: x >= target), F.lit(True))
    down = F.array_position(F.transform(lows, lambda x: x <= target), F.lit(True))
    return F.nullif(F.when(side_up, up).otherwise(down), F.lit(0).cast("bigint"))


def any_ahead(flag: str, h: int, ts: str = "bar_ts") -> Column:
    return F.coalesce(F.bool_or(F.col(flag)).over(forward(ts, h)), F.lit(False))


def first_touch(up: str, down: str, h: int, tie: str = "ambiguous", ts: str = "bar_ts") -> Column:
    """Which level the next h bars reach first: plus (high >= column up), minus (low <= column down), none, or `tie` if
    one bar reaches both."""
    w = forward(ts, h)
    pairs = F.collect_list(F.struct("high", "low")).over(w)
    hits = F.transform(pairs, lambda x: F.when((x["high"] >= F.col(up)) & (x["low"] <= F.col(down)), tie).when(x["high"] >= F.col(up), "plus").when(x["low"] <= F.col(down), "minus"))
    first = F.get(F.array_compact(hits), 0)
    return F.when(F.col(up).isNotNull() & F.col(down).isNotNull(), F.coalesce(first, F.lit("none")))


def path_first_touch(path: DataFrame, keys: list[str], up: Column, down: Column, tie: str = "ambiguous", ts: str = "path_ts") -> DataFrame:
    """The same over joined path rows (high, low) of each event: touch and touch_time."""
    hit_up, hit_down = F.col("high") >= up, F.col("low") <= down
    rows = path.groupBy(*keys).agg(F.min(F.when(hit_up, F.col(ts))).alias("u"), F.min(F.when(hit_down, F.col(ts))).alias("d"))
    touch = F.when(F.col("u").isNull() & F.col("d").isNull(), "none").when(F.col("u") == F.col("d"), tie)
    touch = touch.when(F.col("d").isNull() | (F.col("u") < F.col("d")), "plus").otherwise("minus")
    return rows.select(*keys, touch.alias("touch"), F.least("u", "d").alias("touch_time"))


def path_windows(events: DataFrame, points: DataFrame, seconds: list[int], entry_time: str, entry_price: str, keys: list[str], bucket_seconds: int, point: str = "ts") -> DataFrame:
    """Per event and window (seconds after entry): excursions of the path in it, from one join at the longest window."""
    longest = max(seconds)
    ends = events.withColumn("__end", F.expr(f"timestampadd(SECOND, {longest}, {entry_time})"))
    rows = interval_join(ends, points, entry_time, "__end", point, bucket_seconds, ["high", "low"])
    rows = rows.withColumn("window_s", F.explode(F.array(*map(F.lit, sorted(seconds)))))
    rows = rows.where(F.expr(f"timestampdiff(MICROSECOND, {entry_time}, path_ts) <= window_s * 1000000L"))
    p = F.nullif(F.first(entry_price), F.lit(0.0))
    return rows.groupBy(*keys, "window_s").agg(
        (F.max("high") / p - 1).alias("mfe"),
        (F.min("low") / p - 1).alias("mae"),
        F.count("*").alias("n_points"),
        F.min_by("path_ts", F.struct((-F.col("high")).alias("h"), "path_ts")).alias("mfe_time"),
    )


def safety(rows: DataFrame, leverages: list[int], maintenance: float = 0.005) -> DataFrame:
    """liq_Lx: whether a long's adverse excursion reaches the liquidation distance at leverage L; safe_Lx."""
    cols = {}
    for x in leverages:
        hit = F.col("mae") <= -(1 / x - maintenance)
        cols |= {f"liq_{x}x": hit, f"safe_{x}x": ~hit}
    return rows.withColumns(cols)


def unpivot_labels(rows: DataFrame, ids: list[str], horizons: list[int]) -> DataFrame:
    """Long form: one row per event and horizon."""
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"fwd_{x}_{h}").alias(f"fwd_{x}") for x in ("ret", "mfe", "mae")]) for h in horizons])
    return rows.select(*ids, F.inline(parts))
