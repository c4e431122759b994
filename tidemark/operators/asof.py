"""As-of, interval and containment joins, and joins with fallback keys.

As-of joins union both sides and carry the last row along each day's order and from day to day; interval joins explode each interval
into the time buckets it spans, so that they are equi-joins on (symbol, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pieces import day_of, null_safe_join
from tidemark.scratch import written


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, values: list[str], direction: str = "backward", strict: bool = False, keys: list[str] | None = None) -> DataFrame:
    """left with `values` of the nearest right row at or before (backward) or at or after (forward) left's `on`, not at it
    if strict; nulls without one. Of right rows at one time the largest tuple of values counts backward, the smallest
    forward."""
    keys = keys or ["symbol"]
    back = direction == "backward"
    # at equal times: a right row that counts lies before the left row in the scan's direction
    side = F.lit(1 if strict else 0)
    own = left.select(*keys, F.col(on).alias("__t"), F.lit(1 - (1 if strict else 0)).alias("__s"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    other = right.select(*keys, F.col(right_on).alias("__t"), side.alias("__s"), F.lit(None).cast(own.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__v"))
    order = [F.col("__t") if back else F.desc("__t"), F.col("__s"), F.col("__v") if back else F.desc("__v")]
    both = own.unionByName(other)
    both = written(both.withColumn("__day", day_of(both, "__t")), "asof")
    inside = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # what a day hands on to the days behind it in the scan's direction
    row = F.when(F.col("__v").isNotNull(), F.struct("__t", "__v"))
    days = both.groupBy(*keys, "__day").agg((F.max(row) if back else F.min(row)).alias("__x"))
    behind = Window.partitionBy(*keys).orderBy("__day" if back else F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "__day", F.last("__x", ignorenulls=True).over(behind).alias("__x"))
    rows = null_safe_join(both.withColumn("__v", F.last("__v", ignorenulls=True).over(inside)).where("__l is not null"), days, [*keys, "__day"])
    rows = rows.withColumn("__v", F.coalesce("__v", "__x.__v"))
    return rows.select("__l.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def next_open(signals: DataFrame, bars: DataFrame, signal_time: str = "signal_time", strict: bool = False, ts: str = "bar_ts") -> DataFrame:
    """Adds execution_time and execution_open: the first bar at (or, strict, after) the signal."""
    quotes = bars.select("symbol", F.col(ts).alias("execution_time"), F.col("open").alias("execution_open"))
    return asof(signals, quotes, signal_time, "execution_time", ["execution_time", "execution_open"], "forward", strict)


def regime_join(rows: DataFrame, labels: DataFrame, on: str, right_on: str, columns: list[str]) -> DataFrame:
    """Backward as-of join of string labels; rows without one are unknown."""
    out = asof(rows, labels, on, right_on, columns)
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in columns})


def complete_asof(rows: DataFrame, frame: DataFrame, on: str, right_on: str, columns: list[str]) -> DataFrame:
    """Backward as-of join in which a matched row with any null counts as no match."""
    out = asof(rows, frame, on, right_on, columns)
    whole = F.expr(" and ".join(f"`{c}` is not null" for c in columns))
    return out.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, bucket_seconds: int, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each interval with each point of the same keys and start <= point <= end: intervals' columns, `point` as
    path_ts, and values of the points."""
    keys = keys or ["symbol"]
    number = lambda c: F.expr(f"cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01', {c}) / {bucket_seconds}) as bigint)")
    left = intervals.where(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(number(start), number(end))))
    right = points.select(*keys, F.col(point).alias("path_ts"), *values).withColumn("__bucket", number("path_ts"))
    rows = left.join(right, [*keys, "__bucket"]).where(F.col("path_ts").between(F.col(start), F.col(end)))
    return rows.drop("__bucket")


def containment(points: DataFrame, segments: DataFrame, point: str, start: str, end: str, values: list[str]) -> DataFrame:
    """points with the last segment that starts at or before them, if it has not ended; mapped tells which."""
    out = asof(points, segments.withColumn("__start", F.col(start)), point, start, [start, *[v for v in values if v != start]])
    inside = F.coalesce(F.col(point) <= F.col(end), F.lit(False))
    out = out.withColumn("mapped", inside)
    return out.withColumns({c: F.when(F.col("mapped"), F.col(c)) for c in dict.fromkeys([start, *values])})


def match_with_fallback(rows: DataFrame, pool: DataFrame, primary: list[str], fallback: list[str], value: str) -> DataFrame:
    """Per row the count, mean of the pool's rows with equal primary keys, else with equal fallback keys (nulls equal
    nulls), and which matched."""
    def grouped(keys: list[str], tag: str) -> DataFrame:
        found = pool.groupBy(*keys).agg(F.count(value).alias(f"__n{tag}"), F.avg(value).alias(f"__m{tag}"))
        return found.select(*[F.col(k).alias(f"__{tag}_{k}") for k in keys], f"__n{tag}", f"__m{tag}")

    out = rows
    for keys, tag in ((primary, "p"), (fallback, "f")):
        right = grouped(keys, tag)
        condition = [out[k].eqNullSafe(right[f"__{tag}_{k}"]) for k in keys]
        out = out.join(right, condition, "left").drop(*[f"__{tag}_{k}" for k in keys])
    kind = F.when(F.col("__np") > 0, "primary").when(F.col("__nf") > 0, "fallback").otherwise("unmatched")
    out = out.withColumn("match_kind", kind).withColumn("match_n", F.when(F.col("__np") > 0, F.col("__np")).otherwise(F.coalesce("__nf", F.lit(0))))
    return out.withColumn("match_mean", F.when(F.col("__np") > 0, F.col("__mp")).otherwise(F.col("__mf"))).drop("__np", "__mp", "__nf", "__mf")


def explode_map(rows: DataFrame, column: str, mapping: dict[str, str], blocked: list[str], name: str) -> DataFrame:
    """One row per ;-joined token that is not blocked, with its group by the mapping, else unmapped."""
    out = rows.withColumn("token", F.explode(F.split(column, ";"))).withColumn("token", F.trim("token"))
    out = out.where((F.col("token") != "") & ~F.col("token").isin(blocked)) if blocked else out.where("token <> ''")
    group = F.lit("unmapped")
    for k, v in mapping.items():
        group = F.when(F.col("token") == k, v).otherwise(group)
    return out.withColumn(name, group)


def overlap_pairs(rows: DataFrame, keys: list[str], start: str, end: str, ident: str, bucket_seconds: int) -> DataFrame:
    """Pairs (a, b) of rows of one key whose intervals overlap, a < b; each pair once, in the first bucket both span."""
    number = lambda c: F.expr(f"cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01', {c}) / {bucket_seconds}) as bigint)")
    base = rows.select(*keys, F.col(ident).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"))
    base = base.withColumn("first", number("s")).withColumn("b", F.explode(F.sequence(F.col("first"), number("e"))))
    x, y = base.alias("x"), base.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "b"]]
    on = [*same, F.col("x.i") < F.col("y.i"), F.col("x.s") <= F.col("y.e"), F.col("x.e") >= F.col("y.s")]
    on.append(F.col("x.b") == F.greatest("x.first", "y.first"))
    return x.join(y, on).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.i").alias("a"), F.col("y.i").alias("b"))


def overlap_counts(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """n_pairs of rows of each key whose closed intervals overlap, without making them: all pairs less those in which one
    begins after the other has ended. Begins and ends are counted by time first, and running counts go from block to block
    of a year, so no task holds a key."""
    mark = lambda c, b, e: F.struct(F.col(c).alias("t"), F.lit(b).cast("bigint").alias("b"), F.lit(e).cast("bigint").alias("e"))
    marks = rows.select(*keys, F.inline(F.array(mark(start, 1, 0), mark(end, 0, 1))))
    times = marks.groupBy(*keys, "t").agg(F.sum("b").alias("b"), F.sum("e").alias("e")).withColumn("block", F.year("t"))
    blocks = times.groupBy(*keys, "block").agg(F.sum("b").alias("all"))
    after = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("later", F.coalesce(F.sum("all").over(after), F.lit(0))).drop("all")
    inside = Window.partitionBy(*keys, "block").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("own", F.coalesce(F.sum("b").over(inside), F.lit(0))).join(blocks, [*keys, "block"])
    n = F.sum("b")
    return times.groupBy(*keys).agg((n * (n - 1) / 2 - F.sum(F.col("e") * (F.col("own") + F.col("later")))).cast("bigint").alias("n_pairs"))


def portfolio_curve(curves: DataFrame, ts: str, run: str, value: str, block: str = "yyyy-MM") -> DataFrame:
    """Equal-weight mean of the curves at every time of any of them, each carried forward, 1 before its first row: 1 plus
    the running sum of all curves' changes over their number. The running sum goes from block to block of times."""
    rows = curves.groupBy(run, ts).agg(F.max(value).alias("v"))
    change = F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy(run).orderBy(ts)), F.lit(1.0))
    times = rows.withColumn("d", change).groupBy(ts).agg(F.sum("d").alias("d")).withColumn("block", F.date_format(ts, block))
    # one row per block of times
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = times.groupBy("block").agg(F.sum("d").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0.0))).drop("all")
    inside = Window.partitionBy("block").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = times.withColumn("own", F.sum("d").over(inside)).join(blocks, "block")
    n = curves.agg(F.count_distinct(run).alias("n_curves"))
    return out.join(F.broadcast(n)).select(ts, (1 + (F.col("base") + F.col("own")) / F.col("n_curves")).alias(value), "n_curves")  # n is one row
