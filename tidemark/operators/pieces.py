"""Places in a long series, found without a task that holds the series: rows are numbered day by day, and a day's offset is
the count of the days before it. Numbered rows can be cut in pieces of equal size, so that no key has to fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import written


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; left's keys stay."""
    other = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    on = [left[f"`{k}`"].eqNullSafe(other[f"`__right_{k}`"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])


def day_of(rows: DataFrame, ts: str) -> Column:
    """The day of a time (a number counts seconds); rows without one come before all others."""
    numeric = isinstance(rows.schema[ts].dataType, T.NumericType)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / 86400).cast("int")) if numeric else F.to_date(ts)
    return F.coalesce(day, F.lit("0001-01-01").cast("date"))


def _offsets(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __day and __offset of days(keys, __day, __n): the rows of the days before."""
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "__i") -> DataFrame:
    """rows with their place (from 0) among their keys' rows by order, whose first column is a time. The result is a written table: all
    that is made of places reads it more than once, and numbering anew could break ties in another way."""
    rows = rows.withColumn("__day", day_of(rows, order[0]))
    days = rows.groupBy(*keys, "__day").agg(F.count("*").alias("__n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(*order)) - 1
    rows = null_safe_join(rows.withColumn(name, inside), _offsets(days, keys), [*keys, "__day"])
    return written(rows.withColumn(name, F.col(name) + F.col("__offset")).drop("__day", "__offset"), "numbered")


def carried(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """rows with, for each {name: column}, the column's last value that is not null in the rows before (by order, whose first column is a
    time; orders differ). Each day's last values go to the days after it, so a task holds one day. rows are read twice."""
    rows = rows.withColumn("__day", day_of(rows, order[0]))
    inside = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__last{i}") for i, c in enumerate(values.values())]
    days = rows.groupBy(*keys, "__day").agg(*lasts)
    days = days.select(*keys, "__day", *[F.last(f"__last{i}", ignorenulls=True).over(before).alias(f"__carry{i}") for i in range(len(lasts))])
    own = rows.withColumns({f"__own{i}": F.last(c, ignorenulls=True).over(inside) for i, c in enumerate(values.values())})
    out = null_safe_join(own, days, [*keys, "__day"])
    found = {name: F.coalesce(f"__own{i}", f"__carry{i}") for i, name in enumerate(values)}
    return out.withColumns(found).drop("__day", *[f"__{x}{i}" for x in ("own", "carry") for i in range(len(lasts))])


def with_halo(rows: DataFrame, place: str, size: int, before: int, after: int = 0) -> DataFrame:
    """rows with __piece, their place by `size`, and __own: true. The rows that lie up to `before` places ahead of a piece and up to
    `after` behind it come again with its number and __own false. Neither may be more than size."""
    if max(before, after) > size:
        raise ValueError("a piece has at least as many rows as a frame reaches")
    piece, at = F.floor(F.col(place) / size), F.col(place) % size
    part = lambda p, own: F.struct(p.alias("__piece"), F.lit(own).alias("__own"))
    near = [F.when(at >= size - before, part(piece + 1, False)), F.when(at < after, part(piece - 1, False))]
    return rows.select("*", F.inline(F.array_compact(F.array(part(piece, True), *near))))


def rows_until(points: DataFrame, rows: DataFrame, keys: list[str], at: str, ts: str, name: str) -> DataFrame:
    """points with name: how many rows of their keys have a time at or before theirs (rows without a time count). A point
    without a time gets null. Both inputs are read twice, so they should be cheap to read."""
    own = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__s"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("__p"))
    other = rows.select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(own.schema["__p"].dataType).alias("__p"))
    both = own.unionByName(other)
    both = both.withColumn("__day", day_of(both, "__t"))
    days = both.groupBy(*keys, "__day").agg(F.count_if(F.col("__s") == 0).alias("__n"))
    inside = Window.partitionBy(*keys, "__day").orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__c", F.count_if(F.col("__s") == 0).over(inside)).where("__p is not null")
    both = null_safe_join(both, _offsets(days, keys), [*keys, "__day"])
    found = F.when(F.col(f"__p.`{at}`").isNotNull(), F.col("__c") + F.col("__offset"))
    return both.select("__p.*", found.alias(name))
