"""First bar of a path that reaches a level, found through a tree of block extremes.

A symbol's bars are numbered and kept in blocks of FAN; the next level keeps each block's lowest low, highest high and whether a
flag is set in it, again in rows of FAN, and so on. A path's search takes the rest of its first block, then climbs until a block
ahead can hold the end of the search, and goes down to the bar: at most two rows of the tree are joined a level,
so the work of a path grows with the logarithm of its length, and the extremes of all bars passed come from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pieces import numbered, rows_until
from tidemark.scratch import discard, written

FAN = 64


@dataclass
class PathIndex:
    """levels[0]: blocks of bars; levels[n]: the extremes of the blocks of the level below. All as symbol, node, kids."""

    levels: list[DataFrame]

    def times(self) -> DataFrame:
        """symbol and ts of every bar."""
        return self.levels[0].select("symbol", F.explode("kids.ts").alias("ts"))

    def last(self) -> DataFrame:
        """symbol, last_time, last_close and n_bars."""
        kid = F.max_by(F.element_at("kids", -1), "node")
        return self.levels[0].groupBy("symbol").agg(kid.alias("k")).select("symbol", F.col("k.ts").alias("last_time"), F.col("k.close").alias("last_close"), (F.col("k.i") + 1).alias("n_bars"))


def build(bars: DataFrame, flag: str | None = None, ts: str = "bar_ts") -> PathIndex:
    """The tree over bars(symbol, ts, high, low, close) and the boolean column `flag`. Bars of a symbol have different times."""
    marked = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = numbered(bars.select("symbol", F.col(ts).alias("ts"), "low", "high", "close", marked.alias("flag")), ["symbol"], ["ts"])
    kid = F.struct(F.col("__i").alias("i"), "low", "high", "flag", "ts", "close")
    level = rows.groupBy("symbol", F.floor(F.col("__i") / FAN).alias("node")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    levels = [written(level, "path-level")]
    top = levels[0].agg(F.max("node").alias("n")).first().n or 0
    while top > 0:
        kid = F.expr(
            "named_struct('i', node, 'low', array_min(transform(kids, k -> k.low)), 'high', array_max(transform(kids, k -> k.high)), 'flag', exists(kids, k -> k.flag))"
        )
        above = levels[-1].select("symbol", F.floor(F.col("node") / FAN).alias("up"), kid.alias("kid"))
        above = above.groupBy("symbol", F.col("up").alias("node")).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        levels.append(written(above, "path-level"))
        top //= FAN
    discard(rows)
    return PathIndex(levels)


def first_touch(points: DataFrame, index: PathIndex, after: str, until: str | None, low: str | None, high: str | None = None) -> DataFrame:
    """points(symbol, ...) with found: the first bar later than `after` whose low is at most the column `low`, whose high is at least the
    column `high`, or whose flag is set; else the last bar at or before `until` (of all bars if that is None). found
    holds ts, low, high, close and flag, path_low and path_high the extremes from the first bar to it; all are null where no bar lies
    between."""
    columns, points = points.columns, written(points, "points")
    rows = rows_until(points, index.times(), ["symbol"], after, "ts", "__from")
    if until:
        rows = rows_until(rows, index.times(), ["symbol"], until, "ts", "__to")
    else:
        rows = rows.join(index.last().select("symbol", F.col("n_bars").alias("__to")), "symbol", "left")
    reach = " or ".join(f"coalesce({c}, false)" for c in [f"k.low <= __p.`{low}`" if low else "false", f"k.high >= __p.`{high}`" if high else "false", "k.flag"])
    start = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__p")
    rows = rows.select("symbol", start, F.col("__from").alias("__at"), (F.col("__to") - 1).alias("__last"), (F.col("__from") < F.col("__to")).alias("__any"))
    rows = rows.withColumns({"__goal": F.lit(None).cast("bigint"), "__level": F.lit(-1)})
    kinds = {k.name: k.dataType for k in index.levels[0].schema["kids"].dataType.elementType}
    rows = rows.withColumns({f"path_{c}": F.lit(None).cast(kinds[c]) for c in ("low", "high")})
    rows = rows.withColumn("found", F.lit(None).cast(index.levels[0].schema["kids"].dataType.elementType))
    # what needs no row of a level gets a key that no row has, not one for all
    away = "-1 - pmod(xxhash64(__p), 100003)"

    def step(rows: DataFrame, level: int, active: str, node: str, begin: str) -> DataFrame:
        """Looks for the first kid from `begin` on that holds the end of the search, in the node of the rows where `active` holds."""
        rows = rows.withColumn("__node", F.expr(f"if({active}, {node}, {away})"))
        joined = rows.join(index.levels[level].withColumnRenamed("node", "__node"), ["symbol", "__node"], "left")
        end = f"__last div {FAN**level}"
        joined = joined.withColumn("__b", F.expr(f"cast({begin} - __node * {FAN} as int)")).withColumn("__e", F.expr(f"cast(least(size(kids) - 1, {end} - __node * {FAN}) as int)"))
        ahead = "if(__b <= __e, sequence(__b, __e), cast(array() as array<int>))"
        hit = f"get(filter({ahead}, j -> exists(slice(kids, j + 1, 1), k -> {reach} or k.i = {end})), 0)"
        joined = joined.withColumn("__hit", F.expr(f"if(kids is null, null, {hit})"))
        passed = f"if(kids is null or __b > __e, null, slice(kids, __b + 1, coalesce(__hit, __e + 1) - __b {'+ int(__hit is not null)' if level == 0 else ''}))"
        joined = joined.withColumn("__passed", F.expr(passed))
        new = {
            "path_low": F.expr("least(path_low, array_min(transform(__passed, k -> k.low)))"),
            "path_high": F.expr("greatest(path_high, array_max(transform(__passed, k -> k.high)))"),
            "__level": F.expr(f"if(__hit is not null, {level}, __level)"),
            "__goal": F.expr(f"if(__hit is not null, __node * {FAN} + __hit, __goal)"),
        }
        if level == 0:
            new["found"] = F.expr("if(__hit is not null, kids[__hit], found)")
        return joined.withColumns(new).select(*rows.columns).drop("__node")

    for level in range(len(index.levels)):
        rows = step(rows, level, "__any and __level < 0", f"__at div {FAN}", "__at")
        rows = rows.withColumn("__at", F.expr(f"__at div {FAN} + 1"))
    for level in reversed(range(len(index.levels) - 1)):
        rows = step(rows, level, f"__level = {level + 1}", "__goal", f"__node * {FAN}")
    return rows.select("__p.*", F.when(F.col("found").isNotNull(), F.col("found").dropFields("i")).alias("found"), "path_low", "path_high")
