"""Exact quantiles of large groups by repeated histograms.

A quantile lies between two order statistics. Each pass counts the values inside the range that still holds a wanted one in BINS parts and
goes on with the part that it lies in, whose own extremes are the next range, until the range is one value or holds at most BUFFER
rows, which are then sorted. A pass moves counts only, so no task holds a group, whatever its size or its repeated values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pieces import null_safe_join
from tidemark.scratch import discard, written

BINS, BUFFER = 1024, 10_000


def _own_names(keys: list[str]) -> tuple[list[str], list[Column]]:
    """(names that no other column here has, the keys under them)."""
    names = [f"__key{i}" for i in range(len(keys))]
    return names, [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], bins: int = BINS, buffer: int = BUFFER) -> DataFrame:
    """keys and one column for each {name: share}: the quantile between the two nearest values in proportion, as percentile() gives.
    Null and NaN count as missing; a key without values gets nulls. Rows are read once and kept as a written table."""
    v = F.col(value).cast("double")
    given, keys, own = keys, *_own_names(keys)
    base = written(rows.select(*own, F.when(~F.isnan(v), v).alias("v")), "values")
    whole = written(base.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    ranks = [F.floor(F.lit(float(p)) * (F.col("n") - 1)) for p in at.values()] + [F.ceil(F.lit(float(p)) * (F.col("n") - 1)) for p in at.values()]
    wanted = whole.where("n > 0").select(*keys, F.explode(F.array_distinct(F.array(*ranks))).alias("k"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), "n")
    wanted = written(wanted, "wanted")
    span = [*keys, "lo", "hi"]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > buffer)
        spans = wanted.where(wide).select(*span).distinct()
        if spans.isEmpty():
            break
        share = (F.col("v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
        part = F.when(F.col("v") == F.col("hi"), bins - 1).when(F.col("v") == F.col("lo"), 0)
        part = part.otherwise(F.least(F.lit(bins - 1), F.floor(F.nanvl(F.coalesce(share, F.lit(0.5)), F.lit(0.5)) * bins).cast("int")))
        counts = null_safe_join(base, spans, keys).where(inside).groupBy(*span, part.alias("part"))
        counts = counts.agg(F.count("*").alias("c"), F.min("v").alias("part_lo"), F.max("v").alias("part_hi"))
        before = Window.partitionBy(*span).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        place = F.col("k") - F.col("below") - F.col("before")
        found = null_safe_join(wanted.where(wide), counts, span).where((place >= 0) & (place < F.col("c")))
        found = found.select(*keys, "k", F.col("part_lo").alias("lo"), F.col("part_hi").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("n"))
        after = written(found.unionByName(wanted.where(~wide)), "wanted")
        discard(wanted)
        wanted = after
    few = wanted.where("lo < hi")
    ranked = null_safe_join(base, few.select(*span).distinct(), keys).where(inside)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*span).orderBy("v")) - 1)
    single = wanted.where("lo = hi").select(*keys, "k", F.col("lo").alias("v"))
    placed = null_safe_join(few.withColumn("place", F.col("k") - F.col("below")), ranked.select(*span, "place", "v"), [*span, "place"])
    values = single.unionByName(placed.select(*keys, "k", "v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("found"))
    out = null_safe_join(whole, values, keys, "left")
    columns = []
    for name, p in at.items():
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col("found")[F.floor(place)], F.col("found")[F.ceil(place)]
        rest = place - F.floor(place)
        columns.append(F.when(F.col("n") > 0, F.when(rest == 0, low).otherwise((1 - rest) * low + rest * high)).alias(name))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, given, strict=True)], *columns)


# --------------------------------------------------------------------------- Kendall's tau


def kendall(rows: DataFrame, keys: list[str], a: str, b: str, size: int = 1 << 16) -> DataFrame:
    """Kendall's tau-b of each key's pairs of numbers (rows with a null or NaN left out): keys and tau, null where a column has one value.

    Discordant pairs are inversions of b once the rows are in the order of (a, b). Rows are dealt in blocks by that order and in blocks by b.
    Pairs of one block of the order and pairs of one block by b are counted in tasks that hold one block; all others by running
    sums over the grid of block counts. Ties are counted by value.
    """
    import numpy as np
    import pyarrow as pa

    from tidemark.operators.orderstats import WaveletMatrix

    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    given, keys, own = keys, *_own_names(keys)
    base = rows.select(*own, number(a).alias("a"), number(b).alias("b")).where("a is not null and b is not null")
    base = written(base, "pairs")
    parts = max(1, math.ceil(base.count() / size))
    base = base.repartitionByRange(parts, *keys, "a", "b").withColumn("p", F.spark_partition_id())
    base = written(base, "pairs")
    base = written(base.repartitionByRange(parts, *keys, "b").withColumn("q", F.spark_partition_id()), "pairs")

    def inversions(table: pa.Table, first: str) -> int:
        """Pairs of a table's rows, in the order of (first, b), of which the earlier has the larger b."""
        x, y = table.column(first).to_numpy(), table.column("b").to_numpy()
        y = y[np.lexsort((y, x))]
        tree, at = WaveletMatrix(y), np.arange(len(y))
        return int((at - tree.below(np.zeros_like(at), at, tree.rank + 1)).sum())

    def counted(first: str):
        schema = base.select(*keys, F.lit(0).cast("bigint").alias("d")).schema

        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([*[table.column(k).slice(0, 1) for k in keys], pa.array([inversions(table, first)])], schema.names)

        return run, schema

    same_p = base.groupBy(*keys, "p").applyInArrow(*counted("a"))
    same_q = base.groupBy(*keys, "q").applyInArrow(*counted("p"))  # within a block p by b, so only pairs of two blocks count
    cells = base.groupBy(*keys, "p", "q").agg(F.count("*").alias("c"))
    axes = cells.groupBy(*keys).agg(F.collect_set("p").alias("ps"), F.collect_set("q").alias("qs"))
    grid = axes.select(*keys, F.explode("ps").alias("p"), "qs").select(*keys, "p", F.explode("qs").alias("q"))
    grid = null_safe_join(grid, cells, [*keys, "p", "q"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    grid = grid.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grid = grid.withColumn("above", F.coalesce(F.sum("before").over(Window.partitionBy(*keys, "p").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    discordant = same_p.unionByName(same_q).unionByName(grid.select(*keys, (F.col("c") * F.col("above")).alias("d"))).groupBy(*keys).agg(F.sum("d").alias("d"))
    twos = F.sum(F.col("c") * (F.col("c") - 1) / 2)
    out = discordant
    for name, by in (("n0", []), ("na", ["a"]), ("nb", ["b"]), ("nab", ["a", "b"])):
        ties = base.groupBy(*keys, *by).agg(F.count("*").cast("double").alias("c")).groupBy(*keys).agg(twos.alias(name))
        out = null_safe_join(out, ties, keys)
    concordant = F.col("n0") - F.col("na") - F.col("nb") + F.col("nab") - F.col("d")
    below = F.sqrt((F.col("n0") - F.col("na")) * (F.col("n0") - F.col("nb")))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, given, strict=True)], ((concordant - F.col("d")) / F.nullif(below, F.lit(0.0))).alias("tau"))
