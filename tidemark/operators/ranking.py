"""Ranks, quintiles, score groups and monotonicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """rank_first (ties by `tie`), rank_average and rank_pct (rank_average over the count) of non-null values."""
    part = Window.partitionBy(*keys, F.col(value).isNull())
    w = part.orderBy(value)
    average = F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2
    known = F.col(value).isNotNull()
    out = rows.withColumn("rank_first", F.when(known, F.row_number().over(part.orderBy(value, tie)))).withColumn("rank_average", F.when(known, average))
    return out.withColumn("rank_pct", F.when(known, F.col("rank_average") / F.count("*").over(part)))


def quintiles(rows: DataFrame, keys: list[str], value: str, tie: str, name: str = "quintile", least: int = 50, distinct: int = 20, q: int = 5) -> DataFrame:
    """1..q by first-rank cut at equal shares of the rank range; null where the value is null or a key has under `least`
    rows or `distinct` values (ties in rank go by `tie`)."""
    part = Window.partitionBy(*keys, F.col(value).isNull())
    rn = F.row_number().over(part.orderBy(value, tie))
    n = F.count("*").over(part)
    kinds = F.size(F.collect_set(value).over(part)) if distinct <= 1 else F.max(F.col("__d")).over(part)
    rows = rows.withColumn("__d", F.dense_rank().over(part.orderBy(value)))
    cut = F.greatest(F.lit(1), F.ceil((rn - 1) * q / F.nullif(n - 1, F.lit(0)))).cast("int")
    return rows.withColumn(name, F.when(F.col(value).isNotNull() & (n >= least) & (kinds >= distinct), cut)).drop("__d")


def score_group(pct: Column) -> Column:
    out = F.when(pct.isNull(), "invalid").when(pct <= 0.2, "bottom20").when(pct <= 0.4, "bottom40").when(pct > 0.8, "top20")
    return out.when((pct >= 0.6) & (pct < 0.8), "top40").otherwise("middle20")


def extreme_masks(rows: DataFrame, keys: list[str], value: str, tie: str, least: int = 30) -> DataFrame:
    """top20 and bottom20 flags by rank share, false where a key has under `least` rows."""
    rows = ranks(rows, keys, value, tie)
    enough = F.count(value).over(Window.partitionBy(*keys)) >= least
    rows = rows.withColumn("top20", F.coalesce(enough & (F.col("rank_pct") >= 0.8), F.lit(False)))
    return rows.withColumn("bottom20", F.coalesce(enough & (F.col("rank_pct") <= 0.2), F.lit(False))).drop("rank_first", "rank_average", "rank_pct")


def percentile_of(values: DataFrame, reference: DataFrame, keys: list[str], value: str, ref: str) -> DataFrame:
    """values with pct: 100 * share of the key's reference values at or below value (null without reference)."""
    a = values.select(*keys, F.col(value).alias("__x"), F.lit(1).alias("__s"), F.struct(*values.columns).alias("__row"))
    b = reference.where(F.col(ref).isNotNull()).select(*keys, F.col(ref).cast("double").alias("__x"), F.lit(0).alias("__s"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.withColumn("__x", F.col("__x").cast("double")).unionByName(b)
    w = Window.partitionBy(*keys).orderBy("__x", "__s").rowsBetween(Window.unboundedPreceding, 0)
    is_ref = (F.col("__s") == 0).cast("int")
    both = both.withColumn("__n", F.sum(is_ref).over(w)).withColumn("__t", F.sum(is_ref).over(Window.partitionBy(*keys)))
    pct = F.when(F.col("__x").isNotNull() & (F.col("__t") > 0), 100.0 * F.col("__n") / F.col("__t"))
    return both.where("__s = 1").select("__row.*", pct.alias("pct"))


def monotonicity(groups: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Steps against the end-to-end direction, consistency and status over ordered group values."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = groups.withColumn("__d", F.col(value) - F.lag(value).over(w)).withColumn("__e", F.last(value).over(whole) - F.first(value).over(whole))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_groups"),
        F.first("__e").alias("spread"),
        F.count_if(F.signum("__d") * F.signum("__e") < 0).alias("violations"),
    )
    out = out.withColumn("consistency", 1 - F.col("violations") / F.nullif(F.col("n_groups") - 1, F.lit(0)))
    status = F.when(F.col("n_groups") < 5, "insufficient_sample").when(F.col("violations") == 0, "monotonic").when(F.col("violations") == 1, "mostly_monotonic")
    return out.withColumn("status", status.otherwise("not_monotonic"))


def rank_overlap(rows: DataFrame, keys: list[str], a: str, b: str, cut: float = 0.8) -> DataFrame:
    """Share of a's top rows that are b's top rows too, by rank shares in columns a and b."""
    both = F.avg(F.when(F.col(a) >= cut, (F.col(b) >= cut).cast("double")))
    return rows.groupBy(*keys).agg(F.count_if(F.col(a) >= cut).alias("n_top"), both.alias("overlap"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of the id (a sampling operator)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), ident), ident).limit(n)
