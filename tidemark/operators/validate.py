"""Fit and transform, thresholds, time splits, walk-forward windows and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selectk import quantiles


def fit(rows: DataFrame, factors: list[str], keys: list[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per (keys and) factor: winsor bounds, and the mean, population deviation and missing rate after clipping."""
    keys = keys or []
    long = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot(keys, factors, "factor", "value")
    by = [*keys, "factor"]
    bounds = quantiles(long, by, "value", {"low": low, "high": high})
    clipped = long.join(bounds, by).withColumn("c", F.when(F.col("value").isNotNull(), F.least(F.greatest("value", "low"), F.col("high"))))
    return clipped.groupBy(*by).agg(
        F.first("low").alias("low"), F.first("high").alias("high"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate")
    )


def standardise(rows: DataFrame, ids: list[str], factors: list[str], params: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long form with z by stored parameters (one small row per factor); null where the value is or the deviation is 0."""
    keys = keys or []
    cols = list(dict.fromkeys([*ids, *keys]))
    long = rows.select(*cols, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot(cols, factors, "factor", "value")
    out = long.join(params.select(*keys, "factor", "low", "high", "mean", "std"), [*keys, "factor"])
    clipped = F.least(F.greatest(F.col("value"), F.col("low")), F.col("high"))
    z = F.when(F.col("value").isNotNull(), (clipped - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    return out.select(*cols, "factor", "value", z.alias("z"))


def family_scores(z: DataFrame, ids: list[str], families: dict[str, tuple[str, int]]) -> DataFrame:
    """Mean of direction * z over each family's factors {factor: (family, direction)}, nulls left out."""
    family, direction = F, F
    for factor, (name, d) in families.items():
        family, direction = family.when(F.col("factor") == factor, name), direction.when(F.col("factor") == factor, d)
    rows = z.withColumn("family", family.otherwise(None)).withColumn("d", direction.otherwise(None)).where("family is not null")
    return rows.groupBy(*ids, "family").agg(F.avg(F.col("z") * F.col("d")).alias("score"), F.count("z").alias("n_factors"))


def thresholds(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    return quantiles(rows, keys, value, {f"q{round(100 * p)}": p for p in shares})


def gate_threshold(rows: DataFrame, keys: list[str], value: str, keep: float, direction: int) -> DataFrame:
    """The threshold that keeps that share of rows on the good side."""
    return quantiles(rows, keys, value, {"threshold": 1 - keep if direction > 0 else keep}).withColumn("direction", F.lit(direction))


def time_split(rows: DataFrame, keys: list[str], order: list[str], shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """split: train, validation or test, by position in time."""
    w = Window.partitionBy(*keys)
    pos = (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)
    a, b = shares[0], shares[0] + shares[1]
    return rows.withColumn("__p", pos).withColumn("split", F.when(F.col("__p") < a, "train").when(F.col("__p") < b, "validation").otherwise("test")).drop("__p")


def walk_forward(rows: DataFrame, ts: str, train_months: int, test_months: int, step_months: int) -> DataFrame:
    """Windows over the rows' time span: window_id, train_start, test_start, test_end. As many rows as windows."""
    span = rows.agg(F.trunc(F.min(ts), "month").alias("a"), F.trunc(F.max(ts), "month").alias("b"))
    first = F.add_months("a", train_months)
    starts = F.sequence(first, F.greatest(first, F.add_months("b", 1 - test_months)), F.expr(f"interval {step_months} month"))
    out = span.where(first <= F.add_months("b", 1 - test_months)).select(F.posexplode(starts).alias("window_id", "test_start"))
    return out.select("window_id", F.add_months("test_start", -train_months).alias("train_start"), "test_start", F.add_months("test_start", test_months).alias("test_end"))


def in_windows(rows: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """One row per row and window that holds it, with part train or test. The windows are few, one per step of months, so
    a range join with them is a broadcast."""
    day = F.to_date(ts)
    held = rows.join(F.broadcast(windows), (day >= windows["train_start"]) & (day < windows["test_end"]))
    return held.withColumn("part", F.when(day < F.col("test_start"), "train").otherwise("test"))


def stability(rows: DataFrame, factor: list[str], groups: list[str], value: str) -> DataFrame:
    """Edge (rows' top20 less bottom20 flag means) per factor and group of each grouping column, and per grouping the share
    of groups whose edge has the sign of the whole's."""
    def edge(keys: list[str], source: DataFrame, name: str) -> DataFrame:
        hi, lo = F.avg(F.when(F.col("top20"), F.col(value))), F.avg(F.when(F.col("bottom20"), F.col(value)))
        return source.groupBy(*keys).agg((hi - lo).alias(name))

    whole = edge(factor, rows, "whole_edge")
    long = rows.select(*factor, "top20", "bottom20", value, F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("grp")) for g in groups])).alias("x"))
    long = long.select(*factor, "top20", "bottom20", value, "x.grouping", "x.grp")
    parts = edge([*factor, "grouping", "grp"], long, "edge").join(whole, factor) if factor else edge(["grouping", "grp"], long, "edge").join(F.broadcast(whole))
    same = F.avg(F.when(F.col("edge").isNotNull(), (F.signum("edge") == F.signum("whole_edge")).cast("double")))
    return parts.groupBy(*factor, "grouping").agg(F.count("edge").alias("n_groups"), same.alias("same_direction"), F.min("edge").alias("worst"), F.first("whole_edge").alias("whole_edge"))


def horizon_consistency(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Over rows (horizon, edge): share with the sign of the longest horizon's, the best horizon, and a pattern."""
    rows = edges.groupBy(*keys).agg(
        F.max_by("edge", "horizon").alias("last_edge"),
        F.min_by("edge", "horizon").alias("first_edge"),
        F.max_by("horizon", F.struct(F.abs("edge"), "horizon")).alias("best_horizon"),
        F.collect_list("edge").alias("all_edges"),
    )
    same = F.aggregate("all_edges", F.lit(0), lambda a, x: a + F.when(F.signum(x) == F.signum("last_edge"), 1).otherwise(0)) / F.nullif(F.size("all_edges"), F.lit(0))
    pattern = F.when(F.signum("first_edge") != F.signum("last_edge"), "reverses").when(F.abs("last_edge") > F.abs("first_edge"), "grows").otherwise("decays")
    return rows.withColumn("consistency", same).withColumn("pattern", pattern).drop("all_edges")


def eligible(evidence: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that every evidence table holds."""
    out = evidence[0].select(*keys).distinct()
    for one in evidence[1:]:
        out = out.join(one.select(*keys).distinct(), keys, "left_semi")
    return out


def ladder(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; null conditions do not."""
    out = F
    for condition, label in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), label)
    return out.otherwise(default)


def cross_asset(rows: DataFrame, discovery: Column, ids: list[str], factors: dict[str, tuple[str, int]], value: str, tie: str) -> DataFrame:
    """Every symbol scored by parameters fitted on the discovery rows alone: per symbol and family the edge of the score's top over
    its bottom fifth, and whether it has the discovery's sign. rows: one per ids, with symbol and value."""
    params = fit(rows.where(discovery), list(factors))
    scores = family_scores(standardise(rows, [*ids, "symbol"], list(factors), params), [*ids, "symbol"], factors)
    scored = scores.join(rows.select(*ids, value, discovery.alias("__d")), ids).where(F.col("score").isNotNull() & F.col(value).isNotNull())
    part = Window.partitionBy("symbol", "family")
    share = (F.row_number().over(part.orderBy("score", tie)) - 0.5) / F.count("*").over(part)
    scored = scored.withColumn("__p", share)
    edge = F.avg(F.when(F.col("__p") > 0.8, F.col(value))) - F.avg(F.when(F.col("__p") <= 0.2, F.col(value)))
    out = scored.groupBy("symbol", "family").agg(F.count("*").alias("n"), F.max("__d").alias("discovery"), edge.alias("edge"))
    found = out.where("discovery").groupBy("family").agg(F.avg("edge").alias("__e"))
    return out.join(found, "family", "left").withColumn("same_sign", F.signum("edge") == F.signum("__e")).drop("__e")
