"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Vectors are compared only with vectors of the same, non-null label and of the same length. Equal vectors are collapsed
and weighted first. Centroids are fitted for each length on at most SAMPLE vectors of it; every vector then belongs to its
nearest cell and probes those cells of smaller number that a vector within the cosine could belong to (its distance to
the plane between the two centroids is at most the chord of the cosine), the nearest PROBES of them, or with probes=None all,
which loses no link. Two cells' vectors so meet in the cell of the smaller number, once. A cell's members are dealt in
blocks of about BLOCK_BYTES; a task multiplies one pair of blocks and returns link counts and a spanning forest of
the links, never pairs.

Null and zero vectors and those with null or non-finite components link with nothing and are kept, as
do vectors with a null label; vectors are scaled by a power of two first, so that neither very large nor very small ones
lose their norm. A null vec_id takes part, is never a component's id while another id exists, and is not
kept. Repeated rows link with each other. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, scratch_scope, skew_join

SAMPLE = 8192
ROWS_PER_CELL = 16_384
MOST_CELLS = 4096
PROBES = 4
#: Bytes of a block's vectors as doubles; a task holds two blocks.
BLOCK_BYTES = 8 << 20
#: Most rows of small tables (cells, tasks) that are broadcast.
SMALL = 200_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of norm one, by way of a power of two that keeps the squares in range."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    vectors = np.ldexp(vectors, -power)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids by Lloyd's rounds on cosine; an empty cell restarts at the worst-served vector."""
    vectors = unit(vectors)
    rng = np.random.default_rng(seed)
    k = min(k, len(vectors))
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        scores = vectors @ centroids.T
        own = scores.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        poor = np.flatnonzero(size < 1e-9)
        sums[poor] = vectors[np.argsort(scores.max(1))[: len(poor)]]
        centroids = unit(sums)
    return centroids


def cells_of(vectors: np.ndarray, centroids: np.ndarray, cosine: float, probes: int | None = PROBES) -> tuple[np.ndarray, list[np.ndarray]]:
    """(nearest cell, probed cells of smaller number, nearest first) of each unit vector."""
    scores = vectors @ centroids.T
    home = scores.argmax(1)
    top = scores[np.arange(len(home)), home]
    between = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    near = (top[:, None] - scores) <= np.sqrt(2 - 2 * cosine) * between[home] + 1e-9
    near &= np.arange(len(centroids)) < home[:, None]
    probed = []
    for mine, score in zip(near, scores, strict=True):
        cells = np.flatnonzero(mine)
        probed.append(cells[np.argsort(-score[cells], kind="stable")][:probes])
    return home, probed


def _valid(vector: str) -> str:
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"{vector} is not null and size({vector}) > 0 and {finite} and exists({vector}, x -> x <> 0)"


def _links(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One task: block `one` against block `two` of a cell, or against itself if there is no other."""
    out = {"node": [], "n": [], "other": []}
    rows = rows.sort_values("node")
    one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
    within = bool(rows["within"].iloc[0])
    if within:
        two = one
    if len(one) and len(two):
        x, y = (unit(np.stack(side["v"].to_numpy()).astype(float)) for side in (one, two))
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        wx, wy = one["weight"].to_numpy(), two["weight"].to_numpy()
        nx, ny = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        nodes, shift = (a, 0) if within else (np.concatenate([a, b]), len(a))
        group = np.arange(len(nodes))  # the smallest place that each is connected with so far
        for at in range(0, len(a), 256):
            hit = x[at : at + 256] @ y.T >= cosine
            if within:
                hit &= a[at : at + 256, None] != b[None, :]
            nx[at : at + 256] += hit @ wy
            if not within:
                ny += wx[at : at + 256] @ hit
            for i in np.flatnonzero(hit.any(1)):
                own = group[at + i]
                met = group[np.flatnonzero(hit[i]) + shift]
                if (met != own).any():
                    joined = np.unique(np.append(met, own))
                    group[np.isin(group, joined[1:])] = joined[0]
        n = nx if within else np.concatenate([nx, ny])
        linked = np.flatnonzero(n)
        out = {"node": nodes[linked], "n": n[linked], "other": nodes[group[linked]]}
    return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, vec_id, k1, k2 with null keys where nothing can link; classes of equal vectors)."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes to move
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v"))
    ok = F.col("label").isNotNull() & F.expr(_valid("v"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("k1", F.when(ok, F.xxhash64("label", "v"))).withColumn("k2", F.when(ok, F.xxhash64("v", "label", F.lit(1))))
    rows = materialize(rows, "vectors")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("rid").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    return rows, materialize(classes, "classes")


def _small(df: DataFrame, name: str) -> DataFrame:
    """df written, with a broadcast hint if it has at most SMALL rows."""
    df = materialize(df, name)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def fit(classes: DataFrame, rows_per_cell: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors that fills more than one cell."""
    sizes = classes.groupBy(F.size("v").alias("width")).count().where(F.col("count") > rows_per_cell).collect()
    out = {}
    for width, n in sizes:
        sample = classes.where(F.size("v") == width).orderBy(F.xxhash64("k1", "k2"), "node").limit(SAMPLE).select("node", "v").toPandas()
        vectors = np.stack(sample.sort_values("node")["v"].to_numpy()).astype(float)
        out[width] = spherical_kmeans(vectors, min(MOST_CELLS, -(-n // rows_per_cell)))
    return out


def find_links(classes: DataFrame, cosine: float, probes: int | None = PROBES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """node, n (rows linked in one task) and other (a node it is connected with), one row per node and task."""
    shared = classes.sparkSession.sparkContext.broadcast(fit(classes, rows_per_cell))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                v = [np.asarray(x, float) for x in part.column("v").to_pylist()]
                width = np.array([len(x) for x in v])
                home, probed = np.zeros(len(v), np.int64), [np.zeros(0, np.int64)] * len(v)
                for w in np.unique(width):
                    if w in shared.value:
                        mine = np.flatnonzero(width == w)
                        home[mine], cells = cells_of(unit(np.stack([v[i] for i in mine])), shared.value[w], cosine, probes)
                        for i, c in zip(mine, cells, strict=True):
                            probed[i] = c
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": part.column("node"),
                        "label": part.column("label"),
                        "weight": part.column("weight"),
                        "v": part.column("v"),
                        "width": pa.array(width, pa.int64()),
                        "home": pa.array(home, pa.int64()),
                        "probed": pa.array(probed, pa.list_(pa.int64())),
                    }
                )

    rows = classes.select("node", F.col("label").cast("string").alias("label"), "weight", "v")
    schema = rows.select("*", F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("home"), F.expr("array(0L)").alias("probed")).schema
    rows = materialize(rows.mapInArrow(assign, schema), "assigned")
    places = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("role"))), F.transform("probed", lambda c: F.struct(c.alias("cell"), F.lit(1).alias("role"))))
    members = rows.select("node", "label", "width", "weight", "v", F.inline(places))
    key = ["label", "width", "cell"]
    most = f"greatest(256, {BLOCK_BYTES} div (8 * width))"
    sizes = members.groupBy(*key).agg(*[F.count_if(F.col("role") == r).alias(f"rows{r}") for r in (0, 1)])
    sizes = _small(sizes.select(*key, *[F.expr(f"ceil(rows{r} / {most})").alias(f"blocks{r}") for r in (0, 1)]), "cells")
    # blocks of a cell's own rows against each other and against blocks of the rows that probe the cell
    own = sizes.where("blocks0 > 0").select(*key, F.explode(F.expr("sequence(0L, blocks0 - 1)")).alias("i"), "blocks0", "blocks1")
    inner = own.select(*key, "i", F.explode(F.expr("sequence(i, blocks0 - 1)")).alias("j"), F.lit(0).alias("kind"))
    outer = own.where("blocks1 > 0").select(*key, "i", F.explode(F.expr("sequence(0L, blocks1 - 1)")).alias("j"), F.lit(1).alias("kind"))
    tasks = inner.unionByName(outer).withColumn("within", F.expr("kind = 0 and i = j"))
    one = tasks.select(*key, "i", "j", "kind", "within", F.lit(0).alias("side"), F.lit(0).alias("role"), F.col("i").alias("block"))
    two = tasks.where("not within").select(*key, "i", "j", "kind", "within", F.lit(1).alias("side"), F.col("kind").alias("role"), F.col("j").alias("block"))
    sides = _small(one.unionByName(two), "tasks")
    blocks = F.when(F.col("role") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))
    dealt = members.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1)))).drop("blocks0", "blocks1")
    work = dealt.join(sides, [*key, "role", "block"])
    return work.groupBy(*key, "i", "j", "kind").applyInPandas(lambda pdf: _links(pdf, cosine), "node bigint, n bigint, other bigint")


def deduplicate(embeddings: DataFrame, cosine: float = 0.98, probes: int | None = PROBES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Per row of embeddings(vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    rows, classes = classes_of(embeddings)
    with scratch_scope() as keep:
        found = materialize(find_links(classes, cosine, probes, rows_per_cell), "found")
        keep(found)
    comps = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("k1", "k2", "node", "weight", "low").join(comps, "node", "left").join(counts, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")), "named")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = skew_join(named, low, "component").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = skew_join(rows.select("vec_id", "k1", "k2"), of_class.withColumnRenamed("k2", "k2_"), "k1", "left").where("k2 is null or k2 = k2_")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle_sql(cosine: float = 0.98) -> str:
    """All pairs in DuckDB's SQL, for small tables."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
       AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= {cosine}),
c AS (SELECT r, r AS root FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.r WHERE c.root < e.b),
k AS (SELECT r, min(root) AS root FROM c GROUP BY r),
m AS (SELECT root, min(vec_id) AS component_id FROM k JOIN v USING (r) GROUP BY root),
n AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN k USING (r) JOIN m USING (root) LEFT JOIN n USING (r)
"""
