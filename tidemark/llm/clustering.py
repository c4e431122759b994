"""Centroid clustering in integers: Lloyd's rounds whose nearest centroid is found by a bisector tournament.

For two centroids i < j a vector x is nearer to j exactly if 2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2, so the pair's normal and
threshold are computed once a round and each of k - 1 tests is the sign of one linear form: the winner so far meets
the next number, and zero favours the smaller number. Only the winner's distance is computed. A task assigns its rows
and returns one row of exact sums per cluster; the new centroids are the floors of the exact means. Nothing but k rows
reaches the driver.

Null vectors, those of another length and those with null or non-finite components are left out. A null vec_id takes part, comes
last among the first centroids and is returned as null; rows that repeat count each. With fewer rows than k each row
is a centroid; an empty table gives no rows. Components beyond 2^90 in size count as 2^90, and distances and their sums that a
long can't hold as the largest long. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.vectors import EXACT, embedding_of, integers, matrix, python_integers, to_longs

K, ROUNDS, WIDTH, SEED = 40, 5, 64, "2:"
MOST = float(1 << 90)
#: Rows whose tests run together.
BATCH = 1024


class Bisectors:
    """The planes between each two of some centroids (rows of integers)."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, object)
        norms = (exact * exact).sum(1)
        self.centroids = exact
        self.normals = 2 * (exact[None, :, :] - exact[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]
        self.most = float(np.abs(exact).max())
        self.small = self.most**2 * 256 * exact.shape[1] < EXACT
        if self.small:
            self.centroids, self.normals, self.thresholds = (a.astype(float) for a in (self.centroids, self.normals, self.thresholds))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, exact squared distance) of each row of whole doubles."""
        most = max(float(np.abs(x).max(initial=0)), self.most)
        small = self.small and most**2 * 4 * x.shape[1] < EXACT
        normals, thresholds, centroids = self.normals, self.thresholds, self.centroids
        if not small:
            x, normals, thresholds, centroids = (python_integers(a) for a in (x, normals, thresholds, centroids))
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(centroids)):
            side = np.einsum("ij,ij->i", normals[winner, j], x) if small else (normals[winner, j] * x).sum(1)
            winner[np.asarray(side > thresholds[winner, j], bool)] = j
        gap = x - centroids[winner]
        return winner, to_longs((gap * gap).sum(1))


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components) of a batch's whole vectors of that width, in pieces."""
    whole, offsets, values = integers(batch.column("v"))
    rows = np.flatnonzero(whole & (np.diff(offsets) == width))
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        yield part, np.clip(matrix(offsets, values, part, width), -MOST, MOST)


def first_centroids(rows: DataFrame, k: int, width: int, seed: str) -> list[list[int]]:
    """The components of the k whole vectors of smallest hash; equal hashes by components."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _vectors(batch, width):
                v = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(part)), v], ["h", "v"])

    hashed = rows.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    found = hashed.mapInArrow(whole, "h string, v array<double>").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in found]


def means(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    width, planes = len(centroids[0]), Bisectors(centroids)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), width), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x in _vectors(batch, width):
                winner, _ = planes.nearest(x)
                counts += np.bincount(winner, minlength=len(counts))
                exact = len(x) * np.abs(x).max() < EXACT
                own = np.zeros(sums.shape, float if exact else object)
                np.add.at(own, winner, x if exact else python_integers(x))
                sums += python_integers(own) if exact else own
        used = np.flatnonzero(counts)
        s = pa.array([[Decimal(v) for v in sums[c]] for c in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), s], ["cluster", "n", "s"])

    partial = rows.select("v").mapInArrow(total, "cluster int, n bigint, s array<decimal(38,0)>")
    found = partial.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [list(c) for c in centroids]
    for r in found.collect():  # k x width rows
        new[r.cluster][r.i] = int(r.s) // r.n
    return new


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED) -> list[list[int]]:
    """The centroids of rows(vec_id, v) after some rounds; empty clusters keep theirs."""
    centroids = first_centroids(rows, k, width, seed)
    for _ in range(rounds if centroids else 0):
        centroids = means(rows, centroids)
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of each whole vector of the centroids' length in rows(vec_id, v)."""
    planes, width = Bisectors(centroids), len(centroids[0])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _vectors(batch, width):
                winner, distance = planes.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(part)), pa.array(winner, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    return rows.select("vec_id", "v").mapInArrow(nearest, "vec_id bigint, cluster int, distance bigint")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """Per whole vector of embeddings(vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), embedding_of(embeddings).alias("v"))
    centroids = fit(rows, k, rounds, width, seed)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], f"vec_id bigint, distance bigint, {schema}").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assigned = materialize(assign(rows, centroids), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    top = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, min(s, top), min(sum(sums.values()), top), digest[c]) for c, s in sums.items()]
    # at most k rows
    found = assigned.join(F.broadcast(spark.createDataFrame(table, schema)), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED) -> str:
    """All distances in DuckDB's SQL, for small tables."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), x) - 1 AS cluster, x AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}' || vec_id), x) <= {k})""",
    ]
    for t in range(rounds + 1):
        d = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, vec_id, x, cluster, d FROM (SELECT r, vec_id, x, cluster, CAST({d} AS BIGINT) AS d FROM v, c{t})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
  FROM (SELECT cluster, i, sum(y) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, {width + 1})) AS i FROM a{t}) GROUP BY ALL)) GROUP BY cluster),
c{t + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{t} LEFT JOIN m{t} USING (cluster))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
