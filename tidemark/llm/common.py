"""Helpers shared by the training-data operators: shared scratch tables, skew-safe joins, connected
components and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- scratch tables


_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, as in tests, a local session gets a
    temporary folder of its own; on a cluster that would not be shared, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _LOCAL[context.applicationId]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch_scope():
    """Tables that materialize() writes inside are deleted at the end, except those handed to the yielded function, which
    go to the scope around it. What is returned may read kept tables only."""
    written: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCOPES.append(written)
    try:
        yield kept.append
    finally:
        _SCOPES.pop()
    for df in written:
        if not any(df is k for k in kept):
            discard(df)
    if _SCOPES:
        _SCOPES[-1].extend(kept)
    if written:
        release(written[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets go of the broadcasts, shuffles, plans and generated classes of queries that are over: the driver drops them only when its JVM
    collects garbage, which by itself waits until the heap is full."""
    spark._jvm.System.gc()


def rows_of(table: DataFrame) -> int:
    """The rows of a table made by materialize(), counted once."""
    if not hasattr(table, "_rows"):
        table._rows = table.count()
    return table._rows


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df by writing it to the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


# --------------------------------------------------------------------------- joins and components


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on key in which adaptive execution can split a hot key.

    A side that an aggregate has already dealt by the key has no exchange of its own, so Spark could not
    split the other side's hot partition; a second, derived key makes both sides exchange.
    """
    tag = F.xxhash64(F.col(key)).alias("__tag")
    return left.select("*", tag).join(right.select("*", tag), [key, "__tag"], how).drop("__tag")


def without(rows: DataFrame, dropped: DataFrame, key: str | list[str], most: int = 200_000) -> DataFrame:
    """rows whose key is not in dropped(key). Up to `most` keys are broadcast, so that rows stay where they are;
    beyond it both sides are shuffled. A null key stays."""
    dropped = materialize(dropped, "dropped")
    if rows_of(dropped) <= most:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])


def connected_components(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set is a forest of stars. Each step is a
    min-aggregate and a join (by broadcast while there are few edges); nothing is gathered per node, and every
    round is cut by a written table. The steps go on until nothing changes.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def attach(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
        return rows.join(F.broadcast(low), "u") if n <= small else skew_join(rows, low, "u")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    before = mark(e)
    for _ in itertools.count():
        n = before[0]
        if not n:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(both, low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = attach(large, low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e, after = new, mark(new)
        if after == before:
            break
        before = after
    release(edges.sparkSession)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of df and `row`, a struct of all its columns: whatever names a table has, an operator's own can't meet them."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of packed() again, those in `changed` with new values."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# --------------------------------------------------------------------------- vectorised word hashing

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        m = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", _INVERSE)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                _POW[key] = np.multiply.accumulate(x)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, max_bytes: int = 1 << 18, max_rows: int = 512):
    """Yields (first row, last row + 1, bytes, row bounds in them): the rows of an Arrow string column in
    pieces of about max_bytes, so that what is derived from a piece stays small; a row is never cut."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for start in range(0, len(texts), max_rows):
        part = texts.slice(start, max_rows).cast(pa.large_string()).fill_null("")
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64, n + 1, part.offset * 8)
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield start + at, start + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def find_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE):
    """(starts, ends, first word of each row and the total) of the maximal runs of non-separators, by row."""
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: differences of one running polynomial sum."""
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * q[starts])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k consecutive words of one document; fewer words are one shingle, none is none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        # unrelated odd factors: equal steps would let words trade places
        factors = mix(np.arange(1, min(n, k) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
        if n < k:
            return mix(np.array([(words * factors).sum() + np.uint64(n) * _BASE], np.uint64))
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += words[j : n - k + 1 + j] * factors[j]
        return mix(total)
