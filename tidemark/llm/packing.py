"""Conflict-constrained best-fit packing of documents into sequences of CAPACITY words.

A document longer than the capacity is cut into full pieces, which fill a bin each, and a rest. A bin holds at most
one rest or document of a source and of a duplicate cluster (equal normalised texts); null sources conflict with
nothing. Open bins are kept in the order of their residual capacity and carry bitmaps of their
sources and clusters; the search starts at the smallest residual that fits and goes on to the next larger one until a bin
is compatible, which is then the tightest compatible bin. Items come in the order of decreasing length.

Items without their texts are dealt by a hash of the item into runs of about RUN items, as many as the count of all
items asks for and whatever the session's settings; each run is packed by itself, so memory is bounded whatever a key's
share. Rows that repeat an item are counted first and dealt in chunks of at most CHUNK copies, so no run holds all of
them; a hot source only makes its runs use more bins.
Null and empty texts have no words and are not packed; null ids are packed; repeated rows are packed each (they
conflict with one another); ids of any size keep their value; extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_of

CAPACITY = 2048
RUN = 2048
CHUNK = 64

SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("bin_id", pa.string()), ("offset", pa.int32()), ("n_words", pa.int32())])


def items(documents: DataFrame) -> DataFrame:
    """doc_id, source, cluster and n_words of each document that has words."""
    words = F.filter(F.split(text_of("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("w"))
    cluster = F.xxhash64(F.transform("w", F.lower))
    return rows.select("doc_id", "source", cluster.alias("cluster"), F.size("w").alias("n_words")).where("n_words > 0")


class BestFit:
    """Open bins of one run, in the order of (residual, number)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []
        self.bins: list[list] = []  # fill, bitmap of sources, bitmap of clusters
        self.sources: dict = {}
        self.clusters: dict = {}

    def _bit(self, table: dict, key) -> int:
        return 0 if key is None else 1 << table.setdefault(key, len(table))

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset) of an item; it opens a bin if no open one is compatible."""
        s, c = self._bit(self.sources, source), self._bit(self.clusters, cluster)
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            held = self.bins[self.open[at][1]]
            if not held[1] & s and not held[2] & c:
                break
            at += 1
        if at < len(self.open):
            number = self.open.pop(at)[1]
        else:
            number = len(self.bins)
            self.bins.append([0, 0, 0])
        held = self.bins[number]
        offset, held[0], held[1], held[2] = held[0], held[0] + size, held[1] | s, held[2] | c
        if held[0] < self.capacity:
            insort(self.open, (self.capacity - held[0], number))
        return number, offset


def pack_run(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, piece, bin from 0, offset, n_words) of the items (doc_id, source, cluster, n_words) of a run."""
    fit, out, rests = BestFit(capacity), [], []
    for doc_id, source, cluster, n in sorted(rows, key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1] is None, x[1] or "", x[2])):
        full, rest = divmod(n, capacity)
        for piece in range(full):
            number, offset = fit.place(capacity, None, None)
            out.append((doc_id, piece, number, offset, capacity))
        if rest:
            rests.append((rest, doc_id, full, source, cluster))
    for rest, doc_id, piece, source, cluster in sorted(rests, key=lambda x: -x[0]):
        number, offset = fit.place(rest, source, cluster)
        out.append((doc_id, piece, number, offset, rest))
    return out


def deal(documents: DataFrame, run: int = RUN) -> DataFrame:
    """run, doc_id, source, cluster, n_words and copies of the items, one row for each chunk of equal ones."""
    key = ["doc_id", "source", "cluster", "n_words"]
    rows = materialize(items(documents).groupBy(*key).agg(F.count("*").alias("n")), "items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    rows = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    number = F.pmod(F.xxhash64("doc_id", "n_words", "cluster", "source", "chunk"), F.lit(max(1, -(-total // run)))).alias("run")
    return rows.select(number, *key, F.least(F.lit(CHUNK), F.col("n") - CHUNK * F.col("chunk")).alias("copies"))


def pack(documents: DataFrame, capacity: int = CAPACITY, run: int = RUN) -> DataFrame:
    """doc_id, piece, bin_id (string: run and bin), offset and n_words of every piece."""

    def work(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_words", "copies")]
        rows = [(i, s, c, n) for i, s, c, n, copies in zip(*columns, strict=True) for _ in range(copies)]
        done = list(zip(*pack_run(rows, capacity), strict=True))
        first = table.column("run")[0].as_py()
        return pa.Table.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array([f"{first}-{b}" for b in done[2]]), pa.array(done[3], pa.int32()), pa.array(done[4], pa.int32())], schema=SCHEMA)

    return deal(documents, run).groupBy("run").applyInArrow(work, "doc_id bigint, piece bigint, bin_id string, offset int, n_words int")
