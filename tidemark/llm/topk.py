"""Exact top-k search by inner product of integer vectors, a block at a time.

The terms of a vector are its dimensions, each with two signs. Rows are ordered by their two heaviest terms and cut into blocks of
BLOCK rows, the document ranges; RANGE rows of blocks are stored as one range of the index. A block keeps its forward
index (the rows' weights) and each term's maximum and minimum in it; their sum over a query's terms bounds the query's
score with any row of the block. Each query takes the blocks by falling bound and scores them through the forward index until the
bounds fall below its k-th score; a block whose bound equals it is skipped only if none of its ids is smaller.

The range that a query lies in answers it while the index is written, which gives a first k-th score. Then chunks of CHUNK queries meet
the term maxima of whole ranges, and only pairs of chunk and range that hold some block within some query's bound move
the range's blocks. A task holds one chunk and one range; it returns at most k rows a query, and the best k of all are taken.

Vectors that are null or hold null or non-finite components take no part; only vectors of equal length are compared. A query's own row is
left out, so rows that repeat find each other, and each row whose id is divisible by `every` is answered. Rows
without an id are no queries and come after all others at equal scores. Scores that a long can't hold become the nearest long. An
empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, scratch_scope
from tidemark.llm.vectors import EXACT, embedding_of, integers, matrix, products

BLOCK, RANGE, CHUNK = 64, 4096, 8192
#: Ranges of one partition of the index, where the table is that large.
RANGES = 8
#: Most pairs of chunk and range that are broadcast.
SMALL = 200_000
LEAST = np.iinfo(np.int64).min


class Best:
    """The k best rows of each of n queries: by score, then rows with an id, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), LEAST, np.int64)
        self.kind = np.full((n, k), 2, np.int8)  # 0 a row with an id, 1 one without, 2 no row
        self.id = np.zeros((n, k), np.int64)
        self.new = np.zeros((n, k), bool)
        self.k = k

    def open(self, bound: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a row with a score up to bound and an id from low on could enter the lists of the queries q."""
        last = self.score[q, -1]
        ties = (self.kind[q, -1] == 1) | (self.kind[q, -1] == 0) & (low < self.id[q, -1])
        return (self.kind[q, -1] == 2) | (bound > last) | (bound == last) & ties

    def offer(self, q: np.ndarray, score: np.ndarray, kind: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, new: bool = True) -> None:
        """score[i, j] is query q[i]'s with row j."""
        hit = (score >= self.score[q, -1][:, None]) | (self.kind[q, -1] == 2)[:, None]
        if allowed is not None:
            hit &= allowed
        i, j = np.nonzero(hit)
        if not len(i):
            return
        some = np.unique(i)
        qs, k = q[some], self.k
        group = np.concatenate([np.repeat(np.arange(len(some)), k), np.searchsorted(some, i)])
        s = np.concatenate([self.score[qs].ravel(), score[i, j]])
        t = np.concatenate([self.kind[qs].ravel(), kind[j]])
        d = np.concatenate([self.id[qs].ravel(), ids[j]])
        f = np.concatenate([self.new[qs].ravel(), np.full(len(j), new)])
        # ~s falls as s rises, without leaving the longs
        order = np.lexsort((d, ~s, t == 2, group)) if not (t == 1).any() else np.lexsort((d, t, ~s, t == 2, group))
        top = order[np.searchsorted(group[order], np.arange(len(some)))[:, None] + np.arange(k)]
        self.score[qs], self.kind[qs], self.id[qs], self.new[qs] = s[top], t[top], d[top], f[top]


class Block:
    """A range of rows in the index's order: forward index, term extremes, ids."""

    def __init__(self, x: np.ndarray, kind: np.ndarray, ids: np.ndarray, high: np.ndarray | None = None, low: np.ndarray | None = None):
        self.x, self.kind, self.ids = x, kind, ids
        self.high, self.low = (x.max(0), x.min(0)) if high is None else (high, low)
        self.first = ids[kind == 0].min(initial=np.iinfo(np.int64).max)


def bounds_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) with blocks (rows of term extremes); infinite where doubles aren't exact."""
    most = max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))
    if np.abs(q).max(initial=0) * most * max(q.shape[1], 1) >= EXACT:
        return np.full((len(q), len(high)), np.inf)
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(q: np.ndarray, blocks: list[Block], best: Best, waiting: np.ndarray, own: np.ndarray | None = None) -> None:
    """Improves the lists of the waiting queries by the rows of these blocks; own is each query's own row, counted over the blocks."""
    bounds = bounds_of(q, np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    begin = np.concatenate([[0], np.cumsum([len(b.ids) for b in blocks])])
    first = np.array([b.first for b in blocks])
    left = np.flatnonzero(waiting)
    for step in range(len(blocks)):
        at = order[left, step]
        bound = bounds[left, at]
        # bounds fall from step to step: a query whose bound is below its k-th score is done, one that ties goes on
        going = (bound >= best.score[left, -1]) | (best.kind[left, -1] == 2)
        left, at, bound = left[going], at[going], bound[going]
        if not len(left):
            return
        live = best.open(bound, first[at], left)
        mine, at = left[live], at[live]
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by])) + 1
        for part in np.split(by, cuts) if len(by) else []:
            number, qs = at[part[0]], mine[part]
            block = blocks[number]
            allowed = None if own is None else own[qs][:, None] != begin[number] + np.arange(len(block.ids))
            best.offer(qs, products(q[qs], block.x), block.kind, block.ids, allowed)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest of three types that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, width).astype(float)


INDEX = pa.schema(
    [
        ("row", pa.string()),  # block, pack (of queries) or range
        ("part", pa.int64()),
        ("seq", pa.int64()),
        ("width", pa.int32()),
        ("n", pa.int32()),
        ("type", pa.string()),
        ("data", pa.binary()),
        ("edges", pa.binary()),  # maxima, then minima, in the same type
        ("ids", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
        ("found", pa.list_(pa.struct([("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())]))),
    ]
)
INDEX_DDL = (
    "row string, part bigint, seq bigint, width int, n int, type string, data binary, edges binary, ids array<bigint>, places array<int>, "
    "found array<struct<place:int,score:bigint,vec_id:bigint>>"
)


def _range_rows(part: int, seq: int, x: np.ndarray, kind: np.ndarray, ids: np.ndarray, k: int, every: int) -> Iterator[dict]:
    """The index rows of one range: its blocks, its extremes, and its queries with what they find in it."""
    n, width = x.shape
    blocks = [Block(x[at : at + BLOCK], kind[at : at + BLOCK], ids[at : at + BLOCK]) for at in range(0, n, BLOCK)]
    common = {"part": part, "seq": seq, "width": width}
    for b in blocks:
        name, data = _packed(b.x)
        edges = np.stack([b.high, b.low]).astype(name).tobytes()
        yield common | {"row": "block", "n": len(b.ids), "type": name, "data": data, "edges": edges, "ids": [None if t else int(i) for t, i in zip(b.kind, b.ids, strict=True)]}
    highs, lows = np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks])
    first = [int(b.first) for b in blocks]
    name, data = _packed(np.stack([highs.max(0), lows.min(0)]))
    yield common | {"row": "range", "n": 1, "type": name, "data": data, "ids": [min(first)]}
    asked = np.flatnonzero((kind == 0) & (ids % every == 0))
    for at in range(0, len(asked), BLOCK):
        mine = asked[at : at + BLOCK]
        best = Best(len(mine), k)
        search(x[mine], blocks, best, np.ones(len(mine), bool), mine)
        name, data = _packed(x[mine])
        yield common | {"row": "pack", "n": len(mine), "type": name, "data": data, "ids": ids[mine].tolist(), "places": mine.tolist(), "found": _found(best, mine)}


def _found(best: Best, places: np.ndarray) -> list[dict]:
    i, j = np.nonzero(best.new)
    kind = best.kind[i, j]
    rows = zip(places[i].tolist(), best.score[i, j].tolist(), best.id[i, j].tolist(), kind.tolist(), strict=True)
    return [{"place": p, "score": s, "vec_id": None if t else d} for p, s, d, t in rows]


def build(embeddings: DataFrame, k: int, every: int) -> DataFrame:
    """The index of embeddings(vec_id, embedding) as one table of blocks, range extremes and query packs."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("rid"), embedding_of(embeddings).alias("v"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RANGE):
                piece = batch.slice(at, RANGE)
                whole, offsets, values = integers(piece.column("v"))
                width = np.diff(offsets)
                heavy = np.zeros((len(width), 2), np.int64)
                for w in np.unique(width[whole]):
                    mine = np.flatnonzero(whole & (width == w))
                    if w > 1:
                        x = matrix(offsets, values, mine, w)
                        two = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2]
                        heavy[mine] = 2 * two + (np.take_along_axis(x, two, 1) < 0)
                kept = pa.array(np.flatnonzero(whole))
                columns = [c.take(kept) for c in piece.columns] + [pa.array(a[whole], pa.int32()) for a in (width, heavy[:, 0], heavy[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "rid", "v", "width", "t1", "t2"])

    schema = rows.select("*", *[F.lit(0).alias(c) for c in ("width", "t1", "t2")]).schema
    keyed = rows.mapInArrow(terms, schema)
    n = rows.count()
    parts = max(1, -(-n // (RANGE * RANGES)), min(-(-n // RANGE), 2 * spark.sparkContext.defaultParallelism))
    key = ["width", "t1", "t2", "vec_id", "rid"]
    dealt = keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("vec_id", "v")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            x, kind, ids = (np.concatenate(a) for a in zip(*held, strict=True))
            for at in range(0, len(x), RANGE):
                made = list(_range_rows(part, seq, x[at : at + RANGE], kind[at : at + RANGE], ids[at : at + RANGE], k, every))
                yield pa.RecordBatch.from_pylist(made, INDEX)
                seq += 1
            held = []

        for batch in batches:
            for at in range(0, batch.num_rows, RANGE):
                piece = batch.slice(at, RANGE)
                _, offsets, values = integers(piece.column("v"))
                width = np.diff(offsets)
                ids = piece.column("vec_id")
                kind = np.asarray(ids.is_null()).astype(np.int8)
                ids = ids.fill_null(0).to_numpy()
                for mine in np.split(np.arange(len(width)), np.flatnonzero(np.diff(width)) + 1):
                    if held and (held[0][0].shape[1] != width[mine[0]] or sum(len(h[0]) for h in held) + len(mine) > RANGE):
                        yield from close()
                    held.append((matrix(offsets, values, mine, width[mine[0]]), kind[mine], ids[mine]))
        if held:
            yield from close()

    return materialize(dealt.mapInArrow(cut, INDEX_DDL), "index")


def _queries(rows: list[dict], k: int) -> tuple[np.ndarray, Best, list[tuple[int, int, int, int]]]:
    """(vectors, lists so far, (part, seq, place, id) of each) of some packs."""
    x = np.concatenate([_unpacked(r["type"], r["data"], r["width"], r["n"]) for r in rows])
    who = [(r["part"], r["seq"], p, i) for r in rows for p, i in zip(r["places"], r["ids"], strict=True)]
    at = {w[:3]: i for i, w in enumerate(who)}
    best, filled = Best(len(x), k), np.zeros(len(x), np.int64)
    for r in rows:
        for f in r["found"]:  # each query's in their order
            i = at[r["part"], r["seq"], f["place"]]
            j = filled[i]
            best.score[i, j], best.kind[i, j], best.id[i, j] = f["score"], f["vec_id"] is None, f["vec_id"] or 0
            filled[i] += 1
    return x, best, who


def live_pairs(packs: DataFrame, ranges: DataFrame, chunks: int, parts: int, k: int) -> DataFrame:
    """chunk, part, seq of the ranges that some query of the chunk may find a row in."""
    names = ["row", "part", "seq", "width", "n", "type", "data", "ids", "places", "found"]
    asked = packs.select("chunk", *names, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("side"))
    bound = ranges.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), *names, F.col("part").cast("int").alias("side"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for width in {r["width"] for r in rows}:
            mine = [r for r in rows if r["row"] == "pack" and r["width"] == width]
            spans = [r for r in rows if r["row"] == "range" and r["width"] == width]
            if mine and spans:
                x, best, who = _queries(mine, k)
                where = np.array([w[:2] for w in who])
                edges = np.stack([_unpacked(r["type"], r["data"], width, 2) for r in spans])
                bounds = bounds_of(x, edges[:, 0], edges[:, 1])
                for c, r in enumerate(spans):
                    other = np.flatnonzero((where != [r["part"], r["seq"]]).any(1))
                    if best.open(bounds[other, c], np.full(len(other), r["ids"][0]), other).any():
                        out.append({"chunk": key[0].as_py(), "part": r["part"], "seq": r["seq"]})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int32()), ("part", pa.int64()), ("seq", pa.int64())]))

    both = asked.unionByName(bound)
    return both.groupBy("chunk", "side").applyInArrow(meet, "chunk int, part bigint, seq bigint")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of embeddings(vec_id, embedding) for each row whose id `every` divides."""
    with scratch_scope() as keep:
        index = build(embeddings, k, every)
        keep(index)
        packs, ranges = index.where("row = 'pack'"), index.where("row = 'range'")
        asked = packs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        parts = (ranges.agg(F.max("part").alias("m")).first().m or 0) + 1
        chunks = min(parts, max(1, -(-asked // CHUNK)))
        packs = packs.withColumn("chunk", F.floor(F.col("part") * chunks / parts).cast("int"))
        pairs = materialize(live_pairs(packs, ranges, chunks, parts, k), "pairs")
        if pairs.limit(SMALL + 1).count() <= SMALL:
            pairs = F.broadcast(pairs)
        names = ["row", "part", "seq", "width", "n", "type", "data", "edges", "ids", "places", "found"]
        sides = index.where("row = 'block'").join(pairs, ["part", "seq"]).select("chunk", F.col("part").alias("p"), F.col("seq").alias("s"), *names)
        other = pairs.select("chunk", F.col("part").alias("p"), F.col("seq").alias("s"))
        sides = sides.unionByName(packs.join(other, "chunk").select("chunk", "p", "s", *names))

        def answer(key: tuple, table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            out = {c: [] for c in ("part", "seq", "place", "query_id", "score", "vec_id")}
            blocks = [r for r in rows if r["row"] == "block"]
            mine = [r for r in rows if r["row"] == "pack" and r["width"] == blocks[0]["width"]]
            if mine:
                width = blocks[0]["width"]
                x, best, who = _queries(mine, k)
                made = []
                for r in blocks:
                    edges = _unpacked(r["type"], r["edges"], width, 2)
                    kind = np.array([i is None for i in r["ids"]], np.int8)
                    made.append(Block(_unpacked(r["type"], r["data"], width, r["n"]), kind, np.array([i or 0 for i in r["ids"]], np.int64), *edges))
                here = (key[1].as_py(), key[2].as_py())
                search(x, made, best, np.array([w[:2] != here for w in who]))
                i, j = np.nonzero(best.new)
                for name, c in (("part", 0), ("seq", 1), ("place", 2), ("query_id", 3)):
                    out[name] = [who[q][c] for q in i]
                out["score"] = best.score[i, j].tolist()
                out["vec_id"] = [None if t else int(d) for t, d in zip(best.kind[i, j], best.id[i, j], strict=True)]
            return pa.Table.from_pydict(out, RESULT)

        more = materialize(sides.groupBy("chunk", "p", "s").applyInArrow(answer, RESULT_DDL), "answers")
        keep(more)
    pack = index.where("row = 'pack'")
    first = pack.select("part", "seq", F.map_from_arrays("places", "ids").alias("of"), F.inline("found"))
    first = first.select("part", "seq", "place", F.col("of")[F.col("place")].alias("query_id"), "score", "vec_id")
    w = Window.partitionBy("part", "seq", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


RESULT = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
RESULT_DDL = "part bigint, seq bigint, place int, query_id bigint, score bigint, vec_id bigint"


def oracle_sql(k: int = 5, every: int = 50) -> str:
    """All pairs in DuckDB's SQL, for small tables."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % {every} = 0 AND q.r <> d.r AND len(q.x) = len(d.x))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= {k}
"""
