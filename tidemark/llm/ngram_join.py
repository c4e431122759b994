"""N-gram Jaccard join: near-duplicate components by prefix filtering under several global token orders.

A document's set is its distinct k-word shingles (fewer words: the whole sequence is one shingle; none: empty).
Two documents link when 100 * intersection >= percent * union. Equal sets are collapsed first. Under a global
token order, linked sets share a token among the first `n - ceil(t * n) + 1` of each; the first order puts
frequent tokens last (a count sketch of fixed size knows them), the others are plain hash orders. Candidates
share a prefix token under the first order (an equi-join), survive a parity-bitmap bound on their overlap, share a
prefix token under every other order, and are then verified on their whole sets.

A token list of more than SHORT members, as thousands of near copies make, is never expanded into all pairs. Two
rounds link members with few pivots per list; lists whose members then lie in one component are done. For the
rest, blocks of bounded size are compared inside a task, which returns only pairs that pass the bitmaps and lie
in different components, so every link between components is still found.

Frequent tokens never meet in one task: what a list needs to know of itself is a map-side aggregate that is joined back,
and only lists that a count of token buckets proves short are counted by a window. Whole sets travel as the upper halves of
their hashes; a pair that chance agreements could have lifted over the bound is compared again by whole hashes.

Null texts and empty texts have an empty set and link with nothing; a row with a null id links like any other, its
component is that of the ids it reaches, null if there are none; repeated rows are each returned; extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import (
    LOWER,
    connected_components,
    discard,
    find_words,
    materialize,
    mix,
    packed,
    release,
    rows_of,
    scratch_scope,
    shingle_hashes,
    skew_join,
    span_hashes,
    text_slices,
    unpacked,
    without,
)

SKETCH_BITS = 17
SKETCH_ROW = 1 << 12
BITMAP_WORDS = 32
ORDERS = 3
BLOCK = 1024
SHORT = 32
#: Partners of one pivot that are verified in one place.
SALT_ROWS = 64
#: Pivots that lists with the same members can have.
PIVOTS = 8
#: Buckets of prefix tokens (2 ** HOT_BITS), and the rows from which a bucket's tokens are not counted by a window.
HOT_BITS = 12
HOT_ROWS = 1000
#: Most ids that are broadcast to fetch texts; beyond it both sides are shuffled.
SMALL = 200_000


def _shingles(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of rows as (word hashes, first word of each row, hashes of the k words from each word on)."""
    for _, _, data, bounds in text_slices(texts):
        data = LOWER[data]
        starts, ends, first = find_words(data, bounds)
        words = span_hashes(data, starts, ends)
        yield words, first, shingle_hashes(words, k) if len(words) >= k else words[:0]


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for words, first, shingles in _shingles(texts, k):
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(shingles[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k))


def token_sketch(documents: DataFrame, k: int) -> np.ndarray:
    """Counts of tokens by hash bucket over all documents; 2 ** SKETCH_BITS numbers whatever the input's size. Where all
    buckets are full, a token that is more frequent than a bucket's share still stands out, and only such ones matter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, first, s in _shingles(batch.column(0), k):
                inside = np.ones(len(s), bool)
                for j in range(1, k):  # shingles that reach into the next row
                    ends = first[1:-1] - j
                    inside[ends[(ends >= 0) & (ends < len(s))]] = False
                total += np.bincount((s[inside] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        rows = total.reshape(-1, SKETCH_ROW)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(rows)), pa.int32()), "n": pa.array(list(rows), pa.list_(pa.int64()))})

    parts = documents.select(F.col("text").cast("string")).mapInArrow(count, "part int, n array<bigint>")
    rows = parts.select("part", F.posexplode("n").alias("i", "n")).where("n > 0").groupBy("part", "i").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # as columns: a Python object for each number would take some 50 MB of the driver
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[found.column("part").to_numpy() * SKETCH_ROW + found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def _node(s: np.ndarray) -> int | None:
    """The id of a set's class, None for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _order(s: np.ndarray, number: int) -> np.ndarray:
    return mix(s ^ np.uint64(0xA0761D6478BD642F * number & 0xFFFFFFFFFFFFFFFF))


def _heads(hashes: np.ndarray, p: int) -> np.ndarray:
    """The p smallest hashes, by their upper 16 bits as ordered ints: chance agreements only weaken the bound."""
    low = np.partition(hashes, p - 1)[:p] if p < len(hashes) else hashes
    return (np.sort(low >> np.uint64(48)).astype(np.int32) - (1 << 15)).astype(np.int16)


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """A token flips one of the bits: two sets' bitmaps differ in at most as many bits as the sets in tokens."""
    bits = np.bincount((mix(s) >> np.uint64(7)).astype(np.int64) & (64 * BITMAP_WORDS - 1), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def profiles(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, n (set size), node (id of the set's class, null if empty) and what the filters read:
    first (tokens), others (array of ORDERS - 1 token arrays), bits."""
    sketch = documents.sparkSession.sparkContext.broadcast(token_sketch(documents, k))
    schema = "doc_id bigint, n bigint, node bigint, first array<bigint>, others array<array<smallint>>, bits array<bigint>"
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("node", pa.int64()),
            ("first", pa.list_(pa.int64())),
            ("others", pa.list_(pa.list_(pa.int16()))),
            ("bits", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), {c: [] for c in kinds.names}

            def out(rows):
                return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.field(c).type) for c in kinds.names], schema=kinds)

            for i, s in zip(ids, _sets(batch.column(1), k), strict=True):
                n = len(s)
                rows["doc_id"].append(i)
                rows["n"].append(n)
                if not n:
                    for c in kinds.names[2:]:
                        rows[c].append(None)
                else:
                    p = prefix_length(n, percent)
                    rows["node"].append(_node(s))
                    held = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    rows["first"].append(s[np.lexsort((s, held))[:p]].view(np.int64))
                    rows["others"].append([_heads(_order(s, j), p) for j in range(1, ORDERS)])
                    rows["bits"].append(parity_bitmap(s))
                if len(rows["n"]) >= 1000:
                    yield out(rows)
                    rows = {c: [] for c in kinds.names}
            yield out(rows)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _near(a: str, b: str, percent: int) -> str:
    """SQL: sizes and parity bitmaps allow a link."""
    total = f"({a}.n + {b}.n)"
    apart = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITMAP_WORDS))
    return f"{(100 + percent)} * ({total} - ({apart})) >= {2 * percent} * {total}"


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        return int((both[1:] == both[:-1]).sum())
    (a, n), (b, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _room(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """Most tokens that sets of nx and ny tokens with the prefixes x and y under one order can share, 0 if the
    prefixes don't meet: below both prefixes' ends each set's tokens are all known."""
    if not len(np.intersect1d(x, y)):
        return 0
    end = min(x[-1], y[-1])
    x, y = x[x < end], y[y < end]
    repeats = len(x) - len(np.unique(x))  # equal upper bits
    return len(np.intersect1d(x, y)) + repeats + min(nx - len(x), ny - len(y))


def _meet(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b with a_, b_: n, others) that every further order leaves room for enough shared tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb"))
            xs, ys = batch.column("xs"), batch.column("ys")
            kept = []
            for i in range(batch.num_rows):
                x, y = xs[i].values, ys[i].values
                if all(
                    (100 + percent) * _room(x[j].values.to_numpy(), y[j].values.to_numpy(), na[i], nb[i]) >= percent * (na[i] + nb[i])
                    for j in range(ORDERS - 1)
                ):
                    kept.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in kept], pa.int64()), "b": pa.array([b[i] for i in kept], pa.int64())})

    rows = pairs.select("a", "b", F.col("a_.n").alias("na"), F.col("b_.n").alias("nb"), F.col("a_.others").alias("xs"), F.col("b_.others").alias("ys"))
    return rows.mapInArrow(run, "a bigint, b bigint")


class _Verifier:
    """Verifies pairs (a, b) of nodes on their whole sets, read from the texts of the nodes that still count."""

    def __init__(self, documents: DataFrame, classes: DataFrame, sigs: DataFrame, k: int, percent: int):
        self.documents, self.classes, self.sigs, self.k, self.percent = documents, classes, sigs, k, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs if hasattr(pairs, "_scratch") else materialize(pairs, "candidates")
        if not rows_of(pairs):
            return pairs
        named = _keep(self.sigs.select("node", F.struct("n", "bits", "others").alias("sig")), _nodes(pairs))
        sig = lambda x: named.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_"))
        near = skew_join(skew_join(pairs, sig("a"), "a"), sig("b"), "b").where(_near("a_", "b_", self.percent))
        near = materialize(_meet(near, self.percent), "pairs")
        if not rows_of(near):
            return near
        links = self.compare(near, False)
        discard(near)
        release(links.sparkSession)
        close = links.where("not sure").select("a", "b")
        if close.isEmpty():
            return links.select("a", "b")
        return links.where("sure").select("a", "b").unionByName(self.compare(materialize(close, "close"), True).select("a", "b"))

    def compare(self, pairs: DataFrame, whole: bool) -> DataFrame:
        """a, b and sure of the pairs that link by the halves of their hashes (sure: whatever chance agreements there
        are) or by whole hashes."""
        percent = self.percent
        hubs = pairs.groupBy("a").agg(F.count("*").alias("held")).where(F.col("held") > SALT_ROWS)
        pairs = _attach(pairs, materialize(hubs, "hubs"), "a", "left")
        salts = F.ceil(F.coalesce("held", F.lit(1)) / SALT_ROWS)
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
        wanted = materialize(skew_join(_nodes(pairs), self.classes, "node").select("node", F.col("rep").alias("doc_id")), "wanted")
        sets = _sets_of(self.documents, wanted, self.k, whole)
        # each pivot's set goes once to each salt that has partners of it; partners' sets go once per pair
        asked = pairs.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("role")).unionByName(
            pairs.select(F.col("a").alias("node"), "a", "salt", F.lit(0).alias("role")).distinct()
        )
        asked = materialize(asked, "asked")
        few = rows_of(asked) <= SMALL
        rows = sets.join(F.broadcast(asked), "node") if few else skew_join(asked, sets, "node")
        rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, pivot = None, None
            for batch in batches:
                out = []
                node, a, salt, role = (batch.column(c).to_pylist() for c in ("node", "a", "salt", "role"))
                sets = batch.column("s")
                for i in range(len(node)):
                    s = sets[i].values.to_numpy(zero_copy_only=False)
                    if role[i] == 0:
                        at, pivot = (a[i], salt[i]), s
                    elif at == (a[i], salt[i]):
                        shared, both = _shared(s, pivot), len(s) + len(pivot)
                        if (100 + percent) * shared >= percent * both:
                            slack = 0 if whole else 3 + 20 * len(s) * len(pivot) // (1 << 32)
                            out.append((a[i], node[i], (100 + percent) * (shared - slack) >= percent * both))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["a", "b", "sure"])

        links = rows.select("node", "a", "salt", "role", "s").mapInArrow(run, "a bigint, b bigint, sure boolean")
        return materialize(links, "links")


def _block_pairs(percent: int):
    """For one (token, block i, block j): the pairs across or within the blocks that lie in different
    components and that the bitmaps allow."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(two):
            two = one
        node, comp, n = (two[c].to_numpy() for c in ("node", "comp", "n"))
        bits = np.array(two["bits"].tolist(), np.int64).view(np.uint64)
        a, b = [], []
        for x, c, size, own in zip(one["node"], one["comp"], one["n"], one["bits"], strict=True):
            apart = np.bitwise_count(bits ^ np.array(own, np.int64).view(np.uint64)).sum(1, dtype=np.int64)
            hit = (comp != c) & ((100 + percent) * (n + size - apart) >= 2 * percent * (n + size))
            found = node[hit]
            a += [min(x, y) for y in found]
            b += [max(x, y) for y in found]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def join(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_shingles and component_id."""
    docs, named = resolve(documents, k, percent)
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = skew_join(named, least, "comp").select("node", "component_id")
    out = skew_join(docs.select("doc_id", "n", "node"), of_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def resolve(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n and node of each row; classes: node, rep (its smallest id) and comp, the component's name)."""
    with scratch_scope() as keep:
        docs, named = _resolve(documents, k, percent)
        keep(docs)
        keep(named)
    return docs, named


def _resolve(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    docs = materialize(profiles(documents, k, percent), "profiles")
    filled = docs.where("n > 0")
    classes = filled.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    # one row of each class; only the rows of classes with copies move
    heavy = filled.select("node", "n", "first", "others", "bits")
    copied = materialize(classes.where("copies > 1").select("node"), "copied")
    once = heavy.dropDuplicates(["node"]) if rows_of(copied) > SMALL else _keep(heavy, copied, "left_anti").unionByName(_keep(heavy, copied).dropDuplicates(["node"]))
    verify = _Verifier(documents, classes, once, k, percent)

    tokens = once.select("node", F.col("n").cast("int").alias("n"), F.explode("first").alias("token"))
    lists = materialize(_counted(tokens).where("held > 1"), "lists")
    # in_long: how many of a node's prefix tokens have long lists
    in_long = materialize(lists.where(F.col("held") > SHORT).groupBy("node").agg(F.count("*").cast("int").alias("in_long")), "long")
    short = _attach(lists.where(F.col("held") <= SHORT), in_long, "node", "left").withColumn("in_long", F.coalesce("in_long", F.lit(0)))
    long = materialize(lists.where(F.col("held") > SHORT).select("token", "node"), "longs")

    # short lists: all pairs; long lists: each node with a pivot of the list
    first = _pairs_with_pivot(long.withColumn("comp", F.col("node"))).unionByName(_short_pairs(short, percent))
    first = materialize(first.distinct(), "candidates")
    discard(lists)
    comps = _components(None, verify(first))
    discard(first)
    # lists that still span components: once more with other pivots, then all blocks
    for pairs_of in (lambda rows: _pairs_with_pivot(rows, 1), lambda rows: _blocks(rows, once, percent)):
        still = _open(long, comps)
        if not rows_of(still):
            break
        comps = _components(comps, verify(pairs_of(still).distinct()))

    named = skew_join(classes, comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("comp"))
    # the filters' columns are not needed any more
    return materialize(docs.select("doc_id", "n", "node"), "rows"), materialize(named, "named")


def _attach(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the columns of found (a written table, one row per key), by broadcast while that is small."""
    return rows.join(F.broadcast(found), key, how) if rows_of(found) <= SMALL else skew_join(rows, found, key, how)


def _counted(tokens: DataFrame) -> DataFrame:
    """tokens with held, the number of rows of each token. A window counts the tokens of buckets with few rows, which
    bound its groups; those of the others, at most half of the buckets, are counted by an aggregate that is joined."""
    bucket = F.shiftrightunsigned("token", 64 - HOT_BITS)
    sizes = tokens.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()  # at most 2 ** HOT_BITS rows
    most = max(HOT_ROWS, 2 * sum(r["n"] for r in sizes) >> HOT_BITS)
    hot = [r["bucket"] for r in sizes if r["n"] > most]
    held = F.count("*").over(Window.partitionBy("token")).cast("int")
    if not hot:
        return tokens.withColumn("held", held)
    many = tokens.where(bucket.isin(hot))
    counts = materialize(many.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "counts")
    counted = _attach(many, counts, "token").withColumn("held", F.least("held", F.lit((1 << 31) - 1)).cast("int"))
    return tokens.where(~bucket.isin(hot)).withColumn("held", held).unionByName(counted)


def _components(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) by the links known so far, given as their components, and further ones."""
    if known is not None:
        if edges.isEmpty():
            return known
        edges = edges.unionByName(known.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return connected_components(edges)


def _nodes(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")


def _keep(rows: DataFrame, nodes: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose node is (left_anti: is not) in nodes; up to SMALL nodes are broadcast and rows stay where they are."""
    if rows_of(nodes) <= SMALL:
        return rows.join(F.broadcast(nodes.select("node")), "node", how)
    return rows.join(nodes.select("node"), "node", how)


def _sets_of(documents: DataFrame, wanted: DataFrame, k: int, whole: bool) -> DataFrame:
    """(node, s): the whole set of each wanted(node, doc_id), as whole hashes or their upper halves (two that agree by
    chance within a set stay two); a repeated row gives its set again. Rows without an id are looked through if a
    class has no other."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.int64() if whole else pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = batch.column("node").to_pylist(), _sets(batch.column("text"), k), []
            for node, s in zip(nodes, sets, strict=True):
                own = _node(s)
                if own is not None and node in (None, own):  # a repeated id may bring another text
                    held.append((own, s.view(np.int64) if whole else (s >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            for i in range(0, len(held), 500):
                part = held[i : i + 500]
                yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in part], pa.int64()), "s": pa.array([x for _, x in part], kind)})

    schema = f"node bigint, s array<{'bigint' if whole else 'int'}>"
    known = wanted.where("doc_id is not null")
    rows = texts.join(F.broadcast(known), "doc_id") if known.count() <= SMALL else skew_join(texts, known, "doc_id")
    sets = rows.select("node", "text").mapInArrow(run, schema)
    nameless = wanted.where("doc_id is null").select("node")
    if nameless.isEmpty():
        return sets
    own = texts.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(run, schema)
    return sets.unionByName(_keep(own, nameless).dropDuplicates(["node"]))


def _open(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of lists, with their components, of the lists that span more than one component."""
    rows = skew_join(lists, comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    rows = materialize(rows, "opened")
    spans = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return materialize(_attach(rows, materialize(spans, "spans"), "token"), "open")


def _short_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link of the lists of at most SHORT members. A pair shares at most the prefix tokens counted here,
    those of long lists that both may have, and what lies behind the prefix that ends first."""
    sizes = f"100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
    pairs = rows.alias("x").join(rows.alias("y"), F.expr(f"x.token = y.token and x.node < y.node and {sizes}")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.least("x.in_long", "y.in_long").alias("more")
    )
    pairs = pairs.groupBy("a", "b", "na", "nb", "more").agg(F.count("*").alias("shared"))
    behind = f"(ceil({percent} * greatest(na, nb) / 100) - 1)"
    return pairs.where(f"{100 + percent} * (shared + more + {behind}) >= {percent} * (na + nb)").select("a", "b")


def _pairs_with_pivot(rows: DataFrame, number: int = 0) -> DataFrame:
    """Pairs of each row of the lists (token, node, comp) with its list's pivot, the member with the smallest hash. Lists
    of the same members have at most PIVOTS different ones."""
    rows = rows.withColumn("rank", F.xxhash64("node", F.pmod("token", F.lit(PIVOTS)), F.lit(number)))
    low = materialize(rows.groupBy("token").agg(F.min("rank").alias("low")), "low")
    pivots = _attach(rows, low, "token").where("rank = low").groupBy("token").agg(F.min("node").alias("x"), F.min("comp").alias("x_comp"))
    pairs = _attach(rows, materialize(pivots, "pivots"), "token").where("x_comp <> comp")
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def _blocks(rows: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the long lists (token, node, comp), block by block. A component with many rows in a list has
    blocks of its own, which are not compared with one another; the others are dealt by their hash."""
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("own"))
    small = sizes.where(F.col("own") < BLOCK).groupBy("token").agg(F.ceil(F.sum("own") / BLOCK).alias("shared"))
    rows = _attach(rows, materialize(small, "shared"), "token", "left")
    large = sizes.where(F.col("own") >= BLOCK).withColumn("both", F.xxhash64("token", "comp")).select("both", "own")
    rows = _attach(rows.withColumn("both", F.xxhash64("token", "comp")), materialize(large, "large"), "both", "left")
    alone = F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK)))
    rows = rows.withColumn("block", F.when(F.col("own").isNotNull(), alone).otherwise(F.pmod(F.xxhash64("comp"), F.col("shared"))))
    rows = materialize(rows.select("token", "node", "comp", "block"), "blocks")
    spans = rows.groupBy("token", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    one = spans.toDF("token", "i", "lo1", "hi1")
    two = spans.toDF("token", "j", "lo2", "hi2")
    tasks = one.join(two, "token").where("i <= j and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    side = lambda block, k: tasks.select("token", "i", "j", F.col(block).alias("block"), F.lit(k).alias("side"))
    sides = side("i", 0).unionByName(side("j", 1).where("i < j"))
    members = skew_join(rows, _keep(sigs.select("node", "n", "bits"), materialize(rows.select("node").distinct(), "nodes")), "node")
    found = sides.join(members, ["token", "block"]).groupBy("token", "i", "j").applyInPandas(_block_pairs(percent), "a bigint, b bigint")
    return found.where("a <> b")


def _with_node(rows: DataFrame, k: int) -> DataFrame:
    """rows with __node, the class of their sets (null: empty)."""
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    schema = StructType([*plain.schema.fields, StructField("__node", LongType())])
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([_node(s) for s in _sets(batch.column(at).cast(pa.string()), k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "__node"])

    return plain.mapInArrow(run, schema).toDF(*rows.columns, "__node")


def deduplicate(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: that with the smallest doc_id, nulls last; of rows that repeat this id
    with linked texts one stays. Rows with an empty set stay. Rows are told apart by id and set, so a row whose id
    other texts have too shares their fate only if it links with them."""
    return unpacked(_deduplicated(packed(documents, "doc_id", "text"), k, percent), documents.columns)


def _deduplicated(documents: DataFrame, k: int, percent: int) -> DataFrame:
    docs, named = resolve(documents, k, percent)
    rows = docs.where("n > 0").select("doc_id", "node").distinct()
    rows = materialize(skew_join(rows, named.select("node", "comp"), "node"), "members")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("best"))
    rows = skew_join(rows, best, "comp").select("doc_id", "node", F.expr("doc_id <=> best.doc_id and node = best.node").alias("stays"))
    rows = materialize(rows, "decided")
    # an id with one row decides by the id alone; rows of the other ids and without one are looked up by their sets
    several = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    gone = rows.where("doc_id is not null and not stays").join(several, "doc_id", "left_anti").select("doc_id")
    kept = without(documents, gone, "doc_id")
    if not rows_of(several) and docs.where("doc_id is null and n > 0").isEmpty():
        return kept
    single = kept.where("doc_id is not null").join(several, "doc_id", "left_anti").select(*documents.columns)
    other = kept.where("doc_id is null").unionByName(kept.join(several, "doc_id", "left_semi").select(*documents.columns))
    other = materialize(_with_node(other, k), "other")
    stay = rows.where("stays").select(F.col("doc_id").alias("__id"), F.col("node").alias("__own"))
    held = other.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__own")), "left_semi").dropDuplicates(["doc_id", "__node"])
    return single.unionByName(held.unionByName(other.where("__node is null")).select(*documents.columns))


def oracle_sql(k: int, percent: int) -> str:
    """join() in DuckDB's SQL by the shingles that pairs share, for small tables."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {run})) END AS s FROM d),
g AS (SELECT r, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.t = b.t AND a.r <> b.r AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
c AS (SELECT r, r AS root FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.r WHERE c.root < e.b),
m AS (SELECT r, min(root) AS root FROM c GROUP BY r),
i AS (SELECT root, min(doc_id) AS component_id FROM m JOIN d USING (r) GROUP BY root)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, component_id FROM s JOIN m USING (r) JOIN i USING (root)
"""
