"""Centroid clustering, fill-in-the-middle and top-k search against plain versions, with edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import clustering, fill_in_middle, topk
from tidemark.llm.clustering import Bisectors

VECTORS = "vec_id bigint, embedding array<double>, label string, v string, h string, cluster int, distance string, part int, query_id string"


def vectors(spark, rows):
    """Embeddings with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, "x", "x", "x", 1, "x", 1, "x") for i, v in rows], VECTORS)


def whole(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def floors(v):
    return [min(max(math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x), -(2**90)), 2**90) for x in v]


def plain_clusters(rows, k, rounds, width):
    kept = [(i, floors(v)) for i, v in rows if whole(v, width)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        sums = [[v for (_, v), o in zip(kept, own) if o == c] for c in range(len(centroids))]
        centroids = [[sum(column) // len(s) for column in zip(*s)] if s else centroids[c] for c, s in enumerate(sums)]
    own = [nearest(v) for _, v in kept]
    far = [gap(v, centroids[o]) for (_, v), o in zip(kept, own)]
    top = 2**63 - 1
    far = [min(d, top) for d in far]
    inertia = {c: sum(d for d, o in zip(far, own) if o == c) for c in set(own)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, o, d, min(inertia[o], top), min(sum(far), top), sha[o])) for (i, _), o, d in zip(kept, own, far))


def clusters(spark, rows, k, rounds, width):
    found = clustering.cluster(vectors(spark, rows), k, rounds, width)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(repr(tuple(r)) for r in found.collect())


def test_clusters_against_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.1, 0.3]) + (i % 3) for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (200, None), (201, [0.1] * 3), (202, [0.1, None, 0.2, 0.3]), (203, [0.1, float("nan"), 0.2, 0.3])]
    rows += [(204, [float("inf"), 0.0, 0.0, 0.0]), (205, []), (206, [0.0, 0.0, 0.0, 0.0]), (207, [0.0, 0.0, 0.0, 0.0])]
    assert clusters(spark, rows, 6, 3, 4) == plain_clusters(rows, 6, 3, 4)


def test_clusters_of_few_rows_and_none(spark):
    rows = [(3, [0.1, 0.2]), (3, [0.1, 0.2]), (5, [0.3, -0.2])]
    assert clusters(spark, rows, 40, 5, 2) == plain_clusters(rows, 40, 5, 2)
    assert clusters(spark, [], 40, 5, 2) == [] and clusters(spark, [(1, None), (2, [0.5])], 40, 5, 2) == []


def test_clusters_of_very_large_components(spark):
    rows = [(i, [x, y]) for i, (x, y) in enumerate([(1e30, 0.0), (-1e30, 1.0), (1e9, 2.0), (1e9 + 4, 2.0), (3e4, -7.0), (0.25, 0.25)])]
    assert clusters(spark, rows, 3, 2, 2) == plain_clusters(rows, 3, 2, 2)


@pytest.mark.parametrize("spread", [3, 1000, 10**9])
def test_tournament_finds_the_first_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (23, 5)).tolist()
    centroids[9] = centroids[4]
    x = rng.integers(-spread, spread + 1, (400, 5))
    winner, distance = Bisectors(centroids).nearest(x.astype(float))
    gap = ((x[:, None, :].astype(object) - np.array(centroids, object)[None]) ** 2).sum(2)
    best = [min(range(23), key=lambda c: (row[c], c)) for row in gap]
    assert winner.tolist() == best
    assert distance.tolist() == [min(row[b], 2**63 - 1) for row, b in zip(gap, best)]


def test_tournament_of_small_centroids_and_large_rows():
    centroids = [[1, 0], [0, 1], [-3, 5]]
    x = [[10**20, 10**20 - 10**5], [10**20, 10**20], [-(10**20), 7], [2, 3]]
    winner, _ = Bisectors(centroids).nearest(np.array(x, float))
    exact = [[int(float(v)) for v in row] for row in x]
    assert winner.tolist() == [min(range(3), key=lambda c: (sum((a - b) ** 2 for a, b in zip(row, centroids[c])), c)) for row in exact]


# --------------------------------------------------------------------------- fill in the middle


def plain_cut(ident, text, seed="1:"):
    text = text or ""
    h = hashlib.sha256(f"{seed}{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return ident, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return ident, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return ident, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "Bc", "zzz", " ", "\n", "é", "日本", "😀", "<", ">", "P", "S", "M", "<P", "S>", "<M", "\x00", "1", "-"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(1500)]
    return out + ["", None, "a", "<", "é", "<P>", "x<M>", "x<S>y", "<<P", "<P" * 50, "a" * 300_000, "日" * 100_000, "ab 1" * 50_000, "퟿"]


def test_cuts_and_restored_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "one two three"), (None, None), (40_000, "same"), (40_000, "same"), (-3, "minus three words")]
    df = spark.createDataFrame([(i, t, "x", "x", 5, "x", "x") for i, t in rows], "doc_id bigint, text string, kept string, h string, N int, output string, t string")
    found = fill_in_middle.restore(fill_in_middle.transform(df))
    assert found.columns == ["doc_id", "kept", "h", "t", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    found = found.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in found), key=key) == sorted((plain_cut(*r) for r in rows), key=key)
    given = {i: t or "" for i, t in rows if i is not None}
    assert all(r.restored == given[r.doc_id] for r in found if r.doc_id is not None)
    assert {"plain", "psm", "spm"} == {r.form for r in found}
    assert fill_in_middle.restore(fill_in_middle.transform(df.limit(0))).count() == 0


def test_restored_from_output_and_form_alone():
    """Cuts next to half marks: no byte of the text is taken for a mark."""
    bounds = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    outputs = [b"<P>a<<S>S><M><", b"<S><<P><P<M>M>", b"plain <S", b"", b"<P><S><M>", b"<S><P><M>x"]
    form = np.array([1, 2, 0, 0, 1, 2])
    data, at = fill_in_middle.rebuild(np.frombuffer(b"".join(outputs), np.uint8), bounds(outputs), form)
    got = [data[at[i] : at[i + 1]].tobytes() for i in range(len(outputs))]
    assert got == [b"a<<S>", b"<PM><", b"plain <S", b"", b"", b"x"]


# --------------------------------------------------------------------------- exact top-k


def plain_top(rows, k, every):
    kept = [(i, floors(v)) for i, v in rows if whole(v)]
    out = []
    for q, (i, x) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = [(max(min(sum(a * b for a, b in zip(x, y)), 2**63 - 1), -(2**63)), j) for r, (j, y) in enumerate(kept) if r != q and len(y) == len(x)]
            scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(map(repr, out))


def top(spark, rows, k, every):
    found = topk.top_k(vectors(spark, rows), k, every)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(repr(tuple(r)) for r in found.collect())


def test_top_k_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.4, -0.1, 0.0, 0.1, 0.3]) for _ in range(3)]) for i in range(300)]
    rows += [(20, rows[20][1]), (20, rows[21][1]), (None, rows[20][1]), (None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (-20, [0.1, 0.1, 0.1])]
    rows += [(400, None), (420, [0.1, None, 0.3]), (440, [0.1, float("nan"), 0.3]), (460, [float("-inf"), 0.0, 0.0]), (480, [0.5]), (481, [0.25]), (500, []), (501, [])]
    rows += [(520, [0.1, 0.2])]
    assert top(spark, rows, 5, 20) == plain_top(rows, 5, 20)


def test_top_k_of_very_large_components_and_few_rows(spark):
    rows = [(i, [x, y]) for i, (x, y) in enumerate([(1e12, 1.0), (-1e12, 2.0), (1e6, 2.0), (3e4, -7.0), (0.25, 0.25), (1e25, -1e25)])]
    assert top(spark, rows, 4, 2) == plain_top(rows, 4, 2)
    assert top(spark, rows[:1], 4, 2) == [] and top(spark, [], 5, 50) == []


def test_top_k_over_many_ranges_and_chunks(spark, monkeypatch):
    """Rows in groups, a third of them one vector: several ranges, chunks and skipped ranges."""
    monkeypatch.setattr(topk, "CHUNK", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 8))
    x = np.where(np.arange(15_000)[:, None] % 3 == 0, centres[0], centres[rng.integers(0, 40, 15_000)] + rng.normal(0, 0.02, (15_000, 8)))
    ids = rng.permutation(15_000)
    w = np.floor(256 * x).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = w @ w[q]
        best = [r for r in np.lexsort((ids, -s)) if r != q][:5]
        want += [(int(ids[q]), n + 1, int(ids[r]), int(s[r])) for n, r in enumerate(best)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, 5, 100).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_search_skips_no_row(seed):
    """Small blocks in one process, with and without ids, ties everywhere."""
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, 2, (200, 3)))
    kind = (rng.random(200) < 0.2).astype(np.int8)
    ids = np.where(kind == 1, 0, rng.permutation(200))
    order = np.lexsort(x.T)
    x, kind, ids = x[order], kind[order], ids[order]
    blocks = [topk.Block(x[a : a + 7], kind[a : a + 7], ids[a : a + 7]) for a in range(0, 200, 7)]
    q = np.floor(rng.normal(0, 2, (30, 3)))
    best = topk.Best(30, 4)
    topk.search(q, blocks, best, np.ones(30, bool))
    for n in range(30):
        s = (x @ q[n]).astype(int)
        want = np.lexsort((ids, kind, -s))[:4]
        assert best.score[n].tolist() == s[want].tolist()
        assert [(t, 0 if t else i) for t, i in zip(best.kind[n], best.id[n])] == [(t, 0 if t else i) for t, i in zip(kind[want], ids[want])]
