"""Whole results recomputed in plain Python: scores of the classifier from the texts, and what each stage of the pipeline keeps."""

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
import regex

from tidemark.llm import packing, quality, secrets
from tidemark.llm.common import span_hashes

SF = "/root/testdata/sf0.001"


def plain_features(text, n_chars):
    """{column: value} of one document."""
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]
    hashed = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> (64 - quality.BITS) for w in words]
    out = {c: math.log1p(n) for c, n in Counter(hashed).items()}
    norm = math.sqrt(sum(v * v for v in out.values()))
    out = {c: v / norm for c, v in out.items()}
    size, n = max(len(raw), 1), max(len(words), 1)
    share = lambda symbols: sum(b in symbols for b in raw) / size
    printable = [b for b in range(33, 127) if not chr(b).isalnum()]
    stats = [
        len(words),
        share(range(65, 91)),
        share(printable),
        share(range(48, 58)),
        share(b"!#$%&*+<=>@^_`{|}~\\"),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        raw.count(b".") / n,
        100 * raw.count(b"\n") / n,
    ]
    at = quality.WIDTH
    for value, (_, edges) in zip(stats, quality.EDGES):
        out[at + bisect_right(edges, value)] = 1.0
        at += len(edges) + 1
    edges = quality.META_EDGES.tolist()
    out[at + (len(edges) + 1 if n_chars is None else bisect_right(edges, n_chars))] = 1.0
    return out


def plain_score(model, text, n_chars):
    """All pairs of features one by one."""
    x = sorted(plain_features(text, n_chars).items())
    margin = model.w0 + sum(model.w[c] * v for c, v in x)
    for i, (a, u) in enumerate(x):
        margin += sum(float(model.v[a] @ model.v[b]) * u * v for b, v in x[:i])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels", "benchmark")}


def test_scores_from_texts_pair_by_pair(spark, tables):
    model = quality.train(tables["documents"], tables["labels"])
    short = tables["documents"].where("length(text) < 1500").limit(25).select("doc_id", "text", "n_chars")
    odd = spark.createDataFrame([(-1, "", 0), (-2, None, None), (-3, "ONE two TWO two\n\n9.9 é!", 5), (-4, "...", None)], short.schema)
    rows = short.unionByName(odd)
    got = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    for r in rows.collect():
        assert abs(got[r.doc_id] - plain_score(model, r.text, r.n_chars)) < 1e-5


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def holds(own, items, least=0.8):
    """Whether some window of an item's length has that similarity with it by five-word shingles (all its words if it has fewer)."""
    grams = lambda words, g: {tuple(words[i : i + g]) for i in range(len(words) - g + 1)}
    all_of = {g: grams(own, g) for g in range(1, 6)}
    for words in items:
        n, g = len(words), min(5, len(words))
        want = grams(words, g) if n else set()
        if not want & all_of.get(g, set()):
            continue
        for s in range(len(own)):
            got = grams(own[s : s + n], g)
            if got and len(want & got) / len(want | got) >= least:
                return True
    return False


def test_each_stage_of_the_pipeline_keeps_what_a_plain_version_keeps(spark, tables, tmp_path):
    import corpus_pipeline

    def staged(number, docs):
        name, stage = corpus_pipeline.STAGES[number]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    source = tables["documents"]
    model = quality.train(source, tables["labels"])
    scores = {r.doc_id: r.score for r in quality.score(source, model).collect()}
    first = staged(0, source)
    assert {r.doc_id for r in first.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}

    sets = {r.doc_id: shingles(r.text) for r in first.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    second = staged(1, first)
    kept = {i for i in sets if find(i) == i}
    assert {r.doc_id for r in second.collect()} == kept and len(kept) < len(sets)

    items = [plain_words(r.text) for r in tables["benchmark"].collect()]
    hit = {r.doc_id for r in second.collect() if holds(plain_words(r.text), items)}
    third = staged(2, second)
    assert {r.doc_id for r in third.collect()} == kept - hit

    texts = {r.doc_id: r.text for r in third.collect()}
    found = {r.doc_id: r.found for r in secrets.scan(third).collect()}
    fourth = staged(3, third)
    for r in fourth.collect():
        want, at = [], 0
        for s in sorted((x.s, x.e) for x in found[r.doc_id]):
            if s[0] >= at:
                want += [texts[r.doc_id][at : s[0]], "[SECRET]"]
            at = max(at, s[1])
        assert r.text == "".join(want) + texts[r.doc_id][at:]
    packed = staged(4, fourth)
    words = {r.doc_id: 0 for r in fourth.collect()}
    for r in packed.collect():
        words[r.doc_id] += r.n_words
    assert words == {r.doc_id: r.n_words for r in packing.items(fourth).groupBy("doc_id").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "n_words").collect()} | {i: 0 for i, n in words.items() if not n}
