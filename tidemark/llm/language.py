"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word is covered from left to right: at each
character the longest known n-gram (4, then 3, 2, 1 letters, with word-edge marks) that starts there scores
instead. The class with the largest sum wins; the score is its share when the sums, divided by the square root of the number of scored
units, are taken as log odds. A language that never had a word or n-gram counts it half a time.

Words are maximal runs of letters (ASCII letters and every non-ASCII character), lower-cased. Counts come from all
rows of a bounded sample: about SAMPLE rows of each language, by a hash of the id; words and n-grams seen at least LEAST
times in it are kept, so the model's size follows from the sample and not from the table: one entry for each n-gram and language that
had it, however many languages there are.

A null text, or one without any letter, is `und` with score 0; rows with a null id are predicted, are not held
out and never train; a null language never trains; repeated rows are predicted alike; extra columns are not looked
at; without training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_LETTER, find_words, span_hashes, text_slices
from tidemark.llm.quality import bucket

SAMPLE = 2000
#: Least count of a word or n-gram in a language of the sample.
LEAST = 2
LONGEST = 4
EDGE = 0x20


class Table(NamedTuple):
    """Sorted hashes; of hash i the languages langs[starts[i]:starts[i + 1]] that had it, with what that adds to the log frequency of
    what a language never had; and that log frequency of each language."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    never: np.ndarray

    def add(self, total: np.ndarray, row: np.ndarray, hit: np.ndarray, weight: float = 1.0) -> None:
        """Adds to total[row] (rows x languages) the log frequencies of the hashes at the places hit."""
        n, width = total.shape
        total += weight * np.bincount(row, minlength=n)[:, None] * self.never
        size = self.starts[hit + 1] - self.starts[hit]
        at = np.repeat(self.starts[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.repeat(row, size) * width + self.langs[at]
        total += weight * np.bincount(place, self.gains[at], n * width).reshape(n, width)


def _table(part: pd.DataFrame, sums: dict, kind: int, n_langs: int) -> Table:
    part = part.sort_values(["key", "lang"])
    keys, starts = np.unique(part["key"].to_numpy(np.uint64), return_index=True)
    base = np.array([sums.get((kind, x), 0) + 0.5 * max(len(keys), 1) for x in range(n_langs)])
    gains = np.log((0.5 + part["n"].to_numpy()) / 0.5)
    return Table(keys, np.append(starts, len(part)).astype(np.int64), part["lang"].to_numpy(np.int64), gains, np.log(0.5 / base))


class Model(NamedTuple):
    """langs, and a table of the words (0) and of the n-grams of each length (n)."""

    langs: list[str]
    tables: list[Table]

    def find(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the table of words (0) or of n-grams (n), -1 where unknown."""
        keys = self.tables[kind].keys
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words one after another, each between edge marks: (bytes, starts, ends) with the marks."""
    size = ends - starts + 2
    stops = np.cumsum(size)
    out = np.full(int(stops[-1]) if len(stops) else 0, EDGE, np.uint8)
    heads = stops - size
    source = np.arange(len(out)) - np.repeat(heads, size) - 1 + np.repeat(starts, size)
    inner = np.ones(len(out), bool)
    inner[heads] = inner[stops - 1] = False
    out[inner] = data[source[inner]]
    return out, heads, stops


def gram_spans(data: np.ndarray, heads: np.ndarray, stops: np.ndarray):
    """(char starts, word of each char, end of the n-gram of n = 1..LONGEST characters from each, 0 if it leaves
    the word), by whole UTF-8 characters."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.searchsorted(heads, chars, "right") - 1
    after = np.append(chars[1:], len(data))
    ends = []
    for n in range(1, LONGEST + 1):
        end = np.append(after[n - 1 :], np.full(min(n - 1, len(chars)), len(data) + 1)) if len(chars) else after[:0]
        ends.append(np.where(end <= stops[word], end, 0))
    return chars, word, ends


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows that are not held out and whose language is known."""
    rows = documents.where("lang is not null and doc_id is not null and text is not null").where(bucket("doc_id", 5) != 0)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [])
    shares = documents.sparkSession.createDataFrame([(lang, sample / n) for lang, n in totals.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20))
    rows = rows.join(F.broadcast(shares), "lang").where(chance < F.col("share") * (1 << 20)).select("text", "lang")
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([t.lower() for t in batch.column("text").to_pylist()], pa.string())
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int32)
            for at, to, data, bounds in text_slices(texts):
                starts, ends, first = find_words(data, bounds, NOT_LETTER)
                own = np.repeat(lang[at:to], np.diff(first))
                found = [(0, own, span_hashes(data, starts, ends))]
                padded, heads, stops = _padded(data, starts, ends)
                chars, word, stops_of = gram_spans(padded, heads, stops)
                for n, end in enumerate(stops_of, 1):
                    held = end > 0
                    found.append((n, own[word[held]], span_hashes(padded, chars[held], end[held])))
                for kind, who, hashes in found:
                    order = np.lexsort((hashes, who))
                    who, hashes = who[order], hashes[order]
                    new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1]))) if len(who) else order
                    yield pa.RecordBatch.from_pydict(
                        {
                            "kind": pa.array(np.full(len(new), kind), pa.int32()),
                            "lang": pa.array(who[new], pa.int32()),
                            "h": pa.array(hashes[new].view(np.int64), pa.int64()),
                            "n": pa.array(np.diff(np.append(new, len(who))), pa.int64()),
                        }
                    )

    counts = rows.mapInArrow(count, "kind int, lang int, h bigint, n bigint").groupBy("kind", "lang", "h").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind", "lang"))
    kept = counts.withColumn("total", total).where(F.col("n") >= LEAST).toPandas()
    sums = {(k, x): t for k, x, t in kept[["kind", "lang", "total"]].drop_duplicates().itertuples(index=False)}
    kept["key"] = kept["h"].to_numpy(np.int64).view(np.uint64)
    return Model(langs, [_table(kept[kept["kind"] == kind], sums, kind, len(langs)) for kind in range(LONGEST + 1)])


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lower = pa.array([(t or "").lower() for t in texts], pa.string())
    names, best = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, best
    for at, to, data, bounds in text_slices(lower, 1 << 19):
        n = to - at
        starts, ends, first = find_words(data, bounds, NOT_LETTER)
        row = np.repeat(np.arange(n), np.diff(first))
        found = model.find(0, span_hashes(data, starts, ends))
        known = found >= 0
        total = np.zeros((n, len(model.langs)))
        model.tables[0].add(total, row[known], found[known])
        units = np.bincount(row[known], minlength=n).astype(float)
        if not known.all():
            padded, heads, stops = _padded(data, starts[~known], ends[~known])
            own = row[~known]
            chars, word, gram_ends = gram_spans(padded, heads, stops)
            left = np.ones(len(chars), bool)
            for k in range(LONGEST, 0, -1):
                idx = np.flatnonzero(left & (gram_ends[k - 1] > 0))
                hit = model.find(k, span_hashes(padded, chars[idx], gram_ends[k - 1][idx]))
                idx, hit = idx[hit >= 0], hit[hit >= 0]
                left[idx] = False
                model.tables[k].add(total, own[word[idx]], hit, 1 / LONGEST)
                units += np.bincount(own[word[idx]], minlength=n) / LONGEST
        shifted = total - total.max(1, keepdims=True)
        share = np.exp(shifted / np.maximum(np.sqrt(units), 1)[:, None])
        share /= share.sum(1, keepdims=True)
        top = total.argmax(1)
        ascii_letters = np.zeros(256, bool)
        ascii_letters[97:123] = True
        letters = np.diff(np.concatenate([[0], np.cumsum(ascii_letters[data])])[bounds]) > 0
        for i in range(n):
            text = texts[at + i]
            if text is not None and (letters[i] or any(map(str.isalpha, text))):
                names[at + i], best[at + i] = model.langs[top[i]], share[i, top[i]]
    return names, best


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, best = predict_texts(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(best, pa.float64())})

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
