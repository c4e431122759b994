"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document: its words (lower-cased runs of letters, hashed to 2 ** BITS columns, weighted by log
counts, unit length), bucketed structure statistics of the text, and the bucketed length in the n_chars column
(or its absence). The score is sigmoid(w0 + w.x + pairwise), and the pairwise term of all feature pairs takes
linear time by half the sum over factors of (sum v x)^2 - sum (v x)^2.

Training reads a bounded sample of labelled rows (TRAIN_ROWS, the rows with the smallest hash of the id); their
features, not their texts, reach the driver. Scoring is one pass of Arrow batches without a shuffle.

Null and empty texts score like a text without words; rows with a null id are scored, are not held out and never
train; repeated rows score alike; extra columns are not looked at; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, NOT_LETTER, find_words, span_hashes, text_slices

BITS = 13
FACTORS = 6
TRAIN_ROWS = 6000
EPOCHS = 8
BATCH = 128
RATE = 0.03
THRESHOLD = 0.7

#: Bucket edges of the structure statistics, in the order structure() returns them.
EDGES = [
    ("words", [1, 5, 20, 50, 200, 1000, 5000]),
    ("upper", [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7]),
    ("symbols", [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2]),
    ("digits", [0.001, 0.01, 0.03, 0.1, 0.3]),
    ("odd symbols", [0.0005, 0.002, 0.01, 0.03, 0.1]),
    ("word length", [2, 3, 4, 5, 6, 8, 12]),
    ("distinct", [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]),
    ("repeats", [0.005, 0.02, 0.05, 0.1, 0.3, 0.6]),
    ("stops", [0.005, 0.01, 0.02, 0.05, 0.1, 0.2]),
    ("lines", [0.5, 1, 2, 4, 8, 16]),
]
WIDTH = 1 << BITS
STARTS = WIDTH + np.cumsum([0] + [len(e) + 1 for _, e in EDGES])
META = int(STARTS[-1])
META_EDGES = np.array([1, 50, 200, 500, 1000, 2000, 5000, 20000])
SIZE = META + len(META_EDGES) + 2

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "!#$%&*+<=>@^_`{|}~\\"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def structure(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The statistics of EDGES, one row per document."""
    size = np.maximum(np.diff(bounds), 1)
    n = np.diff(first)
    safe = np.maximum(n, 1)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][n > 0]] = False
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]) if len(n) else n
    lines = _per_row(data == 10, bounds)
    return np.stack(
        [
            n,
            _per_row(_UPPER[data], bounds) / size,
            _per_row(_PUNCTUATION[data], bounds) / size,
            _per_row(_DIGIT[data], bounds) / size,
            _per_row(_ODD[data], bounds) / size,
            np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) / safe,
            distinct / safe,
            np.diff(np.concatenate([[0], np.cumsum(same)])[first]) / safe,
            _per_row(data == ord("."), bounds) / safe,
            100 * lines / safe,
        ],
        1,
    )


def features(texts: pa.Array, lengths: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, values) of each row."""
    lengths = np.array([np.nan if x is None else x for x in lengths.to_pylist()], float)
    meta = np.where(np.isnan(lengths), META + len(META_EDGES) + 1, META + np.searchsorted(META_EDGES, lengths, "right"))
    for at, to, data, bounds in text_slices(texts):
        starts, ends, first = find_words(data, bounds, NOT_LETTER)
        words = span_hashes(LOWER[data], starts, ends)
        stats = structure(data, bounds, first, starts, ends, words)
        fixed = np.stack([STARTS[j] + np.searchsorted(e, stats[:, j], "right") for j, (_, e) in enumerate(EDGES)], 1)
        columns = (words >> np.uint64(64 - BITS)).astype(np.int64)
        for i in range(to - at):
            own, count = np.unique(columns[first[i] : first[i + 1]], return_counts=True)
            value = np.log1p(count)
            value /= max(np.sqrt((value**2).sum()), 1e-12)
            yield (
                np.concatenate([own, fixed[i], [meta[at + i]]]).astype(np.int32),
                np.concatenate([value, np.ones(len(EDGES) + 1)]).astype(np.float32),
            )


def _rows(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.concatenate([[0], np.cumsum([len(c) for c, _ in found])])[:-1]
    return np.concatenate([c for c, _ in found]), np.concatenate([v for _, v in found]).astype(np.float64), heads


class FactorisationMachine:
    """w0, w (SIZE) and V (SIZE x FACTORS)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margins(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        columns, values, heads = _rows(found)
        vx = self.v[columns] * values[:, None]
        total = np.add.reduceat(vx, heads)
        squares = np.add.reduceat((vx**2).sum(1), heads)
        return self.w0 + np.add.reduceat(self.w[columns] * values, heads) + 0.5 * ((total**2).sum(1) - squares)

    @classmethod
    def fit(cls, found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
        """Logistic loss by Adam over shuffled mini-batches; the same rows in the same order give the same model."""
        rng = np.random.default_rng(seed)
        model = cls(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
        if not len(found) or len(set(labels.tolist())) < 2:
            model.w0 = 0.0 if not len(found) else (3.0 if labels.mean() > 0.5 else -3.0)
            model.v[:] = 0
            return model
        theta = [np.zeros(1), model.w, model.v]
        moment = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(found))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                columns, values, heads = _rows([found[i] for i in part])
                row = np.repeat(np.arange(len(part)), np.diff(np.append(heads, len(columns))))
                vx = theta[2][columns] * values[:, None]
                total = np.add.reduceat(vx, heads)
                z = theta[0][0] + np.add.reduceat(theta[1][columns] * values, heads)
                z = z + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), heads))
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
                g = slope[row] * values
                touched, back = np.unique(columns, return_inverse=True)
                gw = np.bincount(back, g, len(touched)) + 1e-5 * theta[1][touched]
                gv = g[:, None] * (total[row] - vx)
                gv = np.stack([np.bincount(back, gv[:, f], len(touched)) for f in range(FACTORS)], 1) + 1e-4 * theta[2][touched]
                step += 1
                for t, (m, s), idx, grad in zip(theta, moment, (slice(None), touched, touched), (slope.sum(keepdims=True), gw, gv), strict=True):
                    m[idx] = 0.9 * m[idx] + 0.1 * grad
                    s[idx] = 0.999 * s[idx] + 0.001 * grad**2
                    t[idx] -= RATE * (m[idx] / (1 - 0.9**step)) / (np.sqrt(s[idx] / (1 - 0.999**step)) + 1e-8)
        model.w0, model.w, model.v = float(theta[0][0]), theta[1], theta[2]
        return model


def bucket(id_col: str, modulus: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fits on at most `rows` labelled documents outside the held-out remainder."""
    labels = labels.where("doc_id is not null and quality is not null").where(bucket("doc_id", 4) != 2)
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"), _length(documents)).join(F.broadcast(sample), "doc_id")
    # rows that repeat an id count once: the driver gets at most `rows` of them
    chosen = chosen.groupBy("doc_id", "__quality").agg(F.min(F.struct("text", "n_chars")).alias("x")).select("doc_id", "__quality", "x.text", "x.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column("text"), batch.column("n_chars")))
            if found:
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "quality": batch.column("__quality").cast(pa.int64()),
                        "c": pa.array([c for c, _ in found], pa.list_(pa.int32())),
                        "v": pa.array([v for _, v in found], pa.list_(pa.float32())),
                    }
                )

    shaped = chosen.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "n_chars", "__quality")
    rows_in = shaped.mapInArrow(run, "doc_id bigint, quality bigint, c array<int>, v array<float>").toArrow()
    rows_in = rows_in.sort_by([("doc_id", "ascending")]).combine_chunks()
    c, v = rows_in.column("c"), rows_in.column("v")
    found = [(c[i].values.to_numpy(), v[i].values.to_numpy()) for i in range(len(rows_in))]
    return FactorisationMachine.fit(found, rows_in.column("quality").to_numpy().astype(float))


def _length(documents: DataFrame):
    held = "n_chars" in documents.columns
    length = F.col("n_chars").try_cast("double") if held else F.lit(None).cast("double")
    return length.alias("n_chars")


def score(documents: DataFrame, model: FactorisationMachine, keep: list[str] | None = None) -> DataFrame:
    """The columns of documents named in keep (default doc_id) and `score`, per row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    rows = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("t"), _length(documents))
    schema = rows.select(*[f"k{i}" for i in range(len(keep))], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z, held = [], []
            for one in features(batch.column("t"), batch.column("n_chars")):
                held.append(one)
                if len(held) == 256:
                    z.append(model.margins(held))
                    held = []
            if held:
                z.append(model.margins(held))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30))) if z else np.zeros(0)
            columns = [batch.column(f"k{i}") for i in range(len(keep))] + [pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*[f"k{i}" for i in range(len(keep))], "score"])

    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")
