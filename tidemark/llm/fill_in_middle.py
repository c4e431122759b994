"""Fill-in-the-middle transformation by displacement scatter.

A piece of a batch is one array of UTF-8 bytes. The cuts of every text are found by a scan of its token starts; a difference array
gets, where a part begins, the change of the distance from a byte's place to its place in the output, so that one running
sum holds every byte's place and one scatter builds all outputs. Back, the marks of an output are found by a scan, the same kind of
difference array holds the distances of the restored text's bytes, and one gather restores all texts.

Tokens are runs of ASCII letters and single other code points. A null text is an empty one, an empty text is plain. A null doc_id is
hashed as an empty string. Rows that repeat come out equal; an empty table gives no rows. Other columns are kept unless
their name is one of the output's. A text takes about ten bytes of memory a byte, and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_LETTER, text_of, text_slices

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Of a hundred transformed texts and of a hundred texts, how many are suffix-first and how many are transformed.
SUFFIX_FIRST, TRANSFORMED = 20, 90
LETTER = ~NOT_LETTER & (np.arange(256) < 128)
LEAD = (np.arange(256) & 0xC0) != 0x80


def _marks(data: np.ndarray, bounds: np.ndarray, letter: str) -> np.ndarray:
    """Where the mark begins inside a row of the piece."""
    mark = np.frombuffer(MARKS[letter], np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
    end = bounds[np.searchsorted(bounds, at, "right")]
    return at[at + 3 <= end]


def _first_in_row(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first of the sorted places in each row, else the row's end."""
    i = np.searchsorted(at, bounds[:-1])
    found = np.append(at, np.iinfo(np.int64).max)[i]
    return np.minimum(found, bounds[1:])


def _places(n: int, starts: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Place plus shift of each of n bytes: shifts[p][r] holds from starts[p][r] up to the next start."""
    begin, shift = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    last = np.append(begin[1:] != begin[:-1], True) if len(begin) else np.zeros(0, bool)
    begin, shift = begin[last], shift[last]  # of parts that begin together only the last has bytes
    used = begin < n
    begin, shift = begin[used], shift[used]
    step = np.zeros(n, np.int64 if n > 1 << 29 else np.int32)
    step[begin] = np.diff(shift, prepend=0)
    np.cumsum(step, out=step)
    step += np.arange(n, dtype=step.dtype)
    return step


def arrange(data: np.ndarray, bounds: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """Outputs of the rows of a piece; h holds four hashes a row."""
    rows = len(bounds) - 1
    letter = LETTER[data]
    start = LEAD[data] & ~letter
    start[1:] |= letter[1:] & ~letter[:-1]
    head = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[head] = True
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, bounds)
    n = np.diff(first)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    place = np.append(starts, len(data))
    cut = [np.where(u < n, place[first[:-1] + u], bounds[1:]) for u in (np.minimum(a, b), np.maximum(a, b))]
    marked = np.zeros(rows, bool)
    for x in MARKS:
        marked[np.searchsorted(bounds, _marks(data, bounds, x), "right") - 1] = True
    size = np.diff(bounds)
    plain = (size == 0) | marked | (h[:, 2] % 100 >= TRANSFORMED)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    out_bounds = np.concatenate([[0], np.cumsum(size + np.where(plain, 0, 9))])
    base = out_bounds[:-1] - bounds[:-1]
    middle, suffix = cut[1] - cut[0], bounds[1:] - cut[1]
    # psm: <P> prefix <S> suffix <M> middle; spm: <S> suffix <P> prefix <M> middle
    psm = form == PSM
    shift = {
        "P": np.where(plain, base, base + np.where(psm, 3, 6 + suffix)),
        "M": np.where(plain, base, base + 9 + suffix),
        "S": np.where(plain, base, base + np.where(psm, 6, 3 - cut[1] + bounds[:-1]) - np.where(psm, middle, 0)),
    }
    to = _places(len(data), [bounds[:-1], *cut], [shift["P"], shift["M"], shift["S"]])
    out = np.zeros(out_bounds[-1], np.uint8)
    out[to] = data
    moved = np.flatnonzero(~plain)
    prefix = cut[0] - bounds[:-1]
    o = out_bounds[:-1]
    for x, at in (
        ("P", np.where(psm, o, o + 3 + suffix)),
        ("S", np.where(psm, o + 3 + prefix, o)),
        ("M", o + 6 + prefix + suffix),
    ):
        for i, byte in enumerate(MARKS[x]):
            out[at[moved] + i] = byte
    chars = np.concatenate([[0], np.cumsum(LEAD[data])])
    return {
        "n": n,
        "form": form,
        "prefix_chars": chars[cut[0]] - chars[bounds[:-1]],
        "middle_chars": chars[cut[1]] - chars[cut[0]],
        "data": out,
        "bounds": out_bounds,
    }


def rebuild(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts whose outputs and forms these are."""
    plain, psm = form == PLAIN, form == PSM
    at = {x: _first_in_row(_marks(data, bounds, x), bounds) for x in MARKS}
    lo, hi = bounds[:-1], bounds[1:]
    prefix = np.where(plain, 0, np.where(psm, at["S"], at["M"]) - at["P"] - 3)
    suffix = np.where(plain, 0, np.where(psm, at["M"], at["P"]) - at["S"] - 3)
    size = hi - lo - np.where(plain, 0, 9)
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    o = out_bounds[:-1]
    parts = [o, o + prefix, out_bounds[1:] - suffix]
    sources = [np.where(plain, lo, at["P"] + 3), np.where(plain, lo, at["M"] + 3), np.where(plain, lo, at["S"] + 3)]
    take = _places(int(out_bounds[-1]), parts, [s - p for s, p in zip(sources, parts, strict=True)])
    return data[take], out_bounds


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def transform(documents: DataFrame, seed: str = "1:", text: str = "text", ident: str = "doc_id") -> DataFrame:
    """documents without their text, with n (tokens), form, prefix_chars, middle_chars (null if plain) and output."""
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in documents.columns if c.lower() not in {text.lower(), *made}]
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit(""))), 256)
    hashes = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    columns = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = documents.select(columns.alias("kept"), hashes.alias("h"), text_of(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            for a, b, data, bounds in text_slices(batch.column("t")):
                got = arrange(data, bounds, h[a:b])
                plain = got["form"] == PLAIN
                columns = [
                    batch.column("kept").slice(a, b - a),
                    pa.array(got["n"], pa.int64()),
                    pa.array(np.array(FORMS, object)[got["form"]], pa.string()),
                    *[pa.array(got[c], pa.int64(), mask=plain) for c in ("prefix_chars", "middle_chars")],
                    _strings(got["data"], got["bounds"]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["kept", *made])

    kinds = ["long", "string", "long", "long", "string"]
    schema = rows.select("kept", *[F.expr(f"cast(null as {kind})").alias(c) for c, kind in zip(made, kinds, strict=True)]).schema
    return rows.mapInArrow(run, schema).select(*[F.col("kept")[c].alias(c) for c in kept], *made)


def restore(rows: DataFrame) -> DataFrame:
    """rows(form, output, ...) with restored: the text rebuilt from these two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(FORMS)}
        for batch in batches:
            form = np.array([number[f] for f in batch.column("form").to_pylist()], np.int64)
            for a, b, data, bounds in text_slices(batch.column("output")):
                text = _strings(*rebuild(data, bounds, form[a:b]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], schema.names)

    schema = rows.select("*", F.lit("").alias("restored")).schema
    return rows.mapInArrow(run, schema)


def oracle_sql() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
