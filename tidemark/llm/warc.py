"""WARC writing and reading, with record boundaries proved by a chain from the start of each file.

write(): one record per page. Of equal payloads of at least DEDUP_BYTES bytes the record with the smallest page_id
is the response and the others are revisits that carry its id, digest and length but no payload. Records go
through Spark's text sink, whose line separator is the blank line that ends a record, so tasks that are lost
or repeated leave whole files only.

read(): a task meets the magic wherever its byte range holds it, inside payloads too, and emits each as a candidate
with the offset of its successor (end of header + Content-Length + 4). A candidate is a record only if the chain from
offset 0 of its file reaches it. The chain is followed inside blocks of BLOCK_BYTES first; then the blocks'
exits are followed by pointer jumping, which doubles the distance in each round.

A null or empty html is an empty payload; a null url is an empty one; control characters in a url are percent-coded;
pages with a null page_id are written, order last among equal payloads, and come back with null; repeated rows with
the id of a response are responses; extra columns are not written. A file whose chain breaks keeps the records before
the break.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratch_path, scratch_scope, skew_join, text_of

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
CRLF = "\r\n"

DEDUP_BYTES = 100
BLOCK_BYTES = 4 << 20
#: Most repeated digests that are broadcast.
SMALL = 200_000
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """page_id and `record`: the text of each WARC record without the closing blank line."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(text_of("url"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        text_of("html").alias("payload"),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.where(F.col("bytes") >= DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first")
    first = materialize(first, "first")
    # without the broadcast every payload is shuffled
    rows = rows.join(F.broadcast(first), "digest", "left") if first.count() <= SMALL else skew_join(rows, first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {DATE}"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("first")))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    return rows.select("page_id", F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, path: str) -> None:
    records(pages).select("record").write.option("lineSep", CRLF + CRLF).text(path)


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """(fields, length of the header) of what follows a magic, or None if it is no header."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split(CRLF):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return None
        fields[name.lower()] = value.strip()
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return None
    return fields, end + 4


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the scanned byte range) and what lies between two magics, in file order."""
    rows = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return rows.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("data")).toDF("file", "block", "data")


_SEGMENT = "file string, block bigint, local bigint, size bigint"
_FIELDS = "head bigint, length bigint, kind string, id string, refers string, payload_bytes bigint, digest string"


def _walk(make):
    """A mapInArrow function over a scan: rows reach a task in file order, so a running sum gives each segment's
    offset within its scanned range; make(data) returns the further columns' values, or None to leave it out."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, int] = {}
        for batch in batches:
            rows = []
            for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                local = at.get((file, block), 0)
                at = {(file, block): local + len(data) + len(MAGIC)}
                more = make(data)
                if more is not None:
                    rows.append((file, block, local, len(data), *more))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _mapped(rows: DataFrame, make, schema: str) -> DataFrame:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    run = _walk(make)
    return rows.mapInArrow(lambda batches: run(batches, arrow), schema)


def _candidate(data: bytes) -> tuple:
    """Header length, content length, type, id, refers-to, and the payload's size and digest where it is whole."""
    found = parse_header(data)
    if found is None:
        return (None,) * 7
    fields, head = found
    length = int(fields["content-length"])
    kind = fields["warc-type"]
    if length >= 1 << 62:
        return (None,) * 7
    size, digest = None, None
    if head + length <= len(data):
        size, digest = length, hashlib.sha256(data[head : head + length]).hexdigest()
    if kind == "revisit":
        declared = fields.get("warc-payload-length", "")
        size = int(declared) if declared.isdecimal() else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    return head, length, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), size, digest


def _with_offsets(rows: DataFrame, bases: DataFrame) -> DataFrame:
    return rows.join(bases, ["file", "block"]).withColumn("off", F.col("base") + F.col("local") - len(MAGIC)).drop("base", "block", "local")


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidate records: file, off, next and header fields; base offset of each scanned range)."""
    rows = materialize(_mapped(_segments(spark, path), _candidate, f"{_SEGMENT}, {_FIELDS}"), "segments")
    sizes = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("own"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    bases = materialize(bases, "bases")
    found = _with_offsets(rows, bases).where("off >= 0 and head is not null")
    return found.withColumn("next", F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + 4), bases


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For one block of a file: where the chain from each candidate leaves the block (null: it breaks)."""
    rows = rows.sort_values("off", ascending=False)
    last, out = {}, []
    block = rows["blk"].iloc[0] if len(rows) else 0
    for off, after, size in zip(rows["off"], rows["next"], rows["bytes"], strict=True):
        last[off] = after if after // size != block else last.get(after, -1)
        out.append(last[off])
    rows = rows.assign(exit=out)
    return rows.loc[rows["exit"] >= 0, ["file", "off", "exit"]]


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    """For one block of a file: the candidates on the chain from the block's entry."""
    after = dict(zip(rows["off"], rows["next"], strict=True))
    at, out = rows["entry"].iloc[0], []
    while at in after:
        out.append(at)
        at = after[at]
    return pd.DataFrame({"file": rows["file"].iloc[0], "off": out})


def verify_chain(found: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, off) of the candidates that the chain from offset 0 of their file reaches."""
    links = found.select("file", "off", "next", F.floor(F.col("off") / block_bytes).alias("blk")).distinct()
    links = materialize(links.withColumn("bytes", F.lit(block_bytes)), "links")
    exits = materialize(links.groupBy("file", "blk").applyInPandas(_exits, "file string, off bigint, exit bigint"), "exits")
    # jumps matter only from where a file or a block's chain can begin
    begins = exits.select("file", F.col("exit").alias("off")).distinct().unionByName(exits.where("off = 0").select("file", "off")).distinct()
    jumps = materialize(exits.join(begins, ["file", "off"]), "jumps")
    reached = links.where("off = 0").select("file", "off")
    most = links.agg(F.max("blk")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        step = reached.join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
        reached = materialize(reached.unionByName(step).distinct(), "reached")
        if most == 0:
            break
        twice = jumps.join(jumps.toDF("file", "exit", "far"), ["file", "exit"], "left")
        jumps = materialize(twice.select("file", "off", F.coalesce("far", "exit").alias("exit")), "jumps")
    entries = reached.select("file", F.floor(F.col("off") / block_bytes).alias("blk"), F.col("off").alias("entry"))
    held = links.join(entries, ["file", "blk"])
    return held.groupBy("file", "blk", "entry").applyInPandas(_reached, "file string, off bigint")


def read(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, off, kind, id, refers, payload_bytes and digest of every record of the archives under path. The
    payload of a record with magic inside is put together from the segments it spans."""
    with scratch_scope() as keep:
        found, bases = candidates(spark, path)
        whole = found.join(verify_chain(found, block_bytes), ["file", "off"])
        whole = materialize(whole.select("file", "off", "next", "head", "length", "kind", "id", "refers", "payload_bytes", "digest"), "whole")
        keep(whole)
        keep(bases)
    split = whole.where("digest is null")
    if split.isEmpty():
        return whole.drop("next", "head", "length")
    # segments of the files that hold such records, each compared with the records of its own blocks only
    files = materialize(split.select("file").distinct(), "files")
    raw = _segments(spark, path)
    raw = raw.join(F.broadcast(files), "file", "left_semi").select(*raw.columns) if files.count() <= SMALL else raw
    parts = _with_offsets(_mapped(raw, lambda data: (data,), f"{_SEGMENT}, data binary"), bases)
    parts = parts.withColumn("blk", F.floor(F.col("off") / block_bytes))
    blocks = F.sequence(F.floor(F.col("off") / block_bytes), F.floor((F.col("next") - 1) / block_bytes))
    spans = split.select("file", F.explode(blocks).alias("blk"), F.col("off").alias("own"), "next", "head", "length")
    parts = parts.join(spans, ["file", "blk"]).where("off >= own and off < next")
    parts = parts.groupBy("file", F.col("own").alias("off"), "head", "length").agg(F.sort_array(F.collect_list(F.struct("off", "data"))).alias("p"))
    joined = F.expr(f"aggregate(p, cast('' as binary), (a, x) -> concat(a, cast('{MAGIC.strip()}\\r\\n' as binary), x.data))")
    payload = F.expr(f"substring(b, {len(MAGIC)} + head + 1, length)")
    parts = parts.withColumn("b", joined).select("file", "off", F.sha2(payload, 256).alias("own_digest"), F.octet_length(payload).cast("long").alias("own_bytes"))
    whole = whole.join(parts, ["file", "off"], "left")
    whole = whole.withColumn("digest", F.coalesce("digest", "own_digest")).withColumn("payload_bytes", F.coalesce("payload_bytes", "own_bytes"))
    return whole.select("file", "off", "kind", "id", "refers", "payload_bytes", "digest")


def roundtrip(pages: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type and refers_to per page."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).cast("string")
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read(pages.sparkSession, path, block_bytes).select(
        as_long(F.col("id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        as_long(F.col("refers")).alias("refers_to"),
    )
