import hashlib

import pytest

from tidemark.llm import warc


def expected(rows):
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        ids = [p for p, h in rows if (h or "").encode() == body and p is not None]
        first = min(ids) if ids else None
        revisit = len(body) >= 100 and len([1 for _, h in rows if (h or "").encode() == body]) > 1 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [300, 1 << 22])
def test_roundtrip_with_magic_inside_payloads(spark, block_bytes):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [
        (1, "<p>" + "x" * 200),
        (2, "<p>" + "x" * 200),
        (3, "short"),
        (4, "short"),
        (5, None),
        (6, ""),
        (7, "before " + fake + fake + " after é"),
        (8, "WARC/1.0\r\n"),
        (9, "a WARC/1.0\r\nContent-Length: 99999\r\nWARC-Type: response\r\n\r\n b\r\n\r\n" * 9),
        (None, "<p>" + "x" * 200),
        (10, "tail\r\n\r\nWARC/1.0\r\n"),
    ]
    pages = spark.createDataFrame([(p, f"http://a/{p}\n x", h, "u") for p, h in rows], "page_id bigint, url string, html string, off string")
    got = [tuple(r) for r in warc.roundtrip(pages.repartition(2), block_bytes).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.roundtrip(pages).count() == 0


def test_header_parsing():
    assert warc.parse_header(b"no header") is None
    assert warc.parse_header(b"A: b\r\n\r\n") is None
    header = b"WARC-Type: x\r\nContent-Length: 3\r\n\r\n"
    assert warc.parse_header(header + b"abc") == ({"warc-type": "x", "content-length": "3"}, len(header))
