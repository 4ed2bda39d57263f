"""The salvage reader on archives as other writers make them, and its time on large ones."""

import base64
import hashlib
import random
import time

import pytest

from nearfold.llm import warc

BODY = b"<html>a page\r\n\r\nwith an empty line</html>"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def digest(kind, data, base=16):
    d = hashlib.new(kind, data).digest()
    return f"{kind}:" + (d.hex() if base == 16 else base64.b32encode(d).decode())


def response(block, **more):
    return warc.format_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/http;msgtype=response"} | {k.replace("_", "-"): v for k, v in more.items()}, block)


def read(data):
    got = list(warc.read_archive(data))
    return [x for x in got if isinstance(x, warc.Record)], [x for x in got if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind,base", [("sha1", 32), ("sha1", 16), ("sha256", 16), ("sha256", 32), ("md5", 16)])
def test_standard_response(kind, base, packed):
    """The payload digest is of what the message carries, the block digest of all."""
    form = warc.member if packed else bytes
    good = response(HEAD + BODY, WARC_Payload_Digest=digest(kind, BODY, base), WARC_Block_Digest=digest("sha1", HEAD + BODY, 32))
    records, gaps = read(form(good))
    assert [r.payload for r in records] == [BODY] and not gaps
    for bad, reason in (
        (response(HEAD + BODY, WARC_Payload_Digest=digest(kind, BODY + b"x", base)), "payload digest differs"),
        (response(HEAD + BODY, WARC_Block_Digest=digest(kind, BODY, base)), "block digest differs"),
        (good.replace(b"a page", b"b page"), "block digest differs"),
    ):
        records, gaps = read(form(good) + form(bad) + form(good))
        assert len(records) == 2 and [g.reason for g in gaps] == [reason]


def test_what_is_not_checked():
    """Unknown algorithms, parts, truncated and revisit records, and bodies sent in chunks."""
    chunked = HEAD + b"5\r\n<html\r\n3;x=y\r\n>ab\r\n0\r\n\r\n"
    fine = [
        response(HEAD + BODY, WARC_Payload_Digest="blake3:00"),
        response(HEAD + BODY, WARC_Payload_Digest=digest("sha1", b"the whole", 32), WARC_Segment_Number="1"),
        response(HEAD + BODY, WARC_Payload_Digest=digest("sha1", b"the whole", 32), WARC_Truncated="length"),
        response(HEAD, WARC_Type="revisit", WARC_Payload_Digest=digest("sha1", BODY, 32)),
        response(chunked, WARC_Payload_Digest=digest("sha1", b"<html>ab", 32)),
        response(chunked, WARC_Payload_Digest=digest("sha1", chunked[len(HEAD) :], 32)),
        response(b"no head at all", WARC_Payload_Digest=digest("sha1", b"", 32)),
        warc.format_record({"WARC-Type": "resource", "WARC-Payload-Digest": digest("sha1", BODY, 32)}, BODY),
    ]
    records, gaps = read(b"".join(fine))
    assert len(records) == len(fine) and not gaps
    assert read(response(chunked, WARC_Payload_Digest=digest("sha1", b"<html>abc", 32)))[1]
    assert warc.digest_fits("sha1:" + "!" * 32, b"") is False and warc.digest_fits("sha1", b"") is None


@pytest.mark.parametrize("damaged", [False, True])
@pytest.mark.parametrize("end", [b"\r\n", b"\n"])
def test_large_plain_archive(damaged, end):
    """Time grows with the bytes: 20 MB of small records, whole or with every second one damaged (18 MB with short line ends)."""
    rng = random.Random(2)
    n = 20_000
    parts = []
    for k in range(n):
        body = rng.randbytes(500).replace(b"WARC/", b"warc/") + b"x" * 300
        record = warc.format_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{k}>", "WARC-Payload-Digest": digest("sha1", body, 32)}, body)
        if end == b"\n":
            record = record.replace(b"\r\n", b"\n", 6)
        parts.append(record.replace(b"x" * 300, b"y" * 300) if damaged and k % 2 else record)
    data = b"".join(parts)
    began = time.process_time()
    records, gaps = read(data)
    took = time.process_time() - began
    assert len(data) > 18_000_000 and len(records) == (n // 2 if damaged else n) and len(gaps) == (n // 2 if damaged else 0)
    assert took < 2


def test_long_header_and_long_record():
    """A header over the bound is a damage, a record of many megabytes is none."""
    big = bytes(30_000_000)
    whole = response(HEAD + big) + warc.format_record({"X": "y" * (warc.MOST_HEADER + 1)}, b"z") + response(HEAD + BODY)
    records, gaps = read(whole)
    assert [len(r.payload) for r in records] == [len(big), len(BODY)] and len(gaps) == 1


def test_written_records(spark):
    """Every record has the mandatory lines; ids are unique, also without a page_id."""
    pages = spark.createDataFrame([(None, "http://a/", "same"), (None, None, "same"), (1, None, None)], "page_id bigint, url string, html string")
    images = warc.write_archives(warc.classify(pages)).collect()
    records = [x for r in images for x in warc.read_archive(bytes(r.image))]
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(x.headers) for x in records)
    assert len({x.headers["warc-record-id"] for x in records}) == 3
