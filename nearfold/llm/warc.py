"""WARC archives: a writer, and a reader that salvages what it can.

Archives are gzip files of one member per record.  The reader first takes each member at its word: a whole
gzip stream with a right checksum that holds a record with a right length and right digests.  After a
failed check it searches on: inside the archive for the next place where a gzip member opens and yields a
version line, inside plain bytes for the next version line that a parsable header follows.  Records after
a damage are recovered; every byte range that gave none is logged as quarantined, with the reason.

The reader is linear in the bytes: a header is looked for in its first MOST_HEADER bytes alone, the next member's place is
kept while damaged records before it are passed, and no byte range is searched twice for the same thing.

A block digest is of the whole block.  A payload digest is of what an HTTP message carries where the block is one (content
type application/http), also as it was before chunked transfer, else of the block.  sha1, sha256 and md5 are checked, in
base 16 or 32; others aren't, nor are payload digests of parts of a record and of truncated ones.

Archive images travel as rows (archive, image), so they can lie in any store that Spark reaches; export_archives
and open_archives make files of them and read files.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import spread_join

VERSION = b"WARC/1.1"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_MEMBER = b"\x1f\x8b\x08"
LEAST_DEDUP = 100
#: A record's header is at most so long.
MOST_HEADER = 1 << 16
_CLOSED = re.compile(rb"\r\n\r\n|\n\n")
_END = re.compile(rb"\r?\n\r?\n")
_TARGET = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    """Quarantined bytes start..end of an archive."""

    start: int
    end: int
    reason: str


def format_record(headers: dict[str, str], payload: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    return VERSION + b"\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _body(headers: dict[str, str], block: bytes) -> bytes:
    """What the HTTP message of a block carries; the block where it is none."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    head = _CLOSED.search(block, 0, MOST_HEADER)
    return block[head.end() :] if head else b""


def _unchunked(body: bytes) -> bytes | None:
    """A body as it was before chunked transfer; None if it isn't chunked."""
    parts, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]{0,200}\r?\n").match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(parts)
        parts.append(body[m.end() : m.end() + n])
        end = re.compile(rb"\r?\n").match(body, m.end() + n)
        if not end:
            return None
        at = end.end()
    return None


def digest_fits(written: str, data: bytes) -> bool | None:
    """Whether a written digest (algorithm:value) is that of data; None if it can't be told."""
    kind, colon, value = written.strip().partition(":")
    kind = kind.lower().replace("-", "")
    if not colon or kind not in ("sha1", "sha256", "md5"):
        return None
    made = hashlib.new(kind, data)
    if len(value) == 2 * made.digest_size:
        return made.hexdigest() == value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)) == made.digest()
    except binascii.Error:
        return False


def _check(headers: dict[str, str], block: bytes, body: bytes) -> None:
    """ValueError if a digest differs."""
    if digest_fits(headers.get("warc-block-digest", ""), block) is False:
        raise ValueError("block digest differs")
    written = headers.get("warc-payload-digest", "")
    whole = headers.get("warc-type") != "revisit" and "warc-segment-number" not in headers and "warc-truncated" not in headers
    if written and whole and digest_fits(written, body) is False:
        plain = _unchunked(body) if body is not block else None
        if plain is None or not digest_fits(written, plain):
            raise ValueError("payload digest differs")


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at `at` and the place after it; ValueError if a check fails."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    closed = _CLOSED.search(data, at, at + MOST_HEADER)
    if not closed:
        raise ValueError("header isn't closed")
    headers: dict[str, str] = {}
    for line in data[m.end() : closed.start()].split(b"\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise ValueError("no content length")
    begin = closed.end()
    end = begin + int(headers["content-length"])
    if end > len(data):
        raise ValueError("payload is cut off")
    tail = _END.match(data, end)
    if not tail:
        raise ValueError("record has no end mark")
    block = data[begin:end]
    body = _body(headers, block)
    _check(headers, block, body)
    return Record(headers, body), tail.end()


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """The member that starts at `at`: its text, or what there is of it before a damage, the place after it, what is
    wrong (empty: nothing), and some places of the archive with how much text was there."""
    z = zlib.decompressobj(31)
    parts: list[bytes] = []
    marks = [(at, 0)]
    k, size, step = at, 0, 1 << 16
    wrong = ""
    while not z.eof:
        if k >= len(data):
            wrong = "member is cut off"
            break
        before = z.copy()
        try:
            part = z.decompress(data[k : k + step])
        except zlib.error as e:
            if step == 64:
                wrong = f"bad member: {e}"
                break
            z, step = before, 64  # as near to the damage as can be
            continue
        parts.append(part)
        size += len(part)
        k += step
        marks.append((min(k, len(data)), size))
    return b"".join(parts), len(data) if wrong else min(k, len(data)) - len(z.unused_data), wrong, marks


def _opens(data: bytes, at: int) -> bool:
    """Whether a member at `at` begins with a version line."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 512], 16)))
    except zlib.error:
        return False


def _version_line(data: bytes, at: int, stop: int) -> int:
    """The next place before stop where a version line stands that a header line follows; -1 if none."""
    while m := _VERSION.search(data, at, stop):
        if re.match(rb"[A-Za-z0-9-]+:", data[m.end() : m.end() + 80]):
            return m.start()
        at = m.start() + 1
    return -1


def _next_member(data: bytes, at: int) -> int:
    """Where a member that opens on a version line comes next; else the end."""
    found = data.find(_MEMBER, at)
    while found >= 0 and not _opens(data, found):
        found = data.find(_MEMBER, found + 1)
    return found if found >= 0 else len(data)


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be recovered, in order, and the gaps between them.

    A member that is damaged or cut off still gives the records before the damage; the gap is what follows the last
    of them.  A record that fails its checks inside a sound member is a gap of the whole member, beside the records
    that it still gives.
    """
    at = 0
    member_at = -1  # where the next member opens, once it was looked for
    while at < len(data):
        try:
            if data.startswith(_MEMBER, at):
                body, end, wrong, marks = _inflate(data, at)
                k = 0
                while k < len(body):
                    try:
                        record, k = parse_record(body, k)
                        yield record
                    except ValueError as e:
                        later = _version_line(body, k + 1, len(body))
                        if not wrong or later >= 0:
                            yield Gap(at, min(end, marks[-1][0]), str(e))
                        if later < 0:
                            break
                        k = later
                if wrong:
                    told = max(n for _, n in marks if n <= k)
                    at = min(a for a, n in marks if n == told)
                    raise ValueError(wrong)
                if not body:
                    yield Gap(at, end, "empty member")
            else:
                record, end = parse_record(data, at)
                yield record
        except ValueError as e:
            if member_at <= at:
                member_at = _next_member(data, at + 1)
            line_at = _version_line(data, at + 1, member_at)
            end = line_at if line_at >= 0 else member_at
            yield Gap(at, end, str(e))
        at = end


# ---------------------------------------------------------------- tables


def classify(pages: DataFrame, least: int = LEAST_DEDUP) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least `least` bytes the smallest page_id is the response.  Only (page_id, digest)
    groups, with a minimum per digest taken before the shuffle.  Pages of a payload that is a large share of all
    stay where they are read; the others are dealt by digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    firsts = sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = Scratch(pages.sparkSession, "firsts").save(firsts.where("n > 1"), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    j = spread_join(sized, firsts, ["payload_digest"], "n", total)
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    return j.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _write(most: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: list[bytes] = []
        size = unnamed = 0
        for batch in batches:
            for page_id, url, html, n, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id is None:  # told by its place
                    unnamed += 1
                    urn = uuid.uuid5(uuid.NAMESPACE_OID, f"{digest} {TaskContext.get().partitionId()} {unnamed}").urn
                else:
                    urn = f"urn:page:{page_id}"
                head = {"WARC-Type": kind, "WARC-Record-ID": f"<{urn}>", "WARC-Date": date}
                if url is not None:
                    head["WARC-Target-URI"] = _TARGET.sub("", url)
                head["WARC-Payload-Digest"] = f"sha256:{digest}"
                if kind == "revisit":
                    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>", "X-Payload-Length": str(n)}
                parts.append(member(format_record(head, b"" if kind == "revisit" else html.encode()), level))
                size += len(parts[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["image"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["image"])

    return run


def write_archives(pages: DataFrame, most: int = 8 << 20, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive images of about `most` bytes from classified pages.  date: what records give as theirs, so that reruns
    agree; a record is held whole by its task, as its row is."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.mapInArrow(_write(most, level, date), "image binary")


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap_start", "gap_end", "reason"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for image in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for x in read_archive(image.as_py()):
                if isinstance(x, Gap):
                    rows.append((None,) * 7 + (x.start, x.end, x.reason))
                else:
                    h = x.headers
                    kind = h.get("warc-type")
                    n = int(h["x-payload-length"]) if kind == "revisit" and h.get("x-payload-length", "").isdigit() else len(x.payload)
                    rows.append((_number(h.get("warc-record-id")), h.get("warc-target-uri"), x.payload, n, h.get("warc-payload-digest", "").removeprefix("sha256:"), kind, _number(h.get("warc-refers-to")), None, None, None))
                    held += len(x.payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records (gap_start null) and quarantined gaps (reason not null) of archive images."""
    return archives.select("image").mapInArrow(
        _read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_end long, reason string"
    )


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive image as a file NAME.warc.gz under folder; (path, size) of the files.

    folder: a path or URI that pyarrow's file systems know and all workers reach.  A file's name is told by its
    partition, place and content and it appears under that name when whole, so a task that runs again writes the
    same files; write from a stored table, whose partitions stay.  The result is what makes the files: each action
    on it writes them.  A null image is left out, an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for image in batch.column(0):
                if not image.is_valid:
                    continue
                data = image.as_buffer()
                name = f"part-{part:06d}-{k:06d}-{hashlib.sha256(data).hexdigest()[:16]}.warc.gz"
                early = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(early, compression=None) as out:
                    out.write(data)
                store.move(early, f"{root}/{name}")
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([data.size], pa.int64())], names=["path", "size"])

    return archives.select("image").mapInArrow(run, "path string, size long")


def open_archives(spark: SparkSession, folder: str, pattern: str = "*.{warc,warc.gz}") -> DataFrame:
    """(path, image) of the archive files below a folder, of at most 2 GB each, for read_archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("content").alias("image"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back and returns records and gaps.

    Defined results: a null html is an empty payload; a null url has no target line; a null page_id never
    is the response that others refer to and itself stays a response; pages that share the smallest
    page_id and the payload are all responses; an empty table gives no rows; other columns are ignored.
    """
    archives = Scratch(spark, "warc").save(write_archives(classify(pages)), "archives", codec="none")
    return read_archives(archives)


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(spark, pages).where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST_DEDUP} and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST_DEDUP} and page_id > first then first end as refers_to
from f
"""
