"""Token ids in patched frame-of-reference blocks.

File image, little-endian:

    magic "PFR1", n_docs u32, n_ids u64, n_blocks u32, size of the document table u32
    document table   zlib: doc_id i64 x n_docs, null flags, n_tokens u32 x n_docs
    block index      per block: minimum u32, width u8, exceptions u16, start of its payload u64
    payload          per block: packed low bits, then positions u8, then high parts u32

A block holds 128 ids (the last may be shorter and is padded with its minimum).  From each the minimum is
subtracted; the width is the number of bits that the given percentile of the remainders needs; ids that
need more keep their low bits in place and their high part in the exception list.  The index makes any
block readable by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import text_encoder, with_end
from .scratch import Scratch

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90
#: The driver and every task hold a cut point for each.
MOST_SHARDS = 20_000
_HEAD = struct.Struct("<4sIQII")
_INDEX = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u8")])
_BITS = np.array([0] + [1 << k for k in range(32)], np.uint64)


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.searchsorted(_BITS[1:], values.astype(np.uint64), side="right")


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Low w bits of each row's values, as a little-endian stream of bits: rows of bytes."""
    columns = np.ascontiguousarray(values.T).astype("<u8") & np.uint64((1 << w) - 1)
    words = np.zeros((BLOCK * w // 64, len(values)), "<u8")
    for j in range(BLOCK):
        k, shift = divmod(j * w, 64)
        words[k] |= columns[j] << np.uint64(shift)
        if shift + w > 64:
            words[k + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    columns = np.empty((BLOCK, len(raw)), "<u8")
    for j in range(BLOCK):
        k, shift = divmod(j * w, 64)
        columns[j] = words[k] >> np.uint64(shift)
        if shift + w > 64:
            columns[j] |= words[k + 1] << np.uint64(64 - shift)
    columns &= np.uint64((1 << w) - 1)
    return columns.T


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block index and payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    index = np.zeros(blocks, _INDEX)
    if not n:
        return index, b""
    padded = np.full(blocks * BLOCK, ids[-1], "<u4")
    padded[:n] = ids
    m = padded.reshape(blocks, BLOCK)
    if n % BLOCK:
        m[-1, n % BLOCK :] = m[-1, : n % BLOCK].min()
    low = m.min(axis=1)
    rest = m - low[:, None]
    kth = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _width(np.partition(rest, kth, axis=1)[:, kth]).astype(np.int64)
    high = rest >> np.minimum(width, 31)[:, None].astype("<u4")
    high[width == 32] = 0
    outliers = high > 0
    count = outliers.sum(axis=1)
    size = width * (BLOCK // 8) + count * 5
    start = np.cumsum(size) - size
    index["minimum"], index["width"], index["exceptions"], index["start"] = low, width, count, start
    out = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = _pack(rest[rows], int(w))
            out[(start[rows][:, None] + np.arange(w * (BLOCK // 8))).ravel()] = packed.ravel()
    row, column = np.nonzero(outliers)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        base = start[row] + width[row] * (BLOCK // 8)
        out[base + nth] = column
        at = base + count[row] + 4 * nth
        out[(at[:, None] + np.arange(4)).ravel()] = np.ascontiguousarray(high[row, column], "<u4").view(np.uint8)
    return index, out.tobytes()


def decode_ids(index: np.ndarray, payload: bytes, n: int) -> np.ndarray:
    """All ids of some consecutive blocks; starts count from the first one's."""
    blocks = len(index)
    if not blocks:
        return np.zeros(0, "<u4")
    data = np.frombuffer(payload, np.uint8)
    width, count = index["width"].astype(np.int64), index["exceptions"].astype(np.int64)
    start = (index["start"] - index["start"][0]).astype(np.int64)
    m = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            raw = data[(start[rows][:, None] + np.arange(w * (BLOCK // 8))).ravel()].reshape(len(rows), -1)
            m[rows] = _unpack(raw, int(w))
    row = np.repeat(np.arange(blocks), count)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        base = start[row] + width[row] * (BLOCK // 8)
        at = base + count[row] + 4 * nth
        high = np.ascontiguousarray(data[(at[:, None] + np.arange(4)).ravel()]).view("<u4").astype(np.uint64)
        m[row, data[base + nth]] |= high << width[row].astype(np.uint64)
    m += index["minimum"].astype(np.uint64)[:, None]
    return m.ravel()[:n].astype("<u4")


def write_image(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    index, payload = encode_ids(ids)
    table = zlib.compress(doc_ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes(), 1)
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(index), len(table)) + table + index.tobytes() + payload


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags, counts, ids."""
    magic, docs, n, blocks, size = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    table = zlib.decompress(image[at : at + size])
    at += size
    index = np.frombuffer(image, _INDEX, blocks, at)
    payload = image[at + blocks * _INDEX.itemsize :]
    k = 8 * docs
    return np.frombuffer(table[:k], "<i8"), np.frombuffer(table[k : k + docs], np.uint8), np.frombuffer(table[k + docs :], "<u4"), decode_ids(index, payload, n)


def read_span(image: bytes, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of a file, from the blocks that hold them alone."""
    _, _, n, blocks, size = _HEAD.unpack_from(image)
    lo, hi = max(lo, 0), min(hi, n)
    if lo >= hi:
        return np.zeros(0, "<u4")
    at = _HEAD.size + size
    index = np.frombuffer(image, _INDEX, blocks, at)
    a, b = lo // BLOCK, -(-hi // BLOCK)
    body = at + blocks * _INDEX.itemsize
    end = int(index["start"][b]) if b < blocks else len(image) - body
    got = decode_ids(index[a:b], image[body + int(index["start"][a]) : body + end], min(b * BLOCK, n) - a * BLOCK)
    return got[lo - a * BLOCK : hi - a * BLOCK]


# ---------------------------------------------------------------- tables


def _encode(vocabulary: str, end_id: int, wide: bool, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary, spaced=False)
        for batch in batches:
            shard = pa.array(np.searchsorted(cuts, pc.fill_null(batch.column(0), -(2**63)).to_numpy(), side="left"), pa.int32())
            for first, ids, bound in encode(batch.column(1)):
                ids, bound = with_end(ids, bound, end_id)
                raw = ids if wide else ids.astype("<u2")
                parts = [raw[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([shard.slice(first, n), batch.column(0).slice(first, n), pa.array(parts, pa.binary())], names=["shard", "doc_id", "ids"])

    return run


def _images(wide: bool, most: int):
    """Files of about `most` ids from rows in (shard, doc_id) order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size, shard, seq = 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            doc_ids = np.array([d or 0 for d, _ in held], np.int64)
            nulls = np.array([d is None for d, _ in held])
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4" if wide else "<u2")
            counts = np.array([len(x) for _, x in held], np.int64) // (4 if wide else 2)
            image = write_image(doc_ids, nulls, counts, ids.astype("<u4"))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], names=["shard", "seq", "n_ids", "image"])
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            for s, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (s != shard or size >= most):
                    yield flush()
                if s != shard:
                    shard, seq = s, 0
                held.append((d, x))
                size += len(x) // (4 if wide else 2)
        if held:
            yield flush()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids, nulls, counts, ids = read_image(image.as_py())
            end = np.cumsum(counts.astype(np.int64))
            begin = end - counts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, end, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(begin + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_files(spark: SparkSession, docs: DataFrame, scratch: Scratch, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, wide: bool = False, rows: int = 4096, most: int = 1 << 21) -> DataFrame:
    """Token files (shard, seq, n_ids, image) in ascending doc_id order, written to the shared folder.

    Shards are ranges of doc_id between quantiles of that column alone, of about `rows` rows but never more than
    MOST_SHARDS, so the texts are encoded once, where they are read, and only ids are shuffled.  wide: ids above
    65535.
    """
    found = docs.select(F.count(F.lit(1)), F.min("doc_id")).first()
    shards = max(1, min(MOST_SHARDS, -(-found[0] // rows)))
    shares = [k / shards for k in range(1, shards)]
    cuts: list[int] = []
    if shares:
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", shares, 10 * shards)).first()[0] or []))
    # shard: how many cuts are below doc_id; a null is below all
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    coded = keyed.mapInArrow(_encode(vocabulary, end_id, wide, np.array(cuts, np.int64)), "shard int, doc_id long, ids binary")
    spread = coded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    images = spread.mapInArrow(_images(wide, most), "shard int, seq int, n_ids long, image binary")
    return scratch.save(images, "tokens", codec="none")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files' bytes."""
    order = W.orderBy("shard", "seq").rowsBetween(W.unboundedPreceding, -1)
    # a row per file
    heads = files.select("shard", "seq", "n_ids").withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")
    # a row for each file of about 2 million ids; images should stay where they are read
    heads = F.broadcast(heads) if files.count() <= 500_000 else heads
    return files.join(heads, ["shard", "seq"]).select("start", "image").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the corpus as token files and reads it back.

    Defined results: a null text is empty and has its end id alone; rows with the same doc_id stay apart,
    in order of their ids; a null doc_id comes before all others; an empty table gives no files.
    """
    return read_files(write_files(spark, docs, Scratch(spark, "tokens")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
