"""Token ids of a corpus in patched frame-of-reference blocks.

File format.  A written corpus is a Parquet table of segments.  A segment holds the
ids of whole documents, in ascending document order, about SEGMENT_IDS of them, as
one self-contained byte string, `payload`:

    magic "PFR1", uint32 ids, uint32 ids a block, uint32 blocks
    uint32 start of each block and of the end, from the payload's first byte
    blocks: uint32 reference, uint8 width, uint8 zero, uint16 exceptions,
            width bits for each id less the reference, most significant bit first,
            uint16 places of exceptions, uint32 their values less the reference

All numbers are little-endian.  The reference is the block's least id; the width is
the least at which EXACT_SHARE of the block's ids fit, the others are exceptions.
The starts let a reader decode any block without those before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, new_path, use_package
from .tokens import encoder

MAGIC = b"PFR1"
BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 17
EXACT_SHARE = 0.9
_HEAD, _BLOCK = struct.Struct("<4sIII"), struct.Struct("<IBBH")

SEGMENTS = "part int, seq int, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, packed."""
    if not width:
        return b""
    size = 2 if width <= 16 else 4
    each = np.unpackbits(values.astype(f">u{size}").view(np.uint8)).reshape(-1, 8 * size)
    return np.packbits(each[:, 8 * size - width :]).tobytes()


def _values(packed: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    size = 2 if width <= 16 else 4
    full = np.zeros((n, 8 * size), np.uint8)
    full[:, 8 * size - width :] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(full).view(f">u{size}").astype(np.uint32)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, exact_share: float = EXACT_SHARE) -> bytes:
    """The payload for these ids (uint32); no ids give a payload without blocks."""
    ids = np.asarray(ids, np.uint32)
    blocks = []
    for low in range(0, len(ids), block_ids):
        block = ids[low : low + block_ids]
        reference = block.min()
        rest = block - reference
        kth = max(0, int(np.ceil(exact_share * len(rest))) - 1)
        width = int(np.partition(rest, kth)[kth]).bit_length()
        places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        blocks.append(_BLOCK.pack(reference, width, 0, len(places)) + _bits(rest, width) + places.astype("<u2").tobytes() + rest[places].astype("<u4").tobytes())
    first = _HEAD.size + 4 * (len(blocks) + 1)
    starts = first + np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u4")
    return _HEAD.pack(MAGIC, len(ids), block_ids, len(blocks)) + starts.astype("<u4").tobytes() + b"".join(blocks)


def unpack(payload: bytes, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids low to high of a payload; only the blocks that hold them are decoded."""
    magic, n, block_ids, n_blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    high = n if high is None else min(high, n)
    if low >= high:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", n_blocks + 1, _HEAD.size)
    out = []
    for b in range(low // block_ids, (high - 1) // block_ids + 1):
        at, size = int(starts[b]), min(block_ids, n - b * block_ids)
        reference, width, _, n_exceptions = _BLOCK.unpack_from(payload, at)
        at += _BLOCK.size
        n_bytes = (size * width + 7) // 8
        rest = _values(payload[at : at + n_bytes], width, size)
        at += n_bytes
        rest[np.frombuffer(payload, "<u2", n_exceptions, at)] = np.frombuffer(payload, "<u4", n_exceptions, at + 2 * n_exceptions)
        out.append(rest + np.uint32(reference))
    skip = low // block_ids * block_ids
    return np.concatenate(out)[low - skip : high - skip]


def in_order(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, ...) in ascending order over and within partitions.

    Equal ids are ordered by text; the hash spreads one id's many texts over partitions.
    """
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encode every whole text, append `end_id` to each, and write segments; returns the path.

    Texts are dealt by ranges of the id, so that partitions follow each other in
    document order.  A null text is an empty one, a null id comes first, equal rows
    each get ids of their own, an empty table gives an empty corpus.
    """
    use_package(docs.sparkSession)
    path = path or new_path(docs.sparkSession, "tokens")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, seq = TaskContext.get().partitionId(), encoder(tokenizer).encode, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def segment() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            rows = [part], [seq], [size], [names], [lengths], [pack(np.concatenate(ids))]
            return pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "seq", "n_ids", "doc_ids", "doc_lengths", "payload"])

        for batch in batches:
            for name, got in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), strict=True):
                names.append(name)
                ids.append(np.append(got, np.uint32(end_id)))
                size += len(got) + 1
                if size >= SEGMENT_IDS:
                    yield segment()
                    ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield segment()

    in_order(columns(docs, doc_id=id_column, text=text_column)).mapInArrow(segments, SEGMENTS).write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a written corpus: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    `start` counts the ids of all documents before.  It is the sum of a document's
    place in its segment and running totals over segments, which are rows of a few
    bytes: one for each SEGMENT_IDS ids inside a part, one for each part over parts.
    """
    use_package(spark)
    table = spark.read.schema(SEGMENTS).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = table.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_start"))
    starts = at.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("segment_start"))
    fields = "doc_id long, part int, seq int, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = unpack(row["payload"]), np.cumsum(row["doc_lengths"])
                each = np.split(ids, ends[:-1])
                n = len(each)
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(ends - row["doc_lengths"], pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.record_batch(cols, ["doc_id", "part", "seq", "inner", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    found = table.mapInArrow(documents, fields).join(starts, ["part", "seq"])
    return found.select("doc_id", (F.col("segment_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
