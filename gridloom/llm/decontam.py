"""Benchmark items inside documents: size-partitioned MinHash containment search.

Texts are compared by their distinct five-word shingles.  An item of m shingles is in
a document if at least CONTAINMENT of them are.  Items are dealt by size into
partitions [2^p, 2^(p+1)).  An item's MinHash signature is the k_p shingles of least
rank; k_p = u - need(u) + 1 for the partition's largest size u.  A document that holds
the item lacks m - need(m) of its shingles at most, so it holds k_p - (m - need(m)) of
the signature: that many is the partition's threshold for an item of m, however long the
document is.  (Signatures of documents of a fixed length can't find short items in long
ones: an item of 20 shingles in a document of 20,000 has a Jaccard similarity of 0.0008,
and 256 minima agree in none in 4 of 5 cases.)

A shingle's rank is its hash, as a number in (0, 1], times the number of items that hold
it, so that signatures avoid the stems that many items share.  A document's shingles are
looked up in a Bloom filter of signatures; only what it passes is joined, by hash and item.
Pairs that reach the threshold are verified by their shingles as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, shuffled, use_package, written

SHINGLE_WORDS = 5
#: Containment as a fraction, so that thresholds are whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Bloom filters, which tasks get: bits for each hash, probes, and least and most bits (2 ** n).  Above
#: these most bits (16 MB) filters pass more, but nothing else changes.
HASH_BITS, PROBES, LEAST_BITS, MOST_BITS = 16, 4, 16, 27

_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (upper case lowered) and characters beyond ASCII."""
    return (text or "").encode().lower().translate(_BLANK).split()


def shingle_hashes(text_words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each five-word shingle, in order."""
    n = len(text_words) - SHINGLE_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, text_words), np.uint64, len(text_words))
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE_WORDS):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


class Bloom:
    """A set of 64-bit hashes of bounded size: may take others for members, never misses one."""

    def __init__(self, hashes: DataFrame) -> None:
        """Of a column `hash`; at most 2 ** MOST_BITS / 64 rows of 16 bytes come to the driver."""
        size = HASH_BITS * hashes.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(size).bit_length()))
        mask = F.lit((1 << self.bits) - 1)
        each = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("hash", 12 * i).bitwiseAND(mask) for i in range(PROBES)])).alias("b"))
        words = each.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toPandas()
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self.table = np.unpackbits(table.view(np.uint8), bitorder="little").view(bool) if self.bits <= 20 else table.view(np.uint8)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be members."""
        found = np.ones(len(hashes), bool)
        mask = np.uint64((1 << self.bits) - 1)
        for i in range(PROBES):
            at = np.flatnonzero(found)
            b = (hashes[at] >> np.uint64(12 * i)) & mask
            if self.table.dtype == bool:
                found[at] = self.table[b]
            else:
                found[at] = (self.table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def _shingles(rows: DataFrame, filters: tuple[Bloom, Bloom] | None) -> DataFrame:
    """key columns, hash and shingle of each distinct shingle of (doc_id, text_hash, text).

    With `filters` (of signatures and of all item shingles), only those of documents that
    pass the first, and only shingles that pass the second.
    """
    use_package(rows.sparkSession)
    names = ["doc_id", "text_hash", "hash", "shingle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = words(text.as_py())
                hashes = shingle_hashes(own)
                places = np.arange(len(hashes))
                if filters is not None:
                    if not filters[0].among(hashes).any():
                        continue
                    places = np.flatnonzero(filters[1].among(hashes))
                for shingle, h in {b" ".join(own[i : i + SHINGLE_WORDS]): hashes[i] for i in places.tolist()}.items():
                    for values, x in zip(out, (doc_id, text_hash, h, shingle.decode()), strict=True):
                        values.append(x)
                if len(out[0]) > 200_000:
                    yield block(out)
                    out = [[], [], [], []]
            yield block(out)

    def block(out: list[list]) -> pa.RecordBatch:
        hashes = np.array(out[2], np.uint64).view(np.int64)
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(hashes), pa.array(out[3], pa.string())], names)

    return rows.mapInArrow(run, "doc_id long, text_hash long, hash long, shingle string")


def signatures(known: DataFrame) -> DataFrame:
    """item, hash, n_item and least (how many of its signature a document must hold) of `known` (item, hash, shingle)."""
    need = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR)
    held = known.groupBy("hash", "shingle").agg(F.count("*").alias("items"))
    rank = (F.pmod("hash", F.lit(1 << 52)) + 1) / float(1 << 52) * F.col("items")
    each = known.join(held, ["hash", "shingle"]).withColumn("rank", rank)
    sizes = known.groupBy("item").agg(F.count("*").alias("n_item"))
    largest = F.pow(F.lit(2), F.length(F.bin("n_item"))).cast("long") - 1
    k = F.least(F.col("n_item"), largest - need(largest) + 1)
    sized = sizes.select("item", "n_item", k.alias("k"), (k - (F.col("n_item") - need(F.col("n_item")))).alias("least"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("rank", "hash", "shingle"))
    return each.withColumn("place", place).join(sized, "item").where("place <= k").select("item", "hash", "n_item", "least")


def find_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, n_shared, n_item, containment of every contained item.

    Null texts and those of fewer than five words have no shingles: such items are not
    searched for, such documents hold none.  Items with the same id are one item with
    the shingles of all; equal documents come out once for each (id, text).
    """
    item_rows = columns(items, doc_id=item_column, text=item_text_column).withColumn("text_hash", F.lit(0).cast("long")).select("doc_id", "text_hash", "text")
    # null is an id of its own; `item` never is null
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    known = written(_shingles(item_rows, None).select(ids.alias("item"), F.col("doc_id").alias("item_id"), "hash", "shingle").distinct(), "items")
    signed = written(signatures(known.drop("item_id")), "signatures")
    filters = Bloom(signed.select("hash").distinct()), Bloom(known.select("hash").distinct())
    rows = columns(docs, doc_id=id_column, text=text_column).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_hash")
    held = written(_shingles(rows, filters).distinct().withColumn("doc", own), "held")
    met = held.select("doc", "hash").distinct().join(signed, "hash").groupBy("doc", "item", "n_item", "least").agg(F.count_distinct("hash").alias("n"))
    pairs = met.where("n >= least").select("doc", "item", "n_item")
    # a pair looks for its item's own shingles, not for every shingle of its document
    wanted = pairs.join(known.select("item", "item_id", "hash", "shingle"), "item")
    shared = shuffled(held).join(wanted, ["doc", "hash", "shingle"])
    counts = shared.groupBy("doc_id", "text_hash", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    enough = counts.where(F.col("n_shared") * DENOMINATOR >= F.col("n_item") * NUMERATOR)
    return enough.select("doc_id", "text_hash", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns."""
    hit = find_items(docs, items).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_hash"])
    return docs.join(hit, same, "left_anti")
