"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by MinHash: each set has HASHES minima, and two sets meet if all
BAND_HASHES minima of one of BANDS fixed random choices agree.  At similarity 0.8 one
pair in about 2,000 never meets, above it fewer; at 0.25 (documents that share a common
passage) one pair in 10,000 does.  The join that finds a meeting also compares a byte of
each minimum; at 0.8 about 160 of the 200 agree, and fewer than LEAST_AGREE do in one
case of 100,000.  What is left is verified on the whole sets (of 64-bit shingle hashes).  A 64-bit SimHash can't do this: at 0.8 two prints differ in about 10
bits, give or take 3, and too many unrelated ones do.

Sets, not documents, are compared: texts of one set are one class, known by a 64-bit
hash of the set.  Every meeting place has a leader, the least in one of ORDERS orders,
with whom its sets are compared first.  Sets of places that aren't one component yet are
then joined exactly: ordered by how many of these sets hold a shingle, rarest first, two
of similarity 0.8 share one of the first fifth of each, of the smaller one of its first
ninth (prefix filter), with enough left on both sides behind it (positional filter).  So
sets of a large group that each have rare shingles of their own don't meet each with each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, shuffled, use_package, written
from .components import components

SHINGLE_WORDS = 5
#: Least Jaccard similarity, as a fraction.
LEAST = (4, 5)
HASHES, BANDS, BAND_HASHES = 200, 120, 10
#: Minima of two sets that agree, in their lowest byte, if the sets are to be verified.
LEAST_AGREE = 136
ORDERS = 3
SEED = 42

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)
_CHOICES = np.stack([_RANDOM.choice(HASHES, BAND_HASHES, replace=False) for _ in range(BANDS)])
_SALTS = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)
_MASKS = _RANDOM.integers(0, 1 << 63, ORDERS).tolist()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one of all words if it has fewer than five."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE_WORDS, len(words))
    starts = (ends - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over a set that isn't empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 512):
        mixed = hashes[low : low + 512, None] * _FACTORS + _ADDED
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of each set (rows of minima)."""
    keys = np.broadcast_to(_SALTS, (len(least), BANDS)).copy()
    for i in range(BAND_HASHES):
        keys = (keys ^ least[:, _CHOICES[:, i]]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def agreeing(a: str, b: str) -> Column:
    """How many bytes of two arrays of HASHES / 8 numbers agree."""
    def equal_bytes(x: Column, y: Column) -> Column:
        unlike = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):  # or a byte's bits into its lowest
            unlike = unlike.bitwiseOR(F.shiftrightunsigned(unlike, shift).bitwiseAND(F.lit(mask)))
        return 8 - F.bit_count(unlike.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda s, x: s + x)


def text_hash() -> Column:
    """64 bits of `text`; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set (its hash), size, bands and low (a byte of each minimum, as numbers); none of an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own = [shingles(x.as_py()) for x in part.column(2)]
                some = [x for x in own if len(x)]
                sizes = np.array([len(x) for x in own])
                least = np.stack([minima(x) for x in some]) if some else np.empty((0, HASHES), np.uint64)
                low_bytes = np.ascontiguousarray(least.astype(np.uint8)).view(np.int64).ravel()
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * k)]).astype(np.int32)), pa.array(v)) for k, v in ((BANDS, bands(least).ravel()), (HASHES // 8, low_bytes))]
                names = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in own], np.uint64).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(names), pa.array(sizes, pa.int64()), *lists]
                yield pa.record_batch(cols, ["doc_id", "text_hash", "set", "size", "bands", "low"])

    rows = columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, set long, size long, bands array<long>, low array<long>")


def _hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set and its hashes, of `wanted` (set, a document's id and text hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["set", "hashes"])

    rows = columns(docs, doc_id="doc_id", text="text").select("doc_id", text_hash().alias("text_hash"), "text")
    one = wanted.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(one, same).select("set", "text").mapInArrow(run, "set long, hashes binary").dropDuplicates(["set"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("set").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in "ab")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "a_hashes", "b_hashes")
    return rows.mapInArrow(run, "a long, b long")


def _sizes_allow() -> Column:
    return F.least("a_size", "b_size") * LEAST[1] >= F.greatest("a_size", "b_size") * LEAST[0]


def _shared(a: str, b: str) -> Column:
    """The fewest elements that near copies of so many elements share."""
    return F.ceil((F.col(a) + F.col(b)) * LEAST[0] / (LEAST[0] + LEAST[1]))


def _prefixes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, root, size, element and its place: the rarest elements of the `wanted` sets (set, root), of which near copies share one.

    Of n elements those are the first n - least + 1, least being the fewest that a near
    copy of any size shares.  Elements that no other of the sets has come first and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, root, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.int64)
                yield pa.record_batch([pa.array(np.full(len(own), x)) for x in (name, root, len(own))] + [pa.array(own)], ["set", "root", "size", "element"])

    rows = sets.join(wanted, "set").select("set", "root", "hashes").mapInArrow(run, "set long, root long, size long, element long")
    rows = written(rows, "elements")
    several = rows.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    inside = Window.partitionBy("set")
    alone = F.col("size") - F.count("*").over(inside)
    each = shuffled(rows).join(several, "element").withColumn("place", alone + F.row_number().over(inside.orderBy("n", "element")))
    least = F.ceil(F.col("size") * LEAST[0] / LEAST[1])
    return each.where(F.col("place") <= F.col("size") - least + 1).select("set", "root", "size", "element", "place")


def near_copies(docs: DataFrame, met_sets: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, text_hash and root, which names the component of near copies and is never null.

    `met_sets` gives pairs (a, b) of sets that have met elsewhere (documents, sets by text
    hash -> pairs): they are verified beside those of bands, and bands only look on where
    sets aren't one component yet.  Texts without words are copies of each other.
    """
    use_package(docs.sparkSession)
    each = written(_sets(docs), "sets")
    classes = written(each.dropDuplicates(["set"]), "classes")
    met = classes.select("set", F.explode("bands").alias("band"))
    mask = F.element_at(F.array(*map(F.lit, _MASKS)), (F.pmod("band", F.lit(ORDERS)) + 1).cast("int"))
    place = F.col("set").bitwiseXOR(mask)  # its place in the band's order
    buckets = met.groupBy("band").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    members = written(shuffled(met).join(buckets.select("band", F.col("first").bitwiseXOR(mask).alias("leader")), "band"), "members")
    pairs = written(met_sets(docs, each), "met-sets") if met_sets else None
    looked = members.select("set")
    if pairs is not None:
        looked = looked.union(pairs.select(F.explode(F.array("a", "b"))))
    wanted = classes.join(looked.distinct(), "set", "left_semi").select("set", "doc_id", "text_hash")
    sets = written(_hashes(docs, wanted), "hashes")

    likely = _sizes_allow() & (agreeing("a_low", "b_low") >= LEAST_AGREE)
    told = classes.join(members.select("set").distinct(), "set", "left_semi").select("set", "size", "low")
    a, b = (told.select(*[F.col(c).alias(f"{n}_{c}" if c != "set" else n) for c in told.columns]) for n in "ab")
    stars = members.where("set <> leader").select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct()
    to_verify = stars.join(a, "a").join(b, "b").where(likely).select("a", "b")
    if pairs is not None:
        to_verify = to_verify.union(pairs).distinct()
    links = written(_verified(to_verify, sets), "star-links")
    roots = written(components(links), "star-roots")
    placed = members.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    rest = placed.join(open_, "band", "left_semi").select("set", "root").distinct()
    met = written(_prefixes(sets, rest), "prefixes")
    x, y = (met.select("element", *[F.col(c).alias(f"{n}_{c}") for c in ("set", "size", "root", "place")]) for n in "ab")
    x = x.where(F.col("a_place") <= F.col("a_size") - _shared("a_size", "a_size") + 1)
    smaller = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_set") < F.col("b_set")))
    enough = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) + 1 >= _shared("a_size", "b_size")
    unlike = (x["element"] == y["element"]) & smaller & (F.col("a_root") != F.col("b_root")) & _sizes_allow() & enough
    others = shuffled(x).join(y, unlike).select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).distinct()
    others = others.join(a, "a").join(b, "b").where(likely).select("a", "b")
    links = links.union(written(_verified(others, sets), "links"))
    roots = written(components(links), "roots").select(F.col("node").alias("set"), "root")
    return each.join(roots, "set", "left").select("doc_id", "text_hash", F.coalesce("root", "set").alias("root"))
