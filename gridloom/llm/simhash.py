"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has four segments of 16 bits.  If two fingerprints differ in at
most four bits, at least two segments differ in at most one bit each: if three had
two or more, six bits would differ.  Each segment, padded to 23 bits, is decoded by
the perfect binary Golay code (23 bits, 12 of information, every word within three
bits of one codeword).  A segment's near keys are the codeword indices of itself and
of its 16 one-bit changes, mostly one or a few.  If x and y differ in one bit or none,
then y's index is a near key of x and x's index a near key of y.  So for each of the
six pairs of segments the left side lists (near key of the first, index of the
second), the right side (index of the first, near key of the second); any linked pair
meets in one of them, in either order.  Meetings are verified on all 64 bits.

Fingerprints, not documents, are joined: copies meet once, by their fingerprint.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, shuffled, use_package, written
from .components import components
from .near_copies import near_copies, text_hash

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENTS, SEGMENT_BITS = 4, 16
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GOLAY = 0b110001110101

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, unsigned; texts without words have 0."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE_WORDS, len(words))
    starts = (ends - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(lanes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)]
    bits = np.concatenate(counts) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _divide(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder of polynomials over GF(2) by the generator."""
    quotient, rest = np.zeros_like(words), words.copy()
    for i in range(11, -1, -1):
        has = (rest >> (i + 11)) & 1
        quotient |= has << i
        rest ^= has * (GOLAY << i)
    return quotient, rest


@functools.cache
def near_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit segment: its codeword's index; starts and values of its near keys."""
    bits = [0, *(sum(1 << i for i in c) for n in (1, 2, 3) for c in combinations(range(23), n))]
    error = np.zeros(1 << 11, np.int64)
    error[_divide(np.array(bits))[1]] = bits
    segments = np.arange(1 << SEGMENT_BITS)
    index = lambda x: _divide(x ^ error[_divide(x)[1]])[0]
    own = index(segments)
    near = np.stack([own, *(index(segments ^ (1 << i)) for i in range(SEGMENT_BITS))], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return own, np.concatenate([[0], np.cumsum(first.sum(axis=1))]), near[first]


def _keys(prints: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) for one side, and the row of each."""
    own, start, near = near_keys()
    part = [((prints >> np.uint64(SEGMENT_BITS * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    keys, rows = [], []
    for t, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        wide, narrow = (part[i], part[j]) if left else (part[j], part[i])
        n = start[wide + 1] - start[wide]
        row = np.repeat(np.arange(len(prints)), n)
        several = near[np.repeat(start[wide] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        single = own[narrow][row]
        keys.append((t << 24) | (np.where(left, several, single) << 12) | np.where(left, single, several))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return columns(docs, doc_id=id_column, text=text_column).mapInArrow(run, "doc_id long, print long")


def _keyed(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, a) and (key, b): prints at MAX_BITS or less of each other meet in a key as a and b."""
    use_package(prints.sparkSession)

    def side(left: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False)
                for low in range(0, len(values), 4096):
                    some = values[low : low + 4096]
                    keys, rows = _keys(some.view(np.uint64), left)
                    yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(some[rows])], ["key", name])

        name = "a" if left else "b"
        return prints.select("print").mapInArrow(run, f"key int, {name} long")

    return side(True), side(False)


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MAX_BITS


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (print) at MAX_BITS or less."""
    left, right = _keyed(prints)
    return shuffled(left).join(right, "key").where((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b").distinct()


def connecting_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (print) at MAX_BITS or less that connect all that `links` connects.

    The fingerprints that meet in a key are first linked to the least of them, where they
    are near it.  Pairs of which both are near it are connected by that and aren't
    made; all others are.  So links of a dense cluster grow as its members.
    """
    left, right = _keyed(prints)
    least = left.groupBy("key").agg(F.min("a").alias("top"))
    left = shuffled(left).join(least, "key").select("key", "a", F.when(_near("a", "top"), F.col("top")).alias("a_top"))
    right = shuffled(right).join(least, "key").select("key", "b", F.when(_near("b", "top"), F.col("top")).alias("b_top"))
    stars = left.where("a <> a_top").select("a", F.col("a_top").alias("b")).union(right.where("b <> b_top").select("b", F.col("b_top").alias("a")))
    open_ = shuffled(left.where("a_top is null")).join(right, "key").union(shuffled(left.where("a_top is not null")).join(right.where("b_top is null"), "key"))
    # near prints meet with either of them on the left: one order is enough
    return stars.union(open_.where((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Null and empty texts and texts without words have fingerprint 0 and link like any
    other.  Copies share a fingerprint.  Equal rows come out each; a null doc_id is
    never a component's name unless all its ids are null.
    """
    each = written(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = written(each.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(components(connecting_links(classes)), "roots")
    linked = classes.join(roots, classes["print"] == roots["node"]).select("print", "least", "root")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("print", "component_id")
    alone = classes.join(roots, classes["print"] == roots["node"], "left_anti").select("print", F.col("least").alias("component_id"))
    found = each.join(named.union(alone), "print")
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def met_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of shingle sets (text_hash, set) of `docs` whose fingerprints link: least sets of linked prints, and those of one print."""
    hash_ = fresh(docs, "_hash")
    prints = fingerprints(docs.withColumn(hash_, text_hash()), hash_).withColumnRenamed("doc_id", "text_hash").distinct()
    each = written(prints.join(sets.select("text_hash", "set").distinct(), "text_hash").select("print", "set").distinct(), "set-prints")
    classes = written(each.groupBy("print").agg(F.min("set").alias("least")), "prints")
    least = lambda n: classes.select(F.col("print").alias(n), F.col("least").alias(f"{n}_set"))
    apart = connecting_links(classes).join(least("a"), "a").join(least("b"), "b").select("a_set", "b_set")
    same = each.join(classes, "print").select("set", "least")
    return apart.union(same).toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8), with its columns.

    Fingerprints that link by their Golay keys are compared first, as whole sets; MinHash
    finds the near copies whose fingerprints differ in more bits.  The one with the least id stays, null last; of rows that share that id but not the
    text the one with the least text hash, of equal rows one.  Rows that only share an
    id, or have none, are different documents.
    """
    hash_ = fresh(docs, "_hash")
    found = written(near_copies(docs, met_sets), "near-copies")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    first = written(first.select(F.col("first.doc_id").alias("_first_id"), F.col("first.text_hash").alias("_first_hash")), "first")
    same = F.col("doc_id").eqNullSafe(F.col("_first_id"))
    again = shuffled(found).join(first, same & (F.col("text_hash") == F.col("_first_hash"))).groupBy("_first_id", "_first_hash").count().where("count > 1").limit(1).count()
    hashed = docs.withColumn(hash_, text_hash())
    kept = shuffled(hashed).join(first, hashed["doc_id"].eqNullSafe(first["_first_id"]) & (hashed[hash_] == first["_first_hash"]), "left_semi")
    return (kept.dropDuplicates(["doc_id", hash_]) if again else kept).drop(hash_)
