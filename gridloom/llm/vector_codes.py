"""Product codes of integer vectors, entries found through geometric near-neighbour access trees.

A vector's components become integers, the vector is cut into PARTS parts, and every
part is coded by the nearest of the entries of its position's codebook.  The search
goes through a tree over the entries (a GNAT): split points each own the entries next
to them, and every split point stores the range of its distances to every child's
entries.  The distances of a query to the split points then rule whole children out.

Distances compared are integers: ranges are kept, and query distances taken, as whole
roots rounded outwards, so that a child is ruled out only if all its entries are farther than
the best one; equal squared distances go to the lower entry.

A codebook has at most ENTRIES entries whatever the data, so the driver and every task
may hold all of them; vectors are only streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, use_package, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors with a component beyond this can't be coded: squared distances must fit 64 bits.
MOST = 1 << 14
#: Split points of a tree's node, and the most entries of one that has none.
FANOUT, LEAF = 6, 6
#: Copies of a label's sum, so that the vectors of one label are joined in many tasks.
SALT = 16


def _root(squared: np.ndarray) -> np.ndarray:
    """Whole roots, rounded down, exactly."""
    r = np.sqrt(squared.astype(np.float64)).astype(np.int64)
    r -= r * r > squared
    return r + ((r + 1) * (r + 1) <= squared)


def _squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all points (rows) to all others (columns)."""
    gaps = points[:, None, :] - others[None, :, :]
    return np.einsum("ijk,ijk->ij", gaps, gaps)


@dataclass(frozen=True)
class Tree:
    """A node: its split points (or, in a leaf, all its entries) by number, ranges and children.

    lower[i, j] and upper[i, j] bound the distances of split point i to the entries of
    child j, split point j included; children that hold no other entry are None.
    """

    numbers: np.ndarray
    points: np.ndarray
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None
    children: tuple[Tree | None, ...] = ()


def grow(numbers: np.ndarray, points: np.ndarray) -> Tree:
    """A tree over entries; split points are spread: each is the entry farthest from those before.

    Equal entries can't be told apart by any split, so only the first of them is kept:
    it has the lowest number.
    """
    _, first = np.unique(points, axis=0, return_index=True)
    first.sort()
    return _grow(numbers[first], points[first])


def _grow(numbers: np.ndarray, points: np.ndarray) -> Tree:
    if len(numbers) <= LEAF:
        return Tree(numbers, points)
    picked = [0]
    near = _squared(points, points[:1])[:, 0]
    while len(picked) < FANOUT:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _squared(points, points[picked[-1:]])[:, 0])
    squared = _squared(points, points[picked])
    owner = squared.argmin(axis=1)
    down = _root(squared)
    up = down + (down * down < squared)
    lower = np.stack([[down[owner == j, i].min() for j in range(FANOUT)] for i in range(FANOUT)])
    upper = np.stack([[up[owner == j, i].max() for j in range(FANOUT)] for i in range(FANOUT)])
    rest = np.ones(len(numbers), bool)
    rest[picked] = False
    inside = [np.flatnonzero(rest & (owner == j)) for j in range(FANOUT)]
    return Tree(numbers[picked], points[picked], lower, upper, tuple(_grow(numbers[x], points[x]) if len(x) else None for x in inside))


def _better(best: np.ndarray, entry: np.ndarray, at: np.ndarray, squared: np.ndarray, numbers: np.ndarray) -> None:
    """Take entries that are nearer, or as near with a lower number, for queries `at`."""
    place = np.lexsort((np.broadcast_to(numbers, squared.shape), squared), axis=1)[:, 0] if len(numbers) > 1 else np.zeros(len(at), np.int64)
    found, number = squared[np.arange(len(at)), place], numbers[place]
    take = (found < best[at]) | ((found == best[at]) & (number < entry[at]))
    best[at[take]], entry[at[take]] = found[take], number[take]


def nearest(tree: Tree, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each query's nearest entry, and how many distances that took."""
    best, entry = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.iinfo(np.int64).max)
    return entry, best, _search(tree, queries, np.arange(len(queries)), best, entry)


def _search(tree: Tree, queries: np.ndarray, at: np.ndarray, best: np.ndarray, entry: np.ndarray) -> int:
    if not len(at):
        return 0
    squared = _squared(queries[at], tree.points)
    _better(best, entry, at, squared, tree.numbers)
    looked = squared.size
    if tree.lower is None or tree.upper is None:
        return looked
    down = _root(squared)
    up = down + (down * down < squared)
    # no entry of child j is nearer than this: the largest gap between a query's distance and a range
    gap = np.maximum(tree.lower[None] - up[:, :, None], down[:, :, None] - tree.upper[None]).max(axis=1)
    least = np.maximum(gap, 0) ** 2
    home = squared.argmin(axis=1)
    for own in (True, False):  # a query's own child first, so that others are ruled out by a near entry
        for j, child in enumerate(tree.children):
            if child is not None:
                open_ = ((home == j) == own) & (least[:, j] <= best[at])
                looked += _search(child, queries, at[open_], best, entry)
    return looked


def _parts(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer components by part: (vectors, PARTS, width)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), PARTS, width)


def code(parts: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (vectors, PARTS) and squared distances of all parts."""
    found = [nearest(tree, np.ascontiguousarray(parts[:, p])) for p, tree in enumerate(trees)]
    return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)


def _trees(books: np.ndarray) -> list[Tree]:
    return [grow(np.arange(books.shape[1]), books[p]) for p in range(PARTS)]


def _sums(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after a round: every entry the floor of the mean of its parts, unused ones as before.

    A task gives one row for each part and entry it has seen; the driver gets one for
    each part and entry at most.
    """
    _, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, totals, counts = _trees(books), np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            parts = _parts(batch.column(0), width)
            numbers, _ = code(parts, trees)
            for p in range(PARTS):
                np.add.at(totals[p], numbers[:, p], parts[:, p])
                counts[p] += np.bincount(numbers[:, p], minlength=entries)
        part, entry = counts.nonzero()
        sums = pa.array(list(totals[part, entry]), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), sums], ["part", "entry", "n", "sums"])

    each = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    after = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        after[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return after


def encode(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that can be coded.

    Dropped are null vectors, those with null or non-finite components, and what can't be
    cut alike: vectors with components beyond MOST either way, and those whose length
    isn't that of the kept vector with the least vec_id (of lengths that PARTS divides;
    an empty vector can't be cut).
    Repeated rows come out each; of equal vec_ids the lesser vector comes first into the
    books; a null vec_id comes last.  With fewer vectors than entries the books are as
    much smaller.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    use_package(spark)
    rows = columns(vectors, vec_id=id_column, embedding=vector_column, label=label_column)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    whole = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    rows = written(rows.where(F.col("embedding").isNotNull() & F.coalesce(fits, F.lit(False)) & whole), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    top = rows.orderBy(*order).limit(1).collect()
    length = len(top[0].embedding) if top else PARTS
    width = length // PARTS
    rows = rows.where(F.size("embedding") == length)
    first = [r.embedding for r in rows.orderBy(*order).limit(entries).select("embedding").collect()]
    books = np.floor(np.array(first, np.float64).reshape(len(first), PARTS, width) * SCALE).astype(np.int64).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _sums(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            numbers, squared = code(_parts(batch.column(1), width), trees)
            text = [bytes(x).hex() for x in numbers.astype(np.uint8)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(text, pa.string()), pa.array(squared.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = written(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    joined = dealt.join(sums, (F.col("salt") == F.col("copy")) & F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
