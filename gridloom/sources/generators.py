"""Matrices made in place by Spark: grid Laplacians, bands, random dominant, table graphs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from .shared import table


def laplacian(spark: SparkSession, shape: Sequence[int], periodic: bool = False, diag_shift: float = 0.0, axis_order: Sequence[int] | None = None, anisotropy: Sequence[float] | None = None) -> SparseMatrix:
    """The graph Laplacian of a grid: -weight for each neighbour, the sum and the shift on the diagonal.

    The last axis of `axis_order` varies fastest.  periodic wraps every axis; neighbours
    that coincide there (axes of size 1 or 2) are added up.
    """
    axes = list(axis_order) if axis_order is not None else list(range(len(shape)))
    weights = list(anisotropy) if anisotropy is not None else [1.0] * len(shape)
    if sorted(axes) != list(range(len(shape))) or len(weights) != len(shape):
        raise ValueError("axis_order must permute the axes; anisotropy needs a weight for each")
    stride, running = {}, 1
    for a in reversed(axes):
        stride[a], running = running, running * shape[a]
    n = prod(shape)
    grid = spark.range(n)
    here = F.col("id")
    neighbours = []
    for a, size in enumerate(shape):
        at = F.expr(f"(id div {stride[a]}) % {size}")
        for step in (-1, 1):
            to = F.pmod(at + step, F.lit(size)) if periodic else at + step
            inside = F.lit(True) if periodic else to.between(0, size - 1)
            neighbours.append(F.when(inside, F.struct((here + (to - at) * stride[a]).alias("col"), F.lit(-float(weights[a])).alias("val"))))
    around = F.array_compact(F.array(*neighbours))
    degree = F.aggregate(around, F.lit(0.0), lambda s, e: s - e["val"])
    own = F.struct(here.alias("col"), (degree + float(diag_shift)).alias("val"))
    each = grid.select(here.alias("row"), F.explode(F.concat(F.array(own), around)).alias("e")).select("row", "e.col", "e.val")
    if periodic and min(shape) <= 2:
        return SparseMatrix.of(each, n, check=False)
    return SparseMatrix(each, n)


def offsets(near: Iterable[int], m: int) -> list[int]:
    """Distinct non-zero offsets of a band: both signs of the near ones and of m."""
    wanted = {abs(d) for d in (*near, m)} - {0}
    return sorted([-d for d in wanted] + list(wanted))


def banded_nnz(n: int, band: Iterable[int]) -> int:
    """Entries of an n x n band matrix, in closed form."""
    return n + sum(n - abs(d) for d in band if abs(d) < n)


def banded(spark: SparkSession, n: int, m: int, near: Iterable[int] = (1, 2), off_diagonal: float = -1.0, margin: float = 0.1) -> SparseMatrix:
    """A band matrix; its diagonal exceeds the band's absolute sum by `margin`."""
    band = offsets(near, m)
    if not band or abs(m) >= n:
        raise ValueError("the largest offset must be below n, and one must not be 0")
    around = F.explode(F.array(*[F.lit(d) for d in [0, *band]])).alias("d")
    each = spark.range(n).select(F.col("id").alias("row"), around).select("row", (F.col("row") + F.col("d")).alias("col"), "d")
    diagonal = abs(off_diagonal) * len(band) + margin
    value = F.when(F.col("d") == 0, float(diagonal)).otherwise(float(off_diagonal))
    return SparseMatrix(each.where(F.col("col").between(0, n - 1)).select("row", "col", value.alias("val")), n)


#: Rounds of the permutation that random cells are drawn by.
MIXING_ROUNDS = 6


def random_cells(spark: SparkSession, n: int, count: int, seed: int = 0) -> DataFrame:
    """`count` different cells (row, col) of an n x n matrix.

    Cell numbers 0 .. n^2 - 1 are permuted by a keyed Feistel network over pairs of
    numbers below n, and the first `count` are taken: exactly as many as asked for,
    without repeats, and the same on any cluster.
    """
    if not 0 <= count <= n * n:
        raise ValueError(f"an {n} x {n} matrix has no {count} cells")
    pairs = spark.range(count).select(F.expr(f"id div {n}L").alias("row"), F.expr(f"id % {n}L").alias("col"))
    for k in range(MIXING_ROUNDS):
        pairs = pairs.select(F.col("col").alias("row"), F.pmod(F.col("row") + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "col"), F.lit(n)), F.lit(n)).alias("col"))
    return pairs


def random_dominant(spark: SparkSession, n: int, density: float, seed: int = 0, largest: float = 100.0) -> SparseMatrix:
    """round(density n^2) random entries in (-largest, largest), their row's absolute sum and 1 added on the diagonal.

    The work is that of the entries, and the same arguments give the same matrix on any cluster.
    """
    chance = lambda *k: F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1 << 40)) / float(1 << 40)
    drawn = random_cells(spark, n, round(density * n * n), seed).withColumn("val", (chance(F.lit("val"), F.col("row"), F.col("col")) * 2 - 1) * largest)
    sums = drawn.groupBy("row").agg(F.sum(F.abs("val")).alias("s"))
    boost = spark.range(n).join(sums, F.col("id") == F.col("row"), "left").select(F.col("id").alias("row"), F.col("id").alias("col"), (F.coalesce("s", F.lit(0.0)) + 1).alias("val"))
    return SparseMatrix.of(drawn.unionByName(boost), n, check=False)


def write_banded(spark: SparkSession, path: str, n: int, m: int, near: Iterable[int] = (1, 2), off_diagonal: float = -1.0, margin: float = 0.1) -> None:
    """A band matrix as a MatrixMarket folder, whose commit fails unless it has `banded_nnz` entries."""
    from .mtx_source import register

    register(spark)
    near = list(near)
    matrix = banded(spark, n, m, near, off_diagonal, margin)
    matrix.entries.write.format("mtx").option("n", n).option("entries", banded_nnz(n, offsets(near, m))).mode("append").save(path)


def dominant(edges: DataFrame, nodes: DataFrame, n: int) -> SparseMatrix:
    """Off-diagonal entries (row, col, val) with a diagonal of the row's absolute sum and 1."""
    sums = edges.groupBy("row").agg(F.sum(F.abs("val")).alias("s"))
    diagonal = nodes.select(F.col("id").alias("row")).join(sums, "row", "left").select("row", F.col("row").alias("col"), (F.coalesce("s", F.lit(0.0)) + 1).alias("val"))
    return SparseMatrix(edges.unionByName(diagonal), n)


def part_adjacency(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Parts that follow each other in an order, weighted by the second item's quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    first = items.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("row"))
    second = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("col"), "l_quantity")
    pairs = first.join(second, ["l_orderkey", "l_linenumber"]).where("row <> col")
    edges = pairs.groupBy("row", "col").agg((-F.sum("l_quantity")).alias("val"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return dominant(edges, parts, parts.count())


def part_chain(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Tridiagonal over parts: 4 + size mod 3 on the diagonal, -1 beside it."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), (4.0 + F.col("p_size") % 3).alias("d"))
    n = parts.count()
    beside = lambda k: F.struct((F.col("row") + k).alias("col"), F.lit(-1.0).alias("val"))
    own = F.struct(F.col("row").alias("col"), F.col("d").alias("val"))
    each = parts.select("row", F.explode(F.array(beside(-1), own, beside(1))).alias("e")).select("row", "e.col", "e.val")
    return SparseMatrix(each.where(F.col("col").between(0, n - 1)), n)


def test_vector(spark: SparkSession, n: int, kind: str = "permutation", unit: int = 0, seed: int = 42) -> DataFrame:
    """Vectors for checks: a permutation of 0..n-1, a unit vector, a wave, or uniform in (-1, 1)."""
    from math import gcd

    i = F.col("id")
    if kind == "permutation":
        a = next(k for k in range(n // 2 + 1 + seed % 7, 2 * n + 9) if gcd(k, n) == 1)
        x = F.pmod(i * a + seed, F.lit(n)).cast("double")
    elif kind == "unit":
        x = (i == unit).cast("double")
    elif kind == "wave":
        x = 1 + 0.5 * F.sin(i / 100)  # the quotient is rounded once; 0.01 * i is rounded twice
    elif kind == "uniform":
        x = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 40)) / float(1 << 39) - 1
    else:
        raise ValueError(f"no such vector: {kind}")
    return spark.range(n).select("id", x.alias("x"))
