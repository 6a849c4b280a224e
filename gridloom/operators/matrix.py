"""Sparse matrices as DataFrames of coordinates (row, col, val), 0-based."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import piece_rows


def wrong_entry(n: int) -> Column:
    """Whether (row, col, val) is null, outside n x n or not finite."""
    inside = F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)
    finite = ~(F.isnan("val") | (F.abs("val") == float("inf")))
    return ~F.coalesce(inside & finite, F.lit(False))


#: Binary digits of exponents that share a bin, and of the lower part of a number in its bin.
BIN, LOW = 32, 44


def exact_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): sums of doubles that don't depend on order, partitions or partial sums.

    A number is an integer times the unit of its bin of exponents; the integers are added
    exactly, in two parts, and the at most 70 bins of a key are put together from the
    largest down.  Partial sums are made before the shuffle; no task gathers a key's numbers.
    """
    x = F.col(value)
    scaled = lambda v, k: v * F.pow(F.lit(2.0), F.floor(k / 2)) * F.pow(F.lit(2.0), k - F.floor(k / 2))
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    cut = rows.select(key, x.alias("x"), F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / BIN)).alias("bin"))
    whole = cut.withColumn("i", scaled(F.col("x"), F.lit(54) - F.col("bin") * BIN))
    parts = whole.withColumn("hi", F.floor(F.col("i") / float(1 << LOW)).cast("long")).withColumn("lo", (F.col("i") - F.col("hi").cast("double") * float(1 << LOW)).cast("long"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    bins = parts.groupBy(key, "bin").agg(total("hi").alias("hi"), total("lo").alias("lo"), F.sum(F.when(F.col("bin").isNull(), F.col("x"))).alias("odd"))
    # both parts as one integer, split anew so that each half is exact as a double
    carry = F.floor(F.col("lo") / F.lit(1 << LOW).cast("decimal(20,0)"))
    high, low = (F.col("hi") + carry).cast("double"), (F.col("lo") - carry * F.lit(1 << LOW).cast("decimal(20,0)")).cast("double")
    made = scaled(high * float(1 << LOW) + low, F.col("bin") * BIN - 54)
    each = bins.select(key, F.struct(F.coalesce(-F.col("bin"), F.lit(-9999)).alias("at"), F.coalesce(made, "odd", F.lit(0.0)).alias("v")).alias("b"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("b")).select(key, F.aggregate("b.v", F.lit(0.0), lambda s, v: s + v).alias(value))


@dataclass(frozen=True)
class SparseMatrix:
    """A square matrix: entries (row long, col long, val double), no place twice."""

    entries: DataFrame
    n: int

    @staticmethod
    def of(entries: DataFrame, n: int, duplicates: str = "sum", check: bool = True) -> SparseMatrix:
        """Take entries from any table with columns row, col, val.

        Entries of one place are added up, or are an error with duplicates="error".
        Places outside n x n, nulls and values that aren't finite are errors; looking for
        them costs one pass, which check=False saves for entries known to be right.
        """
        rows = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
        if check:
            if wrong := rows.where(wrong_entry(n)).head(1):
                raise ValueError(f"entry outside the matrix or not finite: {wrong[0]}")
        summed = rows.groupBy("row", "col").agg(F.sum("val").alias("val"), F.count("*").alias("n"))
        if duplicates == "error" and (twice := summed.where("n > 1").head(1)):
            raise ValueError(f"place given more than once: {twice[0]}")
        return SparseMatrix(summed.drop("n"), n)

    def lower(self) -> DataFrame:
        return self.entries.where("col < row")

    def upper(self) -> DataFrame:
        return self.entries.where("col >= row")

    def diagonal(self) -> DataFrame:
        return self.entries.where("col = row").select(F.col("row").alias("id"), F.col("val").alias("x"))

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.n)

    def times(self, vector: DataFrame, ordered: bool = False) -> DataFrame:
        """A x for a vector (id, x): rows without entries have 0.

        ordered=True adds exactly and rounds once a bin (`exact_sums`), so that no bit
        depends on how rows were dealt.
        """
        products = self.entries.join(vector, F.col("col") == F.col("id")).select("row", (F.col("val") * F.col("x")).alias("p"))
        sums = exact_sums(products, "row", "p") if ordered else products.groupBy("row").agg(F.sum("p").alias("p"))
        sums = sums.select(F.col("row").alias("id"), F.col("p").alias("x"))
        every = self.entries.sparkSession.range(self.n)
        return every.join(sums, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))

    def row_counts(self) -> DataFrame:
        return self.entries.groupBy("row").agg(F.count("*").alias("nnz"))

    def row_sums(self) -> DataFrame:
        """Sums of absolute values by row, with and without the diagonal."""
        away = F.when(F.col("row") != F.col("col"), F.abs("val")).otherwise(F.lit(0.0))
        return self.entries.groupBy("row").agg(F.sum(F.abs("val")).alias("abs_sum"), F.sum(away).alias("off_sum"))

    def row_pointers(self) -> DataFrame:
        """row, first: how many entries come before the row's in row order.

        Totals of row ranges are summed first, so no task orders all rows.
        """
        from pyspark.sql import Window

        size = piece_rows(self.n)
        counts = self.entries.sparkSession.range(self.n).join(self.row_counts(), F.col("id") == F.col("row"), "left")
        counts = counts.select(F.col("id").alias("row"), F.coalesce("nnz", F.lit(0)).alias("nnz"), F.floor(F.col("id") / size).alias("range"))
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = counts.groupBy("range").agg(F.sum("nnz").alias("t")).select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("inner", F.coalesce(F.sum("nnz").over(inside), F.lit(0))).join(ranges, "range")
        return placed.select("row", (F.col("base") + F.col("inner")).alias("first"))

    def stats(self) -> DataFrame:
        """One row: n, nnz, nnz_per_row, largest absolute value, rows that aren't dominated by their diagonal."""
        diagonal = F.sum(F.when(F.col("row") == F.col("col"), F.abs("val")).otherwise(0.0))
        away = F.sum(F.when(F.col("row") != F.col("col"), F.abs("val")).otherwise(0.0))
        rows = self.entries.groupBy("row").agg(F.count("*").alias("c"), diagonal.alias("d"), away.alias("o"), F.max(F.abs("val")).alias("m"))
        one = rows.agg(F.sum("c").alias("nnz"), F.max("m").alias("max_abs"), F.sum((F.col("d") <= F.col("o")).cast("long")).alias("not_dominant"))
        return one.select(F.lit(self.n).cast("long").alias("n"), "nnz", (F.col("nnz") / self.n).alias("nnz_per_row"), "max_abs", "not_dominant")
