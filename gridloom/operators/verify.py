"""Checks of a factorization against its matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixed_point
from .factor import Factorization
from .matrix import SparseMatrix


def reconstruct(fact: Factorization, matrix: SparseMatrix) -> DataFrame:
    """(row, col, val, made): entries of the matrix and of L U, which agree on its pattern.

    Only products that land on the pattern are made (see `masked_wedges`), so a dense row
    or column doesn't multiply with itself.
    """
    new = fact.perm.select("old_id", "new_id")
    lu = fact.lu.select("row", "col", "val")
    low = lu.where("col < row").select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("val").alias("l"))
    up = lu.where("col >= row").select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("u"))
    # beside the wedges: the unit diagonal of L with U, and L with U's diagonal
    own = up.select(F.col("k").alias("i"), "j", F.col("u").alias("p"))
    last = low.join(up.where("k = j"), "k").select("i", "j", (F.col("l") * F.col("u")).alias("p"))
    wedges = fact.wedges if fact.wedges is not None else fixed_point.masked_wedges(lu)
    products = wedges.join(low, ["i", "k"]).join(up, ["k", "j"]).select("i", "j", (F.col("l") * F.col("u")).alias("p"))
    made = products.unionByName(own).unionByName(last).groupBy("i", "j").agg(F.sum("p").alias("made"))
    made = made.join(new.toDF("row", "i"), "i").join(new.toDF("col", "j"), "j").select("row", "col", "made")
    return matrix.entries.join(made, ["row", "col"], "left").select("row", "col", "val", F.coalesce("made", F.lit(0.0)).alias("made"))


def reconstruct_error(fact: Factorization, matrix: SparseMatrix) -> float:
    return reconstruct(fact, matrix).agg(F.max(F.abs(F.col("val") - F.col("made")))).first()[0] or 0.0


def round_trip(fact: Factorization, vector: DataFrame) -> DataFrame:
    """(id, x, back): a vector and what solve makes of its product."""
    back = fact.solve(fact.multiply(vector)).withColumnRenamed("x", "back")
    return vector.join(back, "id")


def round_trip_error(fact: Factorization, vector: DataFrame) -> float:
    """The largest difference; a value that isn't finite counts as 1e30."""
    gap = F.abs(F.col("x") - F.col("back"))
    gap = F.when(F.isnan(gap) | gap.isNull() | (gap == float("inf")), 1e30).otherwise(gap)
    return round_trip(fact, vector).agg(F.max(gap)).first()[0] or 0.0


def sanity_error(fact: Factorization, vector: DataFrame) -> float:
    """The largest difference between a vector and the product of its solution."""
    back = fact.multiply(fact.solve(vector)).withColumnRenamed("x", "y")
    gap = F.abs(F.col("x") - F.col("y"))
    return vector.join(back, "id").agg(F.max(F.when(F.isnan(gap) | gap.isNull(), 1e30).otherwise(gap))).first()[0] or 0.0
