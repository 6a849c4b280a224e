"""Row blocks, separator rows, the block-wise permutation and what blocks need of others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import block_of, first_row, piece_rows
from ..sources.shared import new_path, use_package, written
from .matrix import SparseMatrix


def classify(matrix: SparseMatrix, num_blocks: int, mode: str = "direct") -> DataFrame:
    """(row, block, is_sep) of every row: separators have a column before their block.

    mode="closure" also takes rows that depend on a separator of their own block.
    """
    n = matrix.n
    every = matrix.entries.sparkSession.range(n).select(F.col("id").alias("row"), block_of("id", n, num_blocks).alias("block"))
    least = matrix.entries.groupBy("row").agg(F.min("col").alias("least"))
    direct = every.join(least, "row", "left").select("row", "block", F.coalesce(F.col("least") < first_row("block", n, num_blocks), F.lit(False)).alias("is_sep"))
    if mode == "direct":
        return direct
    if mode != "closure":
        raise ValueError("mode is direct or closure")
    return _closed(direct, matrix, num_blocks)


#: Rows of a piece that a task of the closure works through, at most.
CLOSURE_ROWS = 65_536


def _closed(direct: DataFrame, matrix: SparseMatrix, num_blocks: int) -> DataFrame:
    """`direct` with all rows that depend on a separator of their block, however far.

    Only new separators go on: rows that refer to them, and what depends on those inside
    the same piece of rows, are the next ones.  So rounds count steps from piece to piece.
    """
    spark, n = direct.sparkSession, matrix.n
    use_package(spark)
    folder = new_path(spark, "closure")
    size = max(1, min(CLOSURE_ROWS, n // 8))
    piece = lambda c: F.floor(F.col(c) / size)
    blocks = direct.select("row", "block")
    edges = matrix.entries.where("col < row").select("row", "col").join(blocks, "row").where(F.col("col") >= first_row("block", n, num_blocks))
    edges = written(edges.select("row", "col", piece("row").alias("piece"), (piece("row") == piece("col")).alias("inside")), "edges", folder)

    def grow(table: pa.Table, hits: pa.Table) -> pa.Table:
        found = set(hits.column("hit").to_pylist())
        order = np.argsort(rows := table.column("row").to_numpy(), kind="stable")
        for r, c in zip(rows[order].tolist(), table.column("col").to_numpy()[order].tolist(), strict=True):
            if c in found:  # columns are smaller, so one ascending pass is enough
                found.add(r)
        return pa.table({"row": pa.array(sorted(found), pa.int64())})

    reached = new = written(direct.where("is_sep").select("row"), "reached", folder)
    while new.limit(1).count():
        hits = edges.join(new.withColumnRenamed("row", "col"), "col", "left_semi").select("row").distinct().join(reached, "row", "left_anti")
        hits = hits.select(F.col("row").alias("hit"), piece("row").alias("of"))
        near = edges.where("inside").join(hits.select(F.col("of").alias("piece")).distinct(), "piece", "left_semi")
        grown = near.groupBy("piece").cogroup(hits.groupBy("of")).applyInArrow(grow, "row long")
        new = written(grown.join(reached, "row", "left_anti"), "new", folder)
        reached = reached.unionByName(new)
    return direct.join(reached.select("row", F.lit(True).alias("far")), "row", "left").select("row", "block", F.coalesce("far", F.lit(False)).alias("is_sep"))


def permutation(classes: DataFrame, n: int, num_blocks: int) -> DataFrame:
    """(old_id, new_id, block, is_sep): interior rows first, then separators, both in order.

    Rows are counted by pieces of the row order first, so no task orders a whole block.
    """
    piece = ["block", "is_sep", "piece"]
    ranged = classes.withColumn("piece", F.floor(F.col("row") / piece_rows(n)))
    before = Window.partitionBy("block").orderBy("is_sep", "piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy(*piece).agg(F.count("*").alias("n")).select(*piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = ranged.withColumn("at", F.row_number().over(Window.partitionBy(*piece).orderBy("row")) - 1).join(firsts, piece)
    return placed.select(F.col("row").alias("old_id"), (F.col("at") + F.col("base") + first_row("block", n, num_blocks)).alias("new_id"), "block", "is_sep")


def permuted(matrix: SparseMatrix, perm: DataFrame) -> DataFrame:
    """Entries with both ids new: row, col, val, block and is_sep of the row."""
    by_row = perm.select(F.col("old_id").alias("row"), F.col("new_id").alias("new_row"), "block", "is_sep")
    by_col = perm.select(F.col("old_id").alias("col"), F.col("new_id").alias("new_col"))
    both = matrix.entries.join(by_row, "row").join(by_col, "col")
    return both.select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val", "block", "is_sep")


def needs(entries: DataFrame, n: int, num_blocks: int, upper: bool = False) -> DataFrame:
    """Distinct (block, col): ids of lower blocks that a block refers to; of higher ones with upper."""
    beyond = F.col("col") >= first_row("(block + 1)", n, num_blocks) if upper else F.col("col") < first_row("block", n, num_blocks)
    return entries.where(beyond).select("block", "col").distinct()
