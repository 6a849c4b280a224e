"""Column expressions of the block layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(row: str, n: int, num_blocks: int) -> Column:
    """The block of a row: block b has rows floor(b n / P) to floor((b + 1) n / P) - 1."""
    return F.expr(f"cast((({row} + 1) * {num_blocks}L - 1) div {n}L as int)")


def first_row(block: str, n: int, num_blocks: int) -> Column:
    return F.expr(f"({block} * {n}L) div {num_blocks}L")


def piece_rows(n: int) -> int:
    """Rows of a piece where n rows are numbered in two levels: about 1024 pieces, of 65,536 rows at most."""
    return max(1, min(65_536, n // 1024))
