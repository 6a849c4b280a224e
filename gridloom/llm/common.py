"""What the corpus operators share, beside the shared folder of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, table, use_package, written

__all__ = ["ascii_lower", "columns", "fresh", "new_path", "shuffled", "table", "use_package", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def columns(docs: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the names the operator uses.

    Extra columns of the input, whatever their names, never meet internal ones.
    """
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in named.items()])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores ahead of it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, which the next join sorts and merges and never broadcasts.

    For tables that grow with the input: behind an explode, a function over batches or a
    file of repeated values Spark sizes them too low by far, and a broadcast goes through the driver.
    """
    return df.hint("merge")
