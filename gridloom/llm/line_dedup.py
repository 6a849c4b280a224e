"""Repeated runs of lines across documents, by overlapping three-line windows.

All of it is DataFrame functions.  Windows are compared by two 64-bit hashes of
their three lines, 128 bits together.  Of a window that occurs more than once the
first occurrence, by document id and line, stays; lines that a later occurrence
covers go.  A line's first occurrence in the corpus is in no later occurrence of a
window, so no line is lost from the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, shuffled

WINDOW_LINES = 3


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, covered (line numbers to remove) of documents that lose lines.

    One row for each window is shuffled twice, as hashes and place: to find each
    repeated window's first place, with partial aggregation before the shuffle, and to
    find the later ones, in a join that adaptive execution splits at frequent windows.
    """
    lines = F.split("text", "\n", -1)
    hashes = lambda i: F.struct(
        i.alias("line"),
        F.xxhash64(*[F.get(F.col("lines"), i + k) for k in range(WINDOW_LINES)]).alias("h1"),
        F.xxhash64(F.lit("second"), *[F.get(F.col("lines"), i + k) for k in range(WINDOW_LINES)]).alias("h2"),
    )
    places = F.sequence(F.lit(0), F.size("lines") - WINDOW_LINES)
    split = docs.select("doc_id", "text_hash", lines.alias("lines")).where(F.size("lines") >= WINDOW_LINES)
    windows = split.select("doc_id", "text_hash", F.explode(F.transform(places, hashes)).alias("w"))
    windows = windows.select("w.h1", "w.h2", F.struct("doc_id", "text_hash", "w.line").alias("place"))
    repeated = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    later = shuffled(windows).join(repeated, ["h1", "h2"]).where("place > first")
    by_doc = later.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set("place.line").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(WINDOW_LINES)]))))
    return by_doc.select("doc_id", "text_hash", covered.alias("covered"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of `docs`, the text without repeated lines, and n_lines and n_removed.

    Lines are cut at \\n.  Texts of fewer than three lines and null texts (no lines)
    stay as they are; a text that loses all its lines is empty.  Rows equal in id and
    text are one document and stay alike; of equal texts under different ids the least
    id keeps its lines.  Extra columns are carried along, but n_lines and n_removed of
    the input give way to the operator's.
    """
    found, n_lines, n_removed = _deduped(docs, id_column, text_column)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return found.select(*own, F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"))


def _deduped(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str, str]:
    """`docs` with the new text and, under two names that it doesn't have, the counts."""
    key, mark, covered, n_lines, n_removed = (fresh(docs, x) for x in ("_doc", "_hash", "_covered", "_n_lines", "_n_removed"))
    text = F.col(f"`{text_column}`")
    gone = covered_lines(columns(docs, doc_id=id_column, text=text_column).withColumn("text_hash", F.xxhash64("text"))).toDF(key, mark, covered)
    found = docs.join(gone, F.col(f"`{id_column}`").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(mark)), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    left = F.when(F.col(covered).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    kept = [left.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    count = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0))
    return found.select(*kept, count.alias(n_lines), F.coalesce(F.when(F.col(covered).isNotNull(), F.size(covered)), F.lit(0)).alias(n_removed)), n_lines, n_removed


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns, without repeated lines; those left with none go."""
    found, n_lines, n_removed = _deduped(docs, "doc_id", "text")
    gone = (F.col(n_removed) > 0) & (F.col(n_removed) == F.col(n_lines))
    return found.where(~gone).select(*[F.col(f"`{c}`") for c in docs.columns])
