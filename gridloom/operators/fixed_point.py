"""Incomplete factorization as a fixed point over entries, for blocks of any size.

With w_ij = a_ij - sum over k < min(i, j) of w_ik w_kj / w_kk on the pattern, the factors
are L = w_ij / w_jj left of the diagonal and U = w_ij elsewhere.  Every entry is computed
from the others' last values at once, until none changes: entries depend on entries of
lower rows and columns only, so values are right after as many rounds as the longest chain
of dependencies, whatever they were before, and far earlier where pivots dominate.

A round is joins of the wedges (i, j, k) with the entries they meet and a grouped sum; no
task holds a block, and entries that no wedge meets are in no round.  Once most entries
stand still only those with an input that moved are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import written
from .kernels import TINY

#: More rounds than this are taken for values that never settle (tiny pivots, overflow).
MAX_ROUNDS = 2000
#: Where more than 1 / FRONTIER of the entries moved, all are computed again.
FRONTIER = 4
#: What a term may add to the difference between two orders of a sum, as a part of the sum of sizes.
ROUNDING = 2.0**-52


def masked_wedges(pattern: DataFrame) -> DataFrame:
    """(i, j, k) with k < min(i, j) and (i, k), (k, j), (i, j) all in the pattern (row, col).

    Triangles of the pattern as an undirected graph are listed from their vertex v of
    least degree: entries point to the end with more neighbours, so a vertex has about
    the root of the entries ahead of it at most, and pairs of neighbours of a dense row or
    column are never made.  The directions of two entries at v say which third one the
    wedge needs, if any does: (row, col, v) is all that is looked up.
    """
    off = pattern.where("row <> col").select("row", "col")
    degree = off.select(F.explode(F.array("row", "col")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    of = lambda side: degree.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"))
    known = off.join(of("row"), "row").join(of("col"), "col")
    first = F.struct("n_row", "row") < F.struct("n_col", "col")
    ahead = known.select(F.when(first, F.col("row")).otherwise(F.col("col")).alias("v"), F.when(first, F.col("col")).otherwise(F.col("row")).alias("to"), (F.col("col") < F.col("row")).alias("low"))
    one, two = ahead.toDF("v", "p", "p_low"), ahead.toDF("v", "q", "q_low")
    met = one.join(two, "v").where("p < q and (v < q) = (p_low <> q_low)")
    third = met.select(F.when(F.col("p_low"), F.col("p")).otherwise(F.col("q")).alias("row"), F.when(F.col("p_low"), F.col("q")).otherwise(F.col("p")).alias("col"), "v")
    found = third.join(off, ["row", "col"], "left_semi")
    k, last = F.least("row", "col", "v"), F.greatest("row", "col", "v")
    middle = F.col("row") + F.col("col") + F.col("v") - k - last
    upper = F.when(F.col("v") == last, F.col("row") > F.col("col")).otherwise(F.col("row") < F.col("col"))
    off_diagonal = found.select(F.when(upper, middle).otherwise(last).alias("i"), F.when(upper, last).otherwise(middle).alias("j"), k.alias("k"))
    low, up = off.where("col < row").toDF("i", "k"), off.where("col > row").toDF("k", "i")
    return off_diagonal.unionByName(low.join(up, ["i", "k"]).select("i", F.col("i").alias("j"), "k"))


def _sums(wedges: DataFrame, entries: DataFrame) -> DataFrame:
    """(i, j, s, size, terms): what is taken off each entry that has wedges (i, j, k, p); pivots under TINY take nothing off.

    p is the row that eliminates: k, or -1 - k where a copy of that row is met instead.
    """
    left = entries.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("w").alias("wl"))
    right = entries.select(F.col("row").alias("p"), F.col("col").alias("j"), F.col("w").alias("wr"))
    pivots = entries.where(_on_diagonal()).select(F.col("row").alias("p"), F.col("w").alias("wp"))
    met = wedges.join(left, ["i", "k"]).join(right, ["p", "j"]).join(pivots, "p", "left")
    tiny = F.coalesce(F.abs("wp") < TINY, F.lit(True))
    term = F.when(tiny, 0.0).otherwise(F.col("wl") * F.try_divide(F.col("wr"), F.col("wp")))
    return met.withColumn("term", term).groupBy("i", "j").agg(F.sum("term").alias("s"), F.sum(F.abs("term")).alias("size"), F.count("*").alias("terms"))


def _on_diagonal() -> Column:
    return F.col("col") == F.when(F.col("row") < 0, -1 - F.col("row")).otherwise(F.col("row"))


def _met(wedges: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries that wedges (i, j, k) meet."""
    places = [wedges.select(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in (("i", "j"), ("i", "k"), ("k", "j"), ("k", "k"))]
    return entries.join(places[0].union(places[1]).union(places[2]).union(places[3]).distinct(), ["row", "col"], "left_semi")


def _still(wedges: DataFrame, entries: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Entries (row, col, a0, w and others) with w settled for these wedges (i, j, k, p), and how many rounds that took.

    An entry has moved when it changed by more than the order of its sum can: with one term
    that is any change, so chains settle to the last bit.  What hasn't moved keeps its
    value.  Values that aren't finite count as moved: they are gone once their inputs are
    right, or else the rounds run out, which is an error.
    """
    if not wedges.limit(1).count():
        return entries, 1
    columns = entries.columns
    entries = written(entries.withColumn("moved", F.lit(True)), "settled", folder)
    total, moved, rounds = entries.count(), None, 0
    while moved != 0:
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"{moved} entries still move after {rounds} rounds")
        due = wedges
        if moved is not None and moved * FRONTIER < total:
            out = entries.where("moved").select("row", "col")
            by = [out.toDF("i", "k"), out.toDF("p", "j"), entries.where("moved").where(_on_diagonal()).select(F.col("row").alias("p"))]
            due = [wedges.join(b, b.columns, "left_semi").select("i", "j") for b in by]
            due = wedges.join(due[0].union(due[1]).union(due[2]).distinct(), ["i", "j"], "left_semi")
        sums = _sums(due, entries).withColumnsRenamed({"i": "row", "j": "col"})
        new = F.coalesce(F.col("a0") - F.col("s"), F.col("w"))
        allowed = F.when(F.col("terms") > 1, F.col("terms") * ROUNDING * (F.abs("a0") + F.col("size"))).otherwise(0.0)
        still = F.coalesce((F.abs(new - F.col("w")) <= allowed) & ~F.isnan(new), F.lit(False))
        seen = Observation()
        after = entries.join(sums, ["row", "col"], "left").withColumns({"moved": ~still, "w": F.when(still, F.col("w")).otherwise(new)})
        entries = written(after.select(*columns, "moved").observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")), "settled", folder)
        moved, rounds = seen.get["moved"], rounds + 1
    return entries.select(*columns), rounds


def _with_values(placed: DataFrame, *settled: DataFrame) -> DataFrame:
    """`placed` with w: what settled where it differs from a0, a0 elsewhere."""
    new = [s.where("not w <=> a0").select("row", "col", "w") for s in settled]
    every = new[0] if len(new) == 1 else new[0].unionByName(new[1])
    return placed.join(every, ["row", "col"], "left").withColumn("w", F.coalesce("w", "a0"))


def settle(placed: DataFrame, folder: str) -> tuple[DataFrame, int, DataFrame]:
    """Entries (row, col, a0 and others; a table) with the settled w, how many rounds that took, and the wedges (i, j, k)."""
    wedges = written(masked_wedges(placed), "wedges", folder)
    inputs = _met(wedges, placed.select("row", "col", "a0", F.col("a0").alias("w")))
    found, rounds = _still(wedges.withColumn("p", F.col("k")), inputs, folder)
    return _with_values(placed, found), rounds, wedges


def sweep(placed: DataFrame, perm: DataFrame, num_blocks: int, tol: float, folder: str) -> tuple[DataFrame, int, DataFrame]:
    """As `settle`, by sweeps over blocks; counts sweeps.

    Interior rows settle once.  In a sweep separator rows settle with the separators of
    other blocks as the last sweep left them: those are copies with rows -1 - k.  The
    first sweep meets original values; a sweep that changes no value by `tol` is the last.
    """
    wedges = written(masked_wedges(placed), "wedges", folder)
    of = lambda c: perm.select(F.col("new_id").alias(c), F.col("block").alias(f"{c}_block"), F.col("is_sep").alias(f"{c}_sep"))
    remote = F.col("k_sep") & (F.col("k_block") != F.col("i_block"))
    known = written(wedges.join(of("i"), "i").join(of("k"), "k").select("i", "j", "k", F.when(remote, -1 - F.col("k")).otherwise(F.col("k")).alias("p"), "i_sep"), "wedges-by-block", folder)
    within, outer = (known.where(c).drop("i_sep") for c in ("not i_sep", "i_sep"))
    start = placed.select("row", "col", "a0", F.col("a0").alias("w"))
    inner, _ = _still(within, _met(within, start), folder)
    separators = placed.where("is_sep")
    if not separators.limit(1).count():
        return _with_values(placed, inner), 1, wedges
    # pivots of other blocks' separators that separators divide by, and those of their own block
    below = separators.where("col < row").select("row", "col", "a0", "block").join(of("col"), "col")
    divides = written(below.where("col_sep and col_block <> block").select("col").distinct(), "divides", folder)
    latest = written(_met(outer, _with_values(start.drop("w"), inner)).withColumn("before", F.col("w")), "swept", folder)
    copies = written(outer.where("p < 0").select(F.col("k").alias("row")).distinct(), "copies", folder)
    sweeps, follows = 1, False
    while True:
        frozen = latest.join(copies, "row", "left_semi").withColumn("row", -1 - F.col("row"))
        found, _ = _still(outer, latest.unionByName(frozen), folder)
        latest = written(found.where("row >= 0"), "swept", folder)
        moved = latest.where(F.abs(F.col("w") - F.col("before")) >= tol)
        changed = follows or bool(moved.limit(1).count())
        if not changed and sweeps == 1:  # no value moved, but entries left of the diagonal were divided for the first time
            pivots = _with_values(placed.where("row = col").select("row", "col", "a0"), inner).select("col", "w")
            changed = bool(below.join(pivots, "col").where((F.abs("w") >= TINY) & (F.abs(F.try_divide("a0", "w") - F.col("a0")) >= tol)).limit(1).count())
        if not changed:
            break
        if sweeps > num_blocks + 1:
            raise RuntimeError(f"sweeps still change values after {sweeps}")
        # where a pivot moved, what other blocks divide by it changes in the next sweep
        follows = bool(moved.where("row = col").select("col").join(divides, "col", "left_semi").limit(1).count())
        latest, sweeps = latest.withColumn("before", F.col("w")), sweeps + 1
    return _with_values(placed, inner, latest.join(separators.select("row").distinct(), "row", "left_semi")), sweeps, wedges


def factors(settled: DataFrame) -> DataFrame:
    """Settled entries with val (L left of the diagonal, U elsewhere) and skipped (1 where a tiny pivot divided nothing)."""
    pivots = settled.where("row = col").select(F.col("row").alias("of"), F.col("w").alias("pivot"))
    low = F.col("col") < F.col("row")
    tiny = F.coalesce(F.abs("pivot") < TINY, F.lit(True))
    val = F.when(low & ~tiny, F.try_divide(F.col("w"), F.col("pivot"))).otherwise(F.col("w"))
    below = settled.where(low).join(pivots, F.col("col") == F.col("of"), "left")
    rest = settled.where(~low).withColumn("pivot", F.lit(0.0))
    both = below.drop("of").unionByName(rest)
    return both.withColumns({"val": val, "skipped": (low & tiny).cast("int")}).drop("w", "pivot")
