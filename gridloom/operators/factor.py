"""Incomplete factorization without fill-in over row blocks; solve and multiply.

The answer depends on the number of blocks: rows are reordered inside each block,
interior rows first, and ILU(0) is that of the reordered matrix.  Interior rows are
eliminated once.  Separator rows are swept: every sweep starts from their original
values, takes the rows they need of lower blocks as the last sweep left them, and
eliminates; since blocks only need lower ones, the sweeps end, after num_blocks at
most and one that changes nothing.  Each sweep is a cogrouped job, one task a block,
whose result is written to the shared folder.  Where a block has more than BLOCK_ENTRIES
entries no task holds it: the same sweeps run as joins (`fixed_point.sweep`).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove, use_package, written
from . import fixed_point, kernels, substitution
from .blocks import block_of, classify, first_row, permutation, permuted
from .matrix import SparseMatrix

LU = "row long, col long, val double, a0 double, block int, is_sep boolean, before double, skipped int, seconds double"
#: Entries of a block that one task eliminates, at most.
BLOCK_ENTRIES = 500_000
_NAMES = [x.split()[0] for x in LU.split(", ")]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(x).to_numpy() for x in names]


def _lu_table(rows: dict[int, kernels.Row], source: pa.Table, skipped: dict[int, int], before: np.ndarray, began: float) -> pa.Table:
    """`source` (sorted by row and col) with values from `rows`; its first row has the seconds since `began`."""
    row = source.column("row").to_numpy()
    val = np.concatenate([np.zeros(0), *(rows[r][1] for r in sorted(rows))])
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    skips = np.array([skipped.get(r, 0) if f else 0 for r, f in zip(row.tolist(), first, strict=True)], np.int32)
    cols = {"row": source.column("row"), "col": source.column("col"), "val": val, "a0": source.column("a0"), "block": source.column("block"), "is_sep": source.column("is_sep"), "before": before, "skipped": skips}
    cols["seconds"] = np.zeros(len(row))
    cols["seconds"][:1] = time.perf_counter() - began
    return pa.table([pa.chunked_array([pa.array(v)]) if isinstance(v, np.ndarray) else v for v in cols.values()], names=_NAMES)


def _interior(table: pa.Table) -> pa.Table:
    began = time.perf_counter()
    table = table.sort_by([("row", "ascending"), ("col", "ascending")])
    row, col, val, is_sep = _columns(table, "row", "col", "a0", "is_sep")
    inner, outer = kernels.rows_of(row[~is_sep], col[~is_sep], val[~is_sep]), kernels.rows_of(row[is_sep], col[is_sep], val[is_sep])
    skipped = kernels.eliminate(inner, {})
    return _lu_table(inner | outer, table, skipped, val, began)


def _sweep(table: pa.Table, ghosts: pa.Table) -> pa.Table:
    """Separator rows of a block from their original values and the pivot rows they need."""
    began = time.perf_counter()
    if not table.num_rows:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.float64(), pa.int32(), pa.float64())
        return pa.table([pa.array([], t) for t in kinds], names=_NAMES)
    table = table.sort_by([("row", "ascending"), ("col", "ascending")])
    row, col, val, a0 = _columns(table, "row", "col", "val", "a0")
    rows = kernels.rows_of(row, col, a0)
    skipped = kernels.eliminate(rows, kernels.rows_of(*_columns(ghosts, "g_row", "g_col", "g_val")))
    return _lu_table(rows, table, skipped, val, began)


@dataclass(frozen=True)
class Factorization:
    """LU in permuted ids: left of the diagonal L (its diagonal is 1), the rest U.

    `inner` holds interior rows, `outer` separator rows; `lu` is both.  All tables, also
    those that solves make once and use again, are in `folder` until `free`.
    """

    n: int
    num_blocks: int
    inner: DataFrame
    outer: DataFrame
    perm: DataFrame
    sweeps: int
    skipped: int
    folder: str
    missing_diag: str = "raise"
    wedges: DataFrame | None = None  # (i, j, k) of the pattern, where factorizing listed them
    _steps: dict[str, list[DataFrame]] = field(default_factory=dict, repr=False, compare=False)
    _plans: dict[bool, substitution.Triangle] = field(default_factory=dict, repr=False, compare=False)

    @property
    def lu(self) -> DataFrame:
        return self.inner.unionByName(self.outer)

    def unpermuted(self) -> DataFrame:
        """(row, col, val) in original ids."""
        new = self.perm.select("old_id", "new_id")
        by_row, by_col = new.toDF("o_row", "row"), new.toDF("o_col", "col")
        return self.lu.join(by_row, "row").join(by_col, "col").select(F.col("o_row").alias("row"), F.col("o_col").alias("col"), "val")

    def _moved(self, vector: DataFrame) -> DataFrame:
        """A vector (id, x) by new ids, with blocks; places that it lacks are 0."""
        whole = self.perm.join(vector, F.col("old_id") == F.col("id"), "left")
        return whole.select(F.col("new_id").alias("id"), F.coalesce("x", F.lit(0.0)).alias("x"), "block", "is_sep")

    def _back(self, vector: DataFrame) -> DataFrame:
        return vector.join(self.perm.select("old_id", F.col("new_id").alias("id")), "id").select(F.col("old_id").alias("id"), "x")

    def multiply(self, vector: DataFrame) -> DataFrame:
        """L (U x): two products by join and grouped sum, for any number of blocks."""
        moved = self._moved(vector).select("id", "x")
        gather = lambda part, v: part.join(v, F.col("col") == F.col("id")).groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("s"))
        every = moved.select("id")
        t = every.join(gather(self.lu.where("col >= row"), moved), F.col("id") == F.col("row"), "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x"))
        low = gather(self.lu.where("col < row"), t)
        y = t.join(low, F.col("id") == F.col("row"), "left").select("id", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        return self._back(y)

    def _plan(self, upper: bool) -> substitution.Triangle:
        """What solves with one triangle need; made at the first."""
        if upper not in self._plans:
            self._plans[upper] = substitution.triangle(self.lu, self.perm, self.n, self.num_blocks, upper, self.missing_diag, self.folder)
        return self._plans[upper]

    def solve(self, vector: DataFrame) -> DataFrame:
        """x with L U x = b.  A missing or zero pivot is an error, or 1 with missing_diag="one"."""
        first, forward = self._plan(False).solve(written(self._moved(vector).select("id", "x"), "vector", self.folder))
        second, backward = self._plan(True).solve(first)
        self._steps["solve"] = forward + backward
        return self._back(second)

    def seconds(self, call: str) -> DataFrame:
        """(step, unit, seconds): what kernels took for each block or unit in the steps of the last "factorize" or "solve".

        Other calls, and factorizing by entries, run in joins: they have no rows.
        """
        found = [x.groupBy("unit").agg(F.sum("seconds").alias("seconds")).select(F.lit(k).alias("step"), "unit", "seconds") for k, x in enumerate(self._steps.get(call, []))]
        return reduce(DataFrame.unionByName, found) if found else self.perm.sparkSession.createDataFrame([], "step int, unit long, seconds double")

    def slowest(self, call: str) -> float | None:
        """The seconds of the slowest block or unit over all steps of a call."""
        return self.seconds(call).groupBy("unit").agg(F.sum("seconds").alias("s")).agg(F.max("s")).first()[0]

    def pivots(self) -> DataFrame:
        return self.lu.where("row = col").select(F.col("row").alias("id"), F.col("val").alias("pivot"))

    def split(self) -> tuple[DataFrame, DataFrame]:
        """L without its diagonal, and U."""
        return self.lu.where("col < row").select("row", "col", "val"), self.lu.where("col >= row").select("row", "col", "val")

    def free(self) -> None:
        """Delete all tables of the factorization; results of solve and multiply that aren't written go with them."""
        for plan in self._plans.values():
            if plan.step is not None:
                plan.step.unpersist()
        remove(self.perm.sparkSession, self.folder)


def factorize(matrix: SparseMatrix, num_blocks: int = 1, tol: float = 1e-12, classify_mode: str = "direct", missing_diag: str = "raise", method: str = "blocks") -> Factorization:
    """ILU(0) of the matrix reordered for `num_blocks` blocks.

    method="blocks" eliminates blocks, small ones in one task each, and sweeps the separators;
    method="entries" computes all entries as a fixed point of joins, in many tasks however
    large a block is.  The factors are the same.  `sweeps` of the handle counts sweeps
    or rounds.  Empty blocks (more blocks than rows) are allowed.  Values that aren't
    finite in the result are an error.  `skipped` counts updates by tiny pivots.
    """
    spark, n = matrix.entries.sparkSession, matrix.n
    use_package(spark)
    if num_blocks < 1 or n < 1:
        raise ValueError("a factorization needs a row and a block at least")
    if method not in ("blocks", "entries"):
        raise ValueError("method is blocks or entries")
    folder = new_path(spark, "factor")
    matrix = SparseMatrix(written(matrix.entries, "entries", folder), n)
    if missing_diag == "raise" and (with_diagonal := matrix.entries.where("row = col").count()) < n:
        raise ValueError(f"{n - with_diagonal} rows have no diagonal entry")
    perm = written(permutation(classify(matrix, num_blocks, classify_mode), n, num_blocks), "perm", folder)
    placed = permuted(matrix, perm).select("row", "col", F.col("val").alias("a0"), "block", "is_sep")
    if method == "blocks":
        sizes = matrix.entries.groupBy(block_of("row", n, num_blocks).alias("b")).agg(F.count("*").alias("k"))
        by_joins = (sizes.agg(F.max("k")).first()[0] or 0) > BLOCK_ENTRIES
    if method == "entries" or by_joins:
        placed = written(placed, "placed", folder)
        settled, rounds, wedges = fixed_point.settle(placed, folder) if method == "entries" else fixed_point.sweep(placed, perm, num_blocks, tol, folder)
        lu = written(fixed_point.factors(settled).withColumns({"before": F.col("val"), "seconds": F.lit(0.0)}).select(*_NAMES), "factors", folder)
        return _checked(Factorization(n, num_blocks, lu.where(~F.col("is_sep")), lu.where("is_sep"), perm, rounds, 0, folder, missing_diag, wedges))
    started = written(placed.groupBy("block").applyInArrow(_interior, LU), "interior", folder)
    inner, outer = started.where(~F.col("is_sep")), started.where("is_sep")
    as_ghosts = lambda lu: lu.where("col >= row").select(F.col("row").alias("g_row"), F.col("col").alias("g_col"), F.col("val").alias("g_val"))
    separators, sweeps, steps = outer.limit(1).count(), 1, [started]
    if separators:
        # what separators eliminate with: interior rows don't change, so their copies are made once
        wanted = written(outer.where("col < row").select(F.col("block").alias("g_block"), F.col("col").alias("g_row")).distinct(), "need", folder)
        remote = wanted.where(F.col("g_row") < first_row("g_block", n, num_blocks))
        still = written(as_ghosts(inner).join(wanted, "g_row").select("g_block", "g_row", "g_col", "g_val"), "pivots", folder)
    while separators:
        moving = as_ghosts(outer).join(remote, "g_row").select("g_block", "g_row", "g_col", "g_val")
        ghosts = still.unionByName(moving)
        seen = Observation()
        swept = outer.groupBy("block").cogroup(ghosts.groupBy("g_block")).applyInArrow(_sweep, LU)
        outer = written(swept.observe(seen, F.max(F.abs(F.col("val") - F.col("before"))).alias("change")), "sweep", folder)
        steps.append(outer)
        change = seen.get["change"]
        if not change or change < tol:
            break
        if sweeps > num_blocks + 1:
            raise RuntimeError(f"sweeps still change values by {change} after {sweeps}")
        sweeps += 1
    fact = Factorization(n, num_blocks, inner, outer, perm, sweeps, 0, folder, missing_diag)
    fact._steps["factorize"] = [x.select(F.col("block").cast("long").alias("unit"), "seconds") for x in steps]
    return _checked(fact)


def _checked(fact: Factorization) -> Factorization:
    """The handle with its count of skipped updates, once all values are known to be finite."""
    bad, skipped = fact.lu.agg(F.max((F.isnan("val") | (F.abs("val") == float("inf"))).cast("int")), F.sum("skipped")).first()
    if bad:
        raise FloatingPointError("the factors hold values that aren't finite")
    return replace(fact, skipped=int(skipped or 0))
