"""Timed and checked runs over matrices and block counts, as rows of a results table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import verify
from ..operators.factor import factorize
from ..operators.matrix import SparseMatrix
from ..sources import generators

SAMPLES = "file string, matrix string, phase string, workers int, nodes int, n long, nnz long, time_s double, slowest_s double"
CHECKS = "matrix string, workers int, check string, error double, passed boolean"
#: Largest differences that pass.
RECONSTRUCT_TOLERANCE, VECTOR_TOLERANCE, SANITY_TOLERANCE = 1e-4, 1e-3, 1e-4


def _timed(f: Callable[[], object]) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def _whole(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def perf(spark: SparkSession, name: str, matrix: SparseMatrix, num_blocks: Iterable[int] = (1,), reps: int = 20, nodes: int = 1) -> DataFrame:
    """Samples of factorize (once), multiply and solve (`reps` times each) for each block count.

    Workers are blocks here.  time_s is the driver's, slowest_s what kernels took in the
    slowest block of the call (null where joins do the work).  `logs.summary` and
    `logs.speedup` take these rows.
    """
    nnz, rows = matrix.entries.count(), []
    x = generators.test_vector(spark, matrix.n, "uniform", seed=1234)
    for p in num_blocks:
        made: list = []
        took = [("factorize", _timed(lambda p=p: made.append(factorize(matrix, p))))]
        took[0] += (made[0].slowest("factorize"),)
        took += [("multiply", _timed(lambda: _whole(made[0].multiply(x))), None) for _ in range(reps)]
        took += [("solve", _timed(lambda: _whole(made[0].solve(x))), made[0].slowest("solve")) for _ in range(reps)]
        rows += [(f"{name}.p{p}", name, phase, p, nodes, matrix.n, nnz if phase == "factorize" else None, t, slowest) for phase, t, slowest in took]
        made[0].free()
    return spark.createDataFrame(rows, SAMPLES)


def append(samples: DataFrame, path: str) -> None:
    """Add samples to a results table (Parquet); each call is committed as a whole."""
    samples.write.mode("append").parquet(path)


def correctness(spark: SparkSession, name: str, matrix: SparseMatrix, num_blocks: Iterable[int] = (1,), checks: Iterable[str] = ("reconstruct", "vector", "sanity"), trials: int = 3, seed: int = 42) -> DataFrame:
    """One row for each check: its largest error and whether it passes."""
    rows, wanted = [], tuple(checks)
    for p in num_blocks:
        fact = factorize(matrix, p)
        if "reconstruct" in wanted:
            e = verify.reconstruct_error(fact, matrix)
            rows.append((name, p, "reconstruct", e, e < RECONSTRUCT_TOLERANCE))
        if "vector" in wanted:
            e = max(verify.round_trip_error(fact, generators.test_vector(spark, matrix.n, "permutation", seed=seed + t)) for t in range(trials))
            rows.append((name, p, "vector", e, e < VECTOR_TOLERANCE))
        if "sanity" in wanted:
            e = verify.sanity_error(fact, generators.test_vector(spark, matrix.n, "wave"))
            rows.append((name, p, "sanity", e, e < SANITY_TOLERANCE))
    return spark.createDataFrame(rows, CHECKS)


def offset_sweep(spark: SparkSession, n: int, offsets: Iterable[int], num_blocks: Iterable[int] = (16,), reps: int = 20, results: DataFrame | None = None) -> DataFrame:
    """perf over band matrices of growing largest offset, named so that reports order them.

    Offsets and block counts that `results` (earlier samples) has are left out.
    """
    found = spark.createDataFrame([], SAMPLES)
    done = set() if results is None else {tuple(r) for r in results.select("matrix", "workers").distinct().collect()}  # a row a run
    for m in offsets:
        name = f"band_n{n}_m{m}.mtx"
        if left := [p for p in num_blocks if (name, p) not in done]:
            found = found.unionByName(perf(spark, name, generators.banded(spark, n, m), left, reps))
    return found
