"""Blocks and triangles too large for a task: sweeps and solves by joins."""

import numpy as np
import pytest

from gridloom.operators import factor, fixed_point, substitution, verify
from gridloom.operators.factor import factorize
from gridloom.operators.matrix import SparseMatrix
from gridloom.sources import generators as g

from test_factor import GRID, sequential, total
from test_matrix import dense, entries


def test_a_chain_settles_to_the_last_bit(spark):
    n, d = 400, np.random.default_rng(5).integers(4, 7, 400).astype(float).tolist()
    rows = [(i, i + k, d[i] if k == 0 else -1.0) for i in range(n) for k in (-1, 0, 1) if 0 <= i + k < n]
    want = [d[0]]
    for x in d[1:]:
        want.append(x - 1.0 / want[-1])
    found = factorize(SparseMatrix.of(entries(spark, rows), n), 1, method="entries").pivots().orderBy("id").collect()
    assert [r["pivot"] for r in found] == want


@pytest.mark.parametrize("name", ["grid1", "grid2", "grid3", "band", "parts", "random", "wild"])
def test_sweeps_by_joins_are_those_of_blocks(spark, sf_dir, name, monkeypatch):
    random = np.random.default_rng(8)
    wild = [(int(i), int(j), float(random.normal())) for i in range(40) for j in range(40) if i == j or random.random() < 0.12]
    made = {
        "band": lambda: (g.banded(spark, 16, 4), 4), "parts": lambda: (g.part_adjacency(spark, sf_dir), 4),
        "random": lambda: (g.random_dominant(spark, 50, 0.06, 3), 8), "wild": lambda: (SparseMatrix.of(entries(spark, wild), 40), 4),
    }
    m, p = made[name]() if name in made else (g.laplacian(spark, (4, 4), diag_shift=0.1), int(name[-1]))
    one = factorize(m, p)
    called = []
    sweep = fixed_point.sweep
    monkeypatch.setattr(fixed_point, "sweep", lambda *a: called.append(1) or sweep(*a))
    monkeypatch.setattr(factor, "BLOCK_ENTRIES", 0)
    two = factorize(m, p)
    assert called and two.sweeps == one.sweeps and two.skipped == one.skipped
    if name in ("grid1", "grid2", "grid3"):
        assert (total(two), two.sweeps) == (pytest.approx(GRID[p][0], abs=1e-9), GRID[p][1])
    want, _ = sequential(dense(m), p)
    got = np.zeros_like(want)
    for r in two.lu.collect():
        got[r["row"], r["col"]] = r["val"]
    assert np.allclose(got, want, atol=1e-9, rtol=1e-7)
    if name == "parts":
        assert verify.reconstruct_error(two, m) < 1e-6 and two.wedges is not None


@pytest.mark.parametrize("fast", [True, False])
def test_solves_by_steps(spark, sf_dir, fast, monkeypatch):
    """A matrix whose values soon stand still, and one that needs rounds after all."""
    monkeypatch.setattr(substitution, "MAP_VALUES", 0)
    monkeypatch.setattr(substitution, "LEAST_ROWS", 16)
    m = g.part_adjacency(spark, sf_dir) if fast else g.laplacian(spark, (200,), diag_shift=0.01)
    fact = factorize(m, 4)
    x = g.test_vector(spark, m.n)
    assert verify.round_trip_error(fact, x) < 1e-6
    plans = [fact._plans[u] for u in (False, True)]
    assert all(t.step is not None for t in plans) and all(bool(t._made) != fast for t in plans)
    fact.free()


def test_steps_without_a_pivot(spark, monkeypatch):
    monkeypatch.setattr(substitution, "MAP_VALUES", 0)
    monkeypatch.setattr(substitution, "LEAST_ROWS", 1)
    fact = factorize(g.laplacian(spark, (5,)), 1)
    with pytest.raises(ZeroDivisionError, match="singular"):
        fact.solve(g.test_vector(spark, 5)).collect()


@pytest.mark.parametrize("units", [8, 7])
def test_few_units_are_solved_in_rounds(spark, sf_dir, units, monkeypatch):
    """Four blocks of two units; one unit more than allowed is solved in steps."""
    for name, x in (("MAP_VALUES", 0), ("LEAST_ROWS", 16), ("ROUND_ROWS", 16), ("FEW_UNITS", units)):
        monkeypatch.setattr(substitution, name, x, raising=False)
    m = g.part_adjacency(spark, sf_dir)
    fact = factorize(m, 4)
    assert verify.round_trip_error(fact, g.test_vector(spark, m.n)) < 1e-6
    plans = [fact._plans[u] for u in (False, True)]
    assert all((t.step is None and 0 < len(t.rounds) <= 8) == (units == 8) for t in plans)
    fact.free()
