import numpy as np
import pytest

from gridloom.operators import blocks, fixed_point, substitution, verify
from gridloom.operators.factor import factorize
from gridloom.operators.matrix import SparseMatrix
from gridloom.sources import generators as g

from test_matrix import dense, entries


def sequential(a, p, closure=False):
    """ILU(0) of the block-permuted matrix, dense; and the permutation old -> new."""
    n = len(a)
    lo = [b * n // p for b in range(p + 1)]
    order = []
    for b in range(p):
        sep = {}
        for i in range(lo[b], lo[b + 1]):
            sep[i] = bool(np.any(a[i, : lo[b]])) or (closure and any(sep[j] for j in range(lo[b], i) if a[i, j]))
        order += [i for i in sep if not sep[i]] + [i for i in sep if sep[i]]
    m = a[np.ix_(order, order)].copy()
    pattern = m != 0
    for i in range(n):
        for k in range(i):
            if pattern[i, k] and abs(m[k, k]) >= 1e-14:
                m[i, k] /= m[k, k]
                for j in range(k + 1, n):
                    if pattern[i, j]:
                        m[i, j] -= m[i, k] * m[k, j]
    new = np.empty(n, int)
    new[order] = range(n)
    return m, new


def check(spark, m, p, mode="direct"):
    a = dense(m)
    fact = factorize(m, p, classify_mode=mode)
    want, new = sequential(a, p, mode == "closure")
    assert [r["new_id"] for r in fact.perm.orderBy("old_id").collect()] == new.tolist()
    got = np.zeros_like(a)
    for r in fact.lu.collect():
        got[r["row"], r["col"]] = r["val"]
    assert np.allclose(got, want, atol=1e-9, rtol=1e-9)
    assert 1 <= fact.sweeps <= p + 1
    assert verify.reconstruct_error(fact, m) < 1e-4
    assert verify.round_trip_error(fact, g.test_vector(spark, m.n)) < 1e-3
    return fact


def total(fact):
    return sum(r["val"] for r in fact.lu.select("val").collect())


GRID = {1: (7.2462800627, 1), 2: (6.4967216629, 2), 3: (7.6869553361, 3)}


@pytest.mark.parametrize("p", [1, 2, 3])
def test_grid_goldens(spark, p):
    m = g.laplacian(spark, (4, 4), diag_shift=0.1)
    fact = check(spark, m, p)
    assert total(fact) == pytest.approx(GRID[p][0], abs=1e-9) and fact.sweeps == GRID[p][1]
    x = spark.range(16).selectExpr("id", "double(id) as x")
    y = [r["x"] for r in fact.multiply(x).orderBy("id").limit(4).collect()]
    assert np.allclose(y, [-5, -1.9952381, -1.89437387, -0.49320473])


def test_band_golden(spark):
    m = g.banded(spark, 16, 4)
    fact = check(spark, m, 4)
    assert fact.sweeps == 4 and total(fact) == pytest.approx(31.3963866488, abs=1e-9)
    assert np.allclose([r["pivot"] for r in fact.pivots().orderBy("id").limit(4).collect()], [6.1, 5.9360655738, 5.7078431373, 5.6809000344])


def test_singular_chain(spark):
    fact = factorize(g.laplacian(spark, (5,)), 1)
    assert [r["pivot"] for r in fact.pivots().orderBy("id").collect()] == pytest.approx([1, 1, 1, 1, 0])
    with pytest.raises(Exception, match="singular"):
        fact.solve(g.test_vector(spark, 5)).collect()


def test_remote_columns_in_permuted_order(spark):
    a = np.array([[85, 0, 0, 0, -84], [40, 41, 0, 0, 0], [0, 66, 231, -77, -86], [-45, 69, 0, 127, 12], [0, 27, 7, 70, 105.0]])
    m = SparseMatrix.of(entries(spark, [(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)]), 5)
    fact = check(spark, m, 3)
    by_place = {(r["row"], r["col"]): r["val"] for r in fact.unpermuted().collect()}
    assert by_place[4, 1] == pytest.approx(0.609756097561) and fact.sweeps == 2
    assert total(fact) == pytest.approx(399.4629357094)
    x = spark.range(5).selectExpr("id", "double(id) as x")
    assert np.allclose([r["x"] for r in fact.multiply(x).orderBy("id").collect()], [-336, -117.11764706, -47, 498, 671])


@pytest.mark.parametrize("seed,p", [(1, 2), (2, 3), (3, 8)])
def test_random(spark, seed, p):
    check(spark, g.random_dominant(spark, 50, 0.06, seed), p)


def test_closure_and_empty_blocks(spark):
    check(spark, g.random_dominant(spark, 40, 0.05, 4), 4, "closure")
    check(spark, g.laplacian(spark, (3,), diag_shift=1.0), 5)


def test_part_graph(spark, sf_dir):
    m = g.part_adjacency(spark, sf_dir)
    assert m.n == 200 and m.entries.count() == 2936
    one, four = factorize(m, 1), factorize(m, 4)
    assert (one.sweeps, four.sweeps) == (1, 4)
    assert total(one) == pytest.approx(35938.641151, abs=1e-5) and total(four) == pytest.approx(35978.563637, abs=1e-5)
    for p, n in ((1, 0), (4, 149), (8, 169)):
        assert blocks.classify(m, p).where("is_sep").count() == n
    assert min(r["pivot"] for r in one.pivots().collect()) == 99


def test_missing_diagonal(spark):
    m = SparseMatrix.of(entries(spark, [(0, 0, 2.0), (1, 0, 1.0)]), 2)
    with pytest.raises(ValueError):
        factorize(m)
    fact = factorize(m, missing_diag="one")
    b = entries(spark, []).sparkSession.createDataFrame([(0, 4.0), (1, 3.0)], "id long, x double")
    assert [r["x"] for r in fact.solve(b).orderBy("id").collect()] == [2.0, 1.0]


def test_tiny_pivots_are_counted(spark):
    m = SparseMatrix.of(entries(spark, [(0, 0, 0.0), (1, 0, 1.0), (1, 1, 2.0)]), 2)
    assert factorize(m).skipped == 1


def test_plans_are_kept_until_freed(spark):
    import os

    m = g.laplacian(spark, (8, 8), diag_shift=0.1)
    fact = factorize(m, 4)
    x = g.test_vector(spark, m.n)
    first = [r["x"] for r in fact.solve(x).orderBy("id").collect()]
    kept = dict(fact._plans)
    assert [r["x"] for r in fact.solve(x).orderBy("id").collect()] == first and fact._plans == kept and len(kept) == 2
    folder = fact.folder.removeprefix("file://")
    assert os.path.isdir(folder)
    fact.free()
    assert not os.path.exists(folder)


@pytest.mark.parametrize("p", [1, 2, 3])
def test_entries_give_the_same_grid(spark, p):
    fact = factorize(g.laplacian(spark, (4, 4), diag_shift=0.1), p, method="entries")
    assert total(fact) == pytest.approx(GRID[p][0], abs=1e-9)
    if p == 1:
        want = [2.1, 2.6238095238, 2.7188747731, 1.7322007877, 2.6238095238, 3.3377495463, 3.4325977209, 2.2313751659, 2.7188747731, 3.4325977209, 3.5173508921, 2.3675409949, 1.7322007877, 2.2313751659, 2.3675409949, 1.2552416603]
        assert [r["pivot"] for r in fact.pivots().orderBy("id").collect()] == pytest.approx(want, abs=1e-9)


def test_entries_where_nothing_dominates(spark):
    """The matrix of the column order test: values far off in early rounds come right."""
    a = np.array([[85, 0, 0, 0, -84], [40, 41, 0, 0, 0], [0, 66, 231, -77, -86], [-45, 69, 0, 127, 12], [0, 27, 7, 70, 105.0]])
    m = SparseMatrix.of(entries(spark, [(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)]), 5)
    fact = factorize(m, 3, method="entries")
    by_place = {(r["row"], r["col"]): r["val"] for r in fact.unpermuted().collect()}
    assert by_place[4, 1] == pytest.approx(0.609756097561) and total(fact) == pytest.approx(399.4629357094)


def test_entries_and_blocks_agree(spark, sf_dir):
    random = np.random.default_rng(8)
    wild = [(int(i), int(j), float(random.normal())) for i in range(40) for j in range(40) if i == j or random.random() < 0.12]
    for m in (g.part_adjacency(spark, sf_dir), SparseMatrix.of(entries(spark, wild), 40)):
        one, two = (factorize(m, 4, method=x).lu.select("row", "col", "val").toDF("row", "col", x) for x in ("blocks", "entries"))
        both = one.join(two, ["row", "col"]).collect()
        assert len(both) == m.entries.count() and all(r["blocks"] == pytest.approx(r["entries"], rel=1e-7, abs=1e-9) for r in both)


def test_entries_of_odd_matrices(spark):
    m = SparseMatrix.of(entries(spark, [(0, 0, 0.0), (1, 0, 1.0), (1, 1, 2.0)]), 2)
    assert factorize(m, method="entries").skipped == 1
    pivots = factorize(g.laplacian(spark, (5,)), 1, method="entries").pivots().orderBy("id").collect()
    assert [r["pivot"] for r in pivots] == pytest.approx([1, 1, 1, 1, 0])
    m = SparseMatrix.of(entries(spark, [(0, 0, 2.0), (1, 0, 1.0)]), 2)
    fact = factorize(m, missing_diag="one", method="entries")
    b = spark.createDataFrame([(0, 4.0), (1, 3.0)], "id long, x double")
    assert [r["x"] for r in fact.solve(b).orderBy("id").collect()] == [2.0, 1.0]


def test_wedges_are_those_of_the_pattern(spark):
    random = np.random.default_rng(2)
    place = {(int(i), int(j)) for i, j in random.integers(0, 25, (160, 2))} | {(i, i) for i in range(25)}
    found = fixed_point.masked_wedges(spark.createDataFrame(sorted(place), "row long, col long")).collect()
    want = {(i, j, k) for i, j in place for k in range(min(i, j)) if (i, k) in place and (k, j) in place}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_a_dense_column_makes_no_pairs(spark):
    """A row and column of 3,000 entries have 9,000,000 pairs; their only wedges end on the diagonal."""
    star = spark.range(1, 3000).selectExpr("explode(array(struct(0L as row, id as col), struct(id as row, 0L as col), struct(id as row, id as col))) as e").select("e.*")
    wedges = fixed_point.masked_wedges(star.union(spark.range(1).selectExpr("id as row", "id as col")))
    assert wedges.count() == 2999


@pytest.mark.parametrize("by", ["maps", "closure", "rounds"])
def test_solves_by_maps_and_rounds(spark, sf_dir, by, monkeypatch):
    monkeypatch.setattr(substitution, "LEAST_ROWS", 16)
    monkeypatch.setattr(substitution, "CLOSED", 4000 if by == "closure" else 0)
    m = g.part_adjacency(spark, sf_dir)
    fact = factorize(m, 4)
    lu = np.zeros((m.n, m.n))
    for r in fact.lu.collect():
        lu[r["row"], r["col"]] = r["val"]
    x = np.random.default_rng(4).normal(size=m.n)
    for upper in (False, True):
        t = np.triu(lu) if upper else np.tril(lu, -1) + np.eye(m.n)
        right = spark.createDataFrame(list(enumerate((t @ x).tolist())), "id long, x double")
        plan = substitution.triangle(fact.lu, fact.perm, m.n, 4, upper, "raise", fact.folder, "rounds" if by == "rounds" else "maps")
        assert bool(plan.maps) == (by == "maps") and bool(plan.rounds) == (by == "rounds") and (plan.closure is not None) == (by == "closure")
        assert [r["x"] for r in plan.solve(right)[0].orderBy("id").collect()] == pytest.approx(x.tolist(), abs=1e-8)


def test_a_chain_of_64_blocks_takes_as_many_maps_as_64_has_digits(spark, monkeypatch):
    monkeypatch.setattr(substitution, "CLOSED", 0)
    n = 256
    fact = factorize(g.banded(spark, n, 4), 64, method="entries")
    assert verify.round_trip_error(fact, g.test_vector(spark, n)) < 1e-9
    assert all(5 <= len(fact._plans[u].maps) <= 6 for u in (False, True))
    rounds = substitution.triangle(fact.lu, fact.perm, n, 64, True, "raise", fact.folder, "rounds").rounds
    assert len(rounds) >= 64


def test_rounds_found_in_spark(spark, monkeypatch):
    m = g.laplacian(spark, (30,), diag_shift=0.5)
    fact = factorize(m, 5)
    monkeypatch.setattr(substitution, "DRIVER_PAIRS", 1)
    plan = substitution.triangle(fact.lu, fact.perm, 30, 5, False, "raise", fact.folder, "rounds")
    x = g.test_vector(spark, 30)
    want = substitution.triangle(fact.lu, fact.perm, 30, 5, False, "raise", fact.folder, "maps").solve(x)[0]
    assert [r["x"] for r in plan.solve(x)[0].orderBy("id").collect()] == pytest.approx([r["x"] for r in want.orderBy("id").collect()])


@pytest.mark.parametrize("p", [4])
def test_the_slowest_block_shows(spark, p):
    """One of four blocks is dense, the others are diagonal."""
    n = 600
    dense_block = [(i, j, 400.0 if i == j else 1.0) for i in range(150, 300) for j in range(150, 300)]
    m = SparseMatrix.of(entries(spark, dense_block + [(i, i, 2.0) for i in range(n) if not 150 <= i < 300]), n)
    fact = factorize(m, p)
    fact.solve(g.test_vector(spark, n)).count()
    for call in ("factorize", "solve"):
        took = {}
        for r in fact.seconds(call).collect():
            took[r["unit"]] = took.get(r["unit"], 0.0) + r["seconds"]
        assert len(took) == p or call == "solve"
        assert fact.slowest(call) == pytest.approx(max(took.values()))
        if call == "factorize":
            assert max(took, key=took.get) == 1 and took[1] > 3 * max(t for u, t in took.items() if u != 1)
    assert fact.slowest("multiply") is None
