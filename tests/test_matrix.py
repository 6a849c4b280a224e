import numpy as np
import pytest

from gridloom.operators import blocks
from gridloom.operators.matrix import SparseMatrix, exact_sums
from gridloom.sources import generators as g
from gridloom.sources.mtx import read_mtx, write_mtx


def dense(m):
    a = np.zeros((m.n, m.n))
    for r in m.entries.collect():
        a[r["row"], r["col"]] += r["val"]
    return a


def entries(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, val double")


def grid(shape, periodic=False, shift=0.0, order=None, weights=None):
    order, weights = order or range(len(shape)), weights or [1.0] * len(shape)
    stride, run = [0] * len(shape), 1
    for ax in reversed(list(order)):
        stride[ax], run = run, run * shape[ax]
    a = np.zeros((run, run))
    for at in np.ndindex(*shape):
        i = int(np.dot(at, stride))
        a[i, i] += shift
        for ax, size in enumerate(shape):
            for d in (-1, 1):
                to = list(at)
                to[ax] += d
                if periodic:
                    to[ax] %= size
                if 0 <= to[ax] < size:
                    a[i, i] += weights[ax]
                    a[i, int(np.dot(to, stride))] -= weights[ax]
    return a


@pytest.mark.parametrize("kw", [dict(shape=(4, 4), diag_shift=0.1), dict(shape=(3, 4, 2)), dict(shape=(2, 3), periodic=True), dict(shape=(3, 4), axis_order=(1, 0), anisotropy=(1.0, 2.5)), dict(shape=(5,))])
def test_laplacian(spark, kw):
    want = grid(kw["shape"], kw.get("periodic", False), kw.get("diag_shift", 0.0), kw.get("axis_order"), kw.get("anisotropy"))
    assert np.allclose(dense(g.laplacian(spark, **kw)), want)


def test_laplacian_counts(spark):
    assert g.laplacian(spark, (20, 30)).entries.count() == 600 + 2 * (600 - 20) + 2 * (600 - 30)


def test_banded(spark):
    m = g.banded(spark, 16, 4)
    assert m.entries.count() == g.banded_nnz(16, g.offsets((1, 2), 4)) == 98
    assert g.offsets((1, 2, 0), 2) == [-2, -1, 1, 2]
    a = dense(m)
    assert a[3, 3] == pytest.approx(6.1) and a[3, 7] == -1 and a[3, 6] == 0
    with pytest.raises(ValueError):
        g.banded(spark, 4, 4)


def test_random_dominant_is_dominant_and_repeatable(spark):
    a, b = dense(g.random_dominant(spark, 40, 0.1, 3)), dense(g.random_dominant(spark, 40, 0.1, 3))
    assert np.array_equal(a, b)
    off = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    assert (np.abs(np.diag(a)) > off - 1e-9).all() and 40 < (a != 0).sum() < 40 + 240


def test_products_and_parts(spark):
    m = g.random_dominant(spark, 30, 0.1, 1)
    a, x = dense(m), g.test_vector(spark, 30)
    v = np.zeros(30)
    for r in x.collect():
        v[r["id"]] = r["x"]
    assert sorted(v) == list(range(30))
    for got, want in ((m.times(x), a @ v), (m.times(x, ordered=True), a @ v), (m.transpose().times(x), a.T @ v)):
        assert np.allclose([r["x"] for r in got.orderBy("id").collect()], want)
    assert m.lower().count() == np.count_nonzero(np.tril(a, -1))
    assert [r["first"] for r in m.row_pointers().orderBy("row").collect()] == [0, *np.cumsum((a != 0).sum(axis=1))[:-1]]


def test_bad_entries(spark):
    for rows in ([(0, 5, 1.0)], [(0, 0, float("nan"))], [(0, None, 1.0)]):
        with pytest.raises(ValueError):
            SparseMatrix.of(entries(spark, rows), 2)
    twice = entries(spark, [(0, 0, 1.0), (0, 0, 2.0)])
    assert SparseMatrix.of(twice, 1).entries.collect()[0]["val"] == 3.0
    with pytest.raises(ValueError):
        SparseMatrix.of(twice, 1, duplicates="error")


def test_matrix_market(spark, tmp_path):
    m = g.random_dominant(spark, 12, 0.2, 5)
    write_mtx(m, str(tmp_path / "m"))
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0].startswith("%%MatrixMarket") and lines[1].split()[0] == "12"
    assert np.array_equal(dense(read_mtx(spark, str(tmp_path / "m"))), dense(m))
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% x\n2 2 2\n1 1 3\n% y\n2 1 4.5\n")
    assert dense(read_mtx(spark, str(tmp_path / "s.mtx"))).tolist() == [[3, 4.5], [4.5, 0]]
    (tmp_path / "one.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n1 1 1\n1 1 1\n")
    assert dense(read_mtx(spark, str(tmp_path / "one.mtx"))).tolist() == [[1]]
    for text in ("%%MatrixMarket matrix array real general\n1 1\n3\n", "2 3 1\n1 1 1\n", "2 2 2\n1 1 1\n"):
        (tmp_path / "bad.mtx").write_text(text)
        with pytest.raises(ValueError):
            read_mtx(spark, str(tmp_path / "bad.mtx"))


def test_files_of_many_parts(spark, tmp_path):
    """The part with the size line is the smallest, so that Spark reads it last."""
    path = tmp_path / "many.mtx"
    path.mkdir()
    n, rows = 300, [(i, i, 1.5 + i) for i in range(300)] + [(i, 0, -1.0) for i in range(1, 300)]
    lines = [f"{r + 1} {c + 1} {v!r}" for r, c, v in rows]
    (path / "part-00000.txt").write_text(f"%%MatrixMarket matrix coordinate real general\n% a comment\n{n} {n} {len(rows)}\n{lines[0]}\n")
    for k in range(3):
        (path / f"part-0000{k + 1}.txt").write_text("\n".join(lines[1 + k :: 3]) + "\n% more\n")
    assert np.array_equal(dense(read_mtx(spark, str(path))), dense(SparseMatrix(entries(spark, rows), n)))
    m = g.random_dominant(spark, 3000, 0.002, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    write_mtx(m, str(tmp_path / "own.mtx"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    back = read_mtx(spark, str(tmp_path / "own.mtx"))
    assert back.entries.join(m.entries, ["row", "col", "val"]).count() == m.entries.count() == back.entries.count()
    (tmp_path / "bad.mtx").write_text("2 2 2\n1 1 1\n3 1 1\n")
    with pytest.raises(ValueError):
        read_mtx(spark, str(tmp_path / "bad.mtx"))


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from gridloom.sources.shared import shared_dir

    conf = SimpleNamespace(get=lambda k, d: d)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


@pytest.mark.parametrize("n,count", [(1, 1), (7, 49), (10, 37), (300, 2400)])
def test_random_cells_are_as_many_as_asked_and_different(spark, n, count):
    found = [tuple(r) for r in g.random_cells(spark, n, count, 5).collect()]
    assert len(found) == len(set(found)) == count and all(0 <= x < n for c in found for x in c)
    assert set(found) == {tuple(r) for r in g.random_cells(spark, n, count, 5).repartition(7).collect()}
    if count == 2400:  # spread over rows and columns alike, and otherwise for another seed
        rows = np.bincount([r for r, _ in found], minlength=n)
        assert 3 < rows.var() < 14 and len({r // 30 * 10 + c // 30 for r, c in found}) == 100
        assert len(set(found) & {tuple(r) for r in g.random_cells(spark, n, count, 6).collect()}) < 200
    with pytest.raises(ValueError):
        g.random_cells(spark, n, n * n + 1)


def test_exact_sums_are_the_same_for_any_dealing(spark):
    from math import fsum

    random = np.random.default_rng(9)
    rows = [(int(k), float(x)) for k, x in zip(random.integers(0, 5, 4000), random.normal(size=4000) * 10.0 ** random.integers(-30, 30, 4000), strict=True)]
    rows += [(7, 1e300), (7, 1.0), (7, -1e300), (8, 0.0), (9, 5e-324), (9, 5e-324), (10, float("inf")), (10, 1.0), (11, 0.1), (11, 0.2), (11, -0.3), (12, 1.7e308), (12, -1.7e308), (12, 3.0)]
    frame = spark.createDataFrame(rows, "k long, x double")
    got = [{r["k"]: r["x"] for r in exact_sums(frame.repartition(p), "k", "x").collect()} for p in (1, 8, 200)]
    assert got[0] == got[1] == got[2]
    for k in (*range(5), 7, 8, 9, 11, 12):
        assert got[0][k] == pytest.approx(fsum(x for i, x in rows if i == k), rel=1e-15, abs=0)
    assert got[0][10] == float("inf")


def test_ordered_products_are_bit_equal(spark):
    m = g.random_dominant(spark, 60, 0.4, 3)
    x = g.test_vector(spark, 60, "uniform")
    one, two = ({r["id"]: r["x"] for r in SparseMatrix(m.entries.repartition(p), 60).times(x, ordered=True).collect()} for p in (1, 50))
    assert one == two and len(one) == 60


def test_closure_goes_from_piece_to_piece(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CLOSURE_ROWS", 3)
    # one block begins at row 12; row 12 refers before it, and each later row to the one two before
    e = [(i, i, 4.0) for i in range(24)] + [(12, 3, 1.0)] + [(i, i - 2, 1.0) for i in range(14, 24)] + [(5, 4, 1.0)]
    m = SparseMatrix.of(entries(spark, e), 24)
    found = {r["row"] for r in blocks.classify(m, 2, "closure").where("is_sep").collect()}
    assert found == set(range(12, 24, 2))
    assert blocks.classify(m, 1, "closure").where("is_sep").count() == 0


def test_banded_files_are_counted(spark, tmp_path):
    g.write_banded(spark, str(tmp_path / "band.mtx"), 40, 7)
    assert spark.read.format("mtx").load(str(tmp_path / "band.mtx")).count() == g.banded_nnz(40, g.offsets((1, 2), 7))
