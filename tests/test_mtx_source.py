import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources import generators as g
from gridloom.sources.mtx import read_mtx, write_mtx
from gridloom.sources.mtx_source import head, register


@pytest.fixture(autouse=True)
def format_(spark):
    register(spark)


def rows(df):
    return sorted(map(tuple, df.select("row", "col", "val").collect()))


def test_several_parts_and_small_ranges(spark, tmp_path):
    m = g.banded(spark, 400, 7)
    path = str(tmp_path / "band.mtx")
    write_mtx(m, path)
    want = rows(m.entries)
    for bytes_ in (64, 1000, 1 << 25):  # ranges that cut lines anywhere
        found = spark.read.format("mtx").option("rangeBytes", bytes_).load(path)
        assert rows(found) == want
    assert head(path).n == 400 and head(path).entries == len(want)


def test_one_file_with_comments(spark, tmp_path):
    file = tmp_path / "a.mtx"
    file.write_text("%%MatrixMarket matrix coordinate real symmetric\n% said\n\n3 3 4\n1 1 1\n% between\n2  1   -2.5\n3 3 1e3\r\n3 2 4")
    want = [(0, 0, 1.0), (0, 1, -2.5), (1, 0, -2.5), (1, 2, 4.0), (2, 1, 4.0), (2, 2, 1000.0)]
    for bytes_ in (1, 7, 1000):
        assert rows(spark.read.format("mtx").option("rangeBytes", bytes_).load(f"file://{file}")) == want
    file.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 2\n")
    assert rows(spark.read.format("mtx").load(str(file))) == [(0, 1, 1.0), (1, 1, 1.0)]
    file.write_text("2 2 0\n")
    assert rows(spark.read.format("mtx").load(str(file))) == []


@pytest.mark.parametrize("text", ["%%MatrixMarket matrix array real general\n2 2\n1\n", "2 3 1\n1 1 1\n", "% only\n", "2 2 1\n3 1 1\n", "2 2 1\n1 1\n", "2 2 1\n1 1 nan\n"])
def test_wrong_files(spark, tmp_path, text):
    (tmp_path / "a.mtx").write_text(text)
    with pytest.raises(Exception, match="coordinate|square|size line|outside|fields|finite"):
        spark.read.format("mtx").load(str(tmp_path / "a.mtx")).collect()


def test_bounds_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "band.mtx")
    m = g.banded(spark, 100, 7)
    write_mtx(m, path)
    for bound in ("row >= 20 and row < 30", "row = 5", "col > 90 and val < 0", "row > 7 and row < 7", "col <= 3 and row >= 2", "row in (4, 9)"):
        found = spark.read.format("mtx").load(path).where(bound)
        assert rows(found) == rows(m.entries.where(bound))
    scanned = spark.read.format("mtx").load(path).where("row >= 20 and row < 30")
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan mtx" in plan


def test_write_and_read(spark, tmp_path):
    m = g.laplacian(spark, (9, 9), diag_shift=0.1)
    path = str(tmp_path / "grid.mtx")
    n = m.entries.count()
    m.entries.repartition(5).write.format("mtx").option("n", 81).option("entries", n).mode("append").save(path)
    assert rows(spark.read.format("mtx").load(path)) == rows(m.entries) == rows(read_mtx(spark, path).entries)
    assert sorted(os.listdir(path))[0] == "part-00000" and len(os.listdir(path)) == 6
    with pytest.raises(Exception, match="has files"):
        m.entries.write.format("mtx").option("n", 81).mode("append").save(path)
    two = m.entries.withColumn("val", F.col("val") * 2)
    two.coalesce(1).write.format("mtx").option("n", 81).mode("overwrite").save(path)
    assert rows(spark.read.format("mtx").load(path)) == rows(two) and len(os.listdir(path)) == 2


def test_a_wrong_count_aborts_the_commit(spark, tmp_path):
    m = g.banded(spark, 50, 7)
    path = str(tmp_path / "band.mtx")
    due = g.banded_nnz(50, g.offsets((1, 2), 7))
    m.entries.write.format("mtx").option("n", 50).option("entries", due).mode("append").save(path)
    before = rows(spark.read.format("mtx").load(path))
    with pytest.raises(Exception, match="are due"):
        m.entries.where("row > 0").write.format("mtx").option("n", 50).option("entries", due).mode("overwrite").save(path)
    assert rows(spark.read.format("mtx").load(path)) == before and not [x for x in os.listdir(path) if x.startswith("_")]
    with pytest.raises(Exception, match="null or outside"):
        m.entries.write.format("mtx").option("n", 49).mode("overwrite").save(path)
    assert rows(spark.read.format("mtx").load(path)) == before
