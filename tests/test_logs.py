import pytest

from gridloom.plans import logs
from gridloom.streaming.log_stream import running_means, sample_stream

LOG = """WORKERS=4
>> RUNNING_MATRIX=band_n100_m16.mtx
PERF,phase=factorize,N=100,nnz=600,P=4,time=0.300000
PERF,phase=solve,N=100,P=4,time=0.020000
PERF,phase=solve,N=100,P=4,time=0.040000
OVERALL: PASSED
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.out").write_text(LOG)
    (tmp_path / "b.out").write_text(LOG.replace("OVERALL: PASSED\n", "").replace("WORKERS=4", "WORKERS=8").replace("P=4", "P=8").replace("0.3", "0.1"))
    (tmp_path / "c.out").write_text(LOG.replace("WORKERS=4\n", ""))
    (tmp_path / "d.out").write_text("WORKERS=4\nCORRECTNESS FAILED for x.mtx\nPERF RUN TIMED OUT for y.mtx\n")
    return str(tmp_path)


def test_summary(spark, folder):
    rows = {(r["phase"], r["workers"]): r for r in logs.summary(logs.samples(logs.lines(spark, folder))).collect()}
    assert rows["factorize", 4]["median_time_s"] == 0.3 and rows["factorize", 4]["n_repeats"] == 1
    assert rows["solve", 4]["median_time_s"] == pytest.approx(0.03) and rows["solve", 4]["n_repeats"] == 2
    assert rows["solve", 4]["nnz"] == 600 and len(rows) == 4


def test_issues(spark, folder):
    found = {(r["file"], r["message"]) for r in logs.issues(logs.lines(spark, folder)).collect()}
    assert found == {("b.out", "no PASSED line seen"), ("c.out", "no WORKERS= line found"), ("d.out", "correctness failed: x.mtx"), ("d.out", "perf run timed out: y.mtx")}


def test_reports(spark, folder):
    rows = logs.summary(logs.samples(logs.lines(spark, folder)))
    gain = {(r["phase"], r["workers"]): r for r in logs.speedup(rows).collect()}
    assert gain["factorize", 8]["speedup"] == pytest.approx(3.0) and gain["factorize", 8]["efficiency"] == pytest.approx(1.5)
    assert gain["factorize", 8]["base_workers"] == 4
    wide = logs.by_matrix(rows).collect()
    assert wide[0]["label"] == "16" and wide[0]["factorize"] == "0.3000~1" and wide[0]["multiply"] == "-"
    table = logs.by_workers(rows, markdown=True)
    assert table.collect()[0]["solve_time"] == "0.0300 ~2"
    assert logs.text_table(table, markdown=True).startswith("| matrix | workers |")


def test_duplicates_keep_the_faster(spark, tmp_path):
    (tmp_path / "a.out").write_text(LOG)
    (tmp_path / "b.out").write_text(LOG.replace("0.300000", "0.500000").replace("PERF,phase=solve,N=100,P=4,time=0.020000\n", ""))
    lines = logs.lines(spark, str(tmp_path))
    rows = {r["phase"]: r for r in logs.summary(logs.samples(lines)).collect()}
    assert rows["factorize"]["median_time_s"] == 0.3 and rows["solve"]["n_repeats"] == 1
    assert sum("duplicate" in r["message"] for r in logs.issues(lines).collect()) == 2


def test_strict_and_csv(spark, folder, tmp_path):
    rows = logs.strict_summary(logs.lines(spark, folder))
    solve = [r for r in rows.collect() if r["phase"] == "solve" and r["ranks"] == 8]
    assert solve[0]["all_times"] == "0.020000;0.040000" and solve[0]["n_samples"] == 2
    logs.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows.count()


def test_runtimes(spark, tmp_path):
    (tmp_path / "r.out").write_text("Workers (MPI Ranks): 2\nRUNTIME_RECONSTRUCT_100_0.1=2.5\nnoise\nRUNTIME_VECTOR_100_0.1=0.5\nRUNTIME_VECTOR_100_0.1=0.5\nRUNTIME_RECONSTRUCT_10_0.1=1\nRUNTIME_VECTOR_100_0.1=1\n")
    found = logs.runtimes(logs.lines(spark, str(tmp_path)))
    assert [tuple(r) for r in found.collect()] == [(2, 100, 0.1, 3.0)]
    assert logs.runtime_summary(found).collect()[0]["completed_tests"] == 1


def test_stream(spark, folder):
    stream = running_means(sample_stream(spark, folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("log_means").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r["phase"], r["workers"]): r for r in spark.sql("SELECT * FROM log_means").collect()}
    assert rows["solve", 4]["n"] == 2 and rows["solve", 4]["mean_time_s"] == pytest.approx(0.03)
    assert rows["solve", 4]["matrix"] == "band_n100_m16.mtx"


@pytest.fixture()
def splits(spark):
    """Text in splits of 4 KB, segments of 16 lines."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_one_long_log_over_many_tasks(splits, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "SEGMENT_LINES", 16)
    text, want, matrix = [], [], "<unknown>"
    for i in range(3000):
        if i in (40, 41, 700, 2200):  # markers far apart: most segments have none
            matrix = f"band_m{i}.mtx"
            text.append(f">> RUNNING_MATRIX={matrix}")
        elif i == 2900:
            text.append("WORKERS=6")
        elif i % 3:
            text.append(f"PERF,phase=solve,N=9,P=6,time={i}.5" + "\r" * (i % 2))
            want.append((matrix, i + 0.5))
        else:
            text.append(f"noise {i}")
    (tmp_path / "a.out").write_text("\n".join(text) + "\n")
    read = logs.lines(splits, str(tmp_path))
    assert read.rdd.getNumPartitions() > 5
    rows = logs.samples(read).orderBy("line_no").collect()
    assert [(r["matrix"], r["time_s"]) for r in rows] == want and {r["workers"] for r in rows} == {6}
    assert read.select(logs._segment(read)).distinct().count() > 100
    by = {r["matrix"]: r["n_samples"] for r in logs.strict_summary(read).collect()}
    assert by == {m: sum(x == m for x, _ in want) for m in {x for x, _ in want} - {"<unknown>"}}


def test_runtimes_over_segments(splits, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "SEGMENT_LINES", 4)
    text = ["RUNTIME_RECONSTRUCT_10_0.1=9", "Workers (MPI Ranks): 3", "RUNTIME_VECTOR_10_0.1=1", "RUNTIME_RECONSTRUCT_10_0.1=2"] + ["noise"] * 600 + ["RUNTIME_VECTOR_10_0.1=1", "RUNTIME_RECONSTRUCT_10_0.1=4"] + ["noise"] * 900
    text += ["RUNTIME_VECTOR_20_0.1=1", "RUNTIME_VECTOR_10_0.1=1"]
    (tmp_path / "r.out").write_text("\n".join(text))
    assert [tuple(r) for r in logs.runtimes(logs.lines(splits, str(tmp_path))).collect()] == [(3, 10, 0.1, 3.0)]


def test_medians_of_a_hot_group(splits):
    """Nine tenths of the rows are one group, with many equal values, over many tasks."""
    import numpy as np

    from gridloom.functions.selection import medians

    random = np.random.default_rng(1)
    rows = [("hot" if i % 10 else f"g{i % 70}", float(x)) for i, x in enumerate(np.round(random.normal(size=30_000), 2))] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0)]
    frame = splits.createDataFrame(rows, "k string, x double").repartition(9)
    got = {r["k"]: (r["m"], r["n"]) for r in medians(frame, ["k"], "x", "m").collect()}
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    assert got == {k: (pytest.approx(float(np.median(v)), abs=1e-12), len(v)) for k, v in by.items()}
    assert medians(frame.limit(0), ["k"], "x").count() == 0
