import pytest

from gridloom import cli
from gridloom.plans import logs, runs
from gridloom.sources import generators as g
from gridloom.sources.mtx import read_mtx, write_mtx


def test_perf_feeds_reports(spark):
    rows = runs.perf(spark, "grid.mtx", g.laplacian(spark, (4, 4), diag_shift=0.1), (1, 2), reps=2)
    summary = logs.summary(rows.withColumn("line_no", rows["workers"]))
    found = {(r["phase"], r["workers"]): r for r in logs.speedup(summary).collect()}
    assert len(found) == 6 and found["solve", 2]["n_repeats"] == 2 and found["factorize", 1]["speedup"] == 1.0
    assert found["multiply", 1]["nnz"] == 64
    slowest = {(r["phase"], r["workers"]): r["slowest_s"] for r in rows.collect()}
    assert slowest["multiply", 1] is None and all(0 < slowest[x, p] < 60 for x in ("factorize", "solve") for p in (1, 2))


def test_checks_and_cli(spark, tmp_path, capsys):
    m = g.banded(spark, 30, 7)
    assert all(r["passed"] for r in runs.correctness(spark, "band", m, (1, 3), trials=1).collect())
    write_mtx(m, str(tmp_path / "band.mtx"))
    assert cli.main(["matrix", str(tmp_path / "band.mtx"), "--mode", "correctness,perf", "--trials", "1", "--perf-reps", "1"]) == 0
    said = capsys.readouterr().out
    assert "reconstruct" in said and "factorize" in said and "OVERALL: PASSED" in said
    with pytest.raises(SystemExit):
        cli.main(["matrix", str(tmp_path / "band.mtx"), "--mode", "nothing"])


def test_log_cli(spark, tmp_path, capsys):
    (tmp_path / "a.out").write_text("WORKERS=2\n>> RUNNING_MATRIX=band_m4.mtx\nPERF,phase=solve,N=9,P=2,time=0.5\n")
    assert cli.main(["logs", str(tmp_path), "--md", "--by-matrix", "--csv", str(tmp_path / "csv")]) == 0
    said = capsys.readouterr().out
    assert "0.5000 ~1" in said and "no PASSED line seen" in said
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_results_table_and_sweeps_that_go_on(spark, tmp_path):
    rows = runs.offset_sweep(spark, 20, (4, 5), (1,), reps=1)
    runs.append(rows, str(tmp_path / "results"))
    kept = spark.read.parquet(str(tmp_path / "results"))
    more = runs.offset_sweep(spark, 20, (4, 5, 6), (1,), reps=1, results=kept)
    assert {r["matrix"] for r in more.collect()} == {"band_n20_m6.mtx"}
    runs.append(more, str(tmp_path / "results"))
    both = spark.read.parquet(str(tmp_path / "results"))
    found = logs.repetitions(both).collect()
    assert len(found) == 9 and all(r["n_samples"] == 1 and r["mean_time_s"] == r["slowest_time_s"] for r in found)
    assert runs.offset_sweep(spark, 20, (4,), (1,), results=both).count() == 0


def test_generator_and_summary_commands(spark, tmp_path, capsys):
    out = lambda x: str(tmp_path / x)
    assert cli.main(["laplacian", out("grid"), "--shape", "4", "5", "--shift", "0.1", "--order", "1", "0"]) == 0
    assert cli.main(["banded", out("band"), "--n", "30", "--m", "7"]) == 0
    assert cli.main(["random", out("drawn"), "--n", "20", "--density", "0.1"]) == 0
    sizes = [read_mtx(spark, out(x)).entries.count() for x in ("grid", "band", "drawn")]
    assert sizes[:2] == [20 + 2 * (15 + 16), g.banded_nnz(30, g.offsets((1, 2), 7))] and 20 <= sizes[2] <= 60
    (tmp_path / "a.out").write_text(">> RUNNING_MATRIX=x.mtx\nPERF,phase=solve,N=9,P=2,time=0.5\nWorkers (MPI Ranks): 2\nRUNTIME_RECONSTRUCT_10_0.1=2\nRUNTIME_VECTOR_10_0.1=1\n")
    assert cli.main(["strict", out("a.out")]) == 0 and cli.main(["runtimes", out("a.out"), "--csv", out("csv")]) == 0
    said = capsys.readouterr().out
    assert "0.500000" in said and "3.0" in said
