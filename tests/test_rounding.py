"""Results that are rounded: exact inputs, exact halves, values that stand still to the last bit."""

import math

from gridloom.plans import logs
from gridloom.sources import generators as g


def test_wave_is_the_sine_of_exact_hundredths(spark):
    wanted = [157985, 293099, 327918]
    found = g.test_vector(spark, 400_000, "wave").where(f"id in {tuple(wanted)}").orderBy("id").collect()
    assert [round(r["x"] * 1e9) for r in found] == [round((1 + 0.5 * math.sin(i / 100)) * 1e9) for i in wanted]


def test_reports_round_as_c_does(spark):
    rows = [("a", 100, 0, "solve", w, t, 3) for w, t in ((1, 1.125), (2, 1.0), (4, 2.25), (8, 0.28125), (16, 0.00005))]
    summary = spark.createDataFrame(rows, "matrix string, n long, nnz long, phase string, workers int, median_time_s double, n_repeats long")
    found = {r["workers"]: r for r in logs.by_workers(summary, 1, ("solve",)).collect()}
    assert found[2]["solve_speedup"] == "1.12x" and found[2]["solve_eff"] == "56%"
    assert found[4]["solve_speedup"] == "0.50x" and found[4]["solve_eff"] == "12%"
    assert found[8]["solve_speedup"] == "4.00x" and found[8]["solve_eff"] == "50%"
    assert found[16]["solve_time"] == "%.4f" % 0.00005


def test_reports_divide_by_times_of_zero(spark, tmp_path):
    """Samples of 0 s at the baseline, at others and at both, against the SQL."""
    import duckdb

    import __spark_entry__ as entry

    kinds = ("click", "purchase", "signup")
    zero = {("click", 0), ("purchase", 1), ("signup", 0), ("signup", 1)}
    events = [(10 * u + k, u, kind, 0.0 if (kind, u) in zero else 0.5 + u) for u in range(4) for k, kind in enumerate(kinds) if (kind, u) != ("click", 3)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["report_by_workers"](spark, str(tmp_path))
    want = sql.execute(entry.oracle_sql()["report_by_workers"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
    assert {"infx", "-nanx", "0.00x"} <= {x for r in want for x in r if isinstance(x, str)}
