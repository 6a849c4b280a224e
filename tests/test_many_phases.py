"""The speedup queries over more event types than any fixed number."""

import datetime

from gridloom.queries import QUERIES


def test_every_event_type_has_a_speedup(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(u * 1000 + k, at + datetime.timedelta(seconds=k), u, "view" if k == 0 else f"kind{k}", float(k + u)) for u in (4, 5) for k in range(101)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("speedup", "efficiency"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.phase for r in got} == {f"kind{k}" for k in range(1, 101)} and len(got) == 200
