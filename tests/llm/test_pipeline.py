"""The pipeline's stages against plain versions, and registered SQL against Spark."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import quality, registry, simhash

from test_near_copies import plain_kept

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        from gridloom.llm.common import written

        results.append((docs, docs := written(stage(spark, docs, SMALL), "stage")))
    for before, after in results[:-1]:
        assert after.columns == columns and set(r.doc_id for r in after.collect()) <= set(r.doc_id for r in before.collect())
    kept = {r.doc_id for r in quality.judge(results[0][0], spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in results[0][1].collect()} == kept
    before, after = results[1]
    seen = set()
    want = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        lines, gone = r.text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        if len(gone) < len(lines):
            want[r.doc_id] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = results[2]
    rows = [(r.doc_id, r.text) for r in sorted(before.collect(), key=lambda r: r.doc_id)]
    _, root = plain_kept(rows)
    assert {r.doc_id for r in after.collect()} == {rows[x][0] for x in root} and len(set(root)) < len(rows)
    before, after = results[3]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before.collect() if not any(i and 5 * len(i & shingles(r.text)) >= 4 * len(i) for i in items)}
    assert {r.doc_id for r in after.collect()} == clean
    before, pieces = results[4]
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}
    assert Counter(map(repr, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(repr, pieces.collect()))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype({c: "float64" for c in f.columns if f[c].dtype.kind in "iuf"}).astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == rows(con.sql(registry.SQL[name]).df())


def test_sharding_follows_growth(spark):
    rows = registry.QUERIES["op7_sharding"](spark, SMALL).toPandas()
    assert (rows.law == "key").all() and ((rows.grown_shard == rows.shard) | (rows.grown_shard == 8)).all()


def test_simhash_prints(spark):
    rows = registry.QUERIES["op8_simhash"](spark, SMALL).toPandas()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(int(f, 16) == simhash.fingerprint(text[i]) for i, f in zip(rows.doc_id, rows.fingerprint))
    assert np.all(rows.component_id <= rows.doc_id)
