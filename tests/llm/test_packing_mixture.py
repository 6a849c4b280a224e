"""Packing against deficit round-robin served one round after another, and its mixture."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing, registry

SCHEMA = "doc_id long, text string, source string"
SMALL = "/root/testdata/sf0.001"


def placed(spark, docs, **options):
    pieces = packing.pack(docs, registry.tokenizer_path(), with_ids=False, **options).toPandas()
    pieces["at"] = pieces.sequence_id * options.get("length", packing.LENGTH) + pieces.offset
    by_place = pieces.sort_values("at")
    assert (by_place["at"] == by_place.length.cumsum() - by_place.length).all()  # each place once, none free
    for _, p in pieces.sort_values("start").groupby("doc_id"):
        assert (p.start == p.length.cumsum() - p.length).all() and p.length.sum() == p.doc_tokens.iloc[0]
        assert (p["at"].diff().dropna() > 0).all()  # in order
    return pieces


def plain(spark, docs, targets, temper, unit, length):
    """(doc_id, start, ids, place) of all units, by serving round after round with carried credits."""
    encode = Tokenizer.from_file(registry.tokenizer_path()).encode
    queues, waits = defaultdict(list), {}
    hashed = docs.withColumn("h", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(1 << 20)) / float(1 << 20))
    for r in sorted(hashed.collect(), key=lambda r: r.doc_id):
        n = len(encode(r.text or "", add_special_tokens=False).ids) + 1
        queues[r.source or ""] += [(r.doc_id, s, min(unit, n - s)) for s in range(0, n, unit)]
        waits[r.source or ""] = r.h
    size = {s: sum(u[2] for u in q) for s, q in queues.items()}
    groups = [[s for s in queues if targets.get(s)], [s for s in queues if not targets.get(s)]] if targets else [list(queues)]
    out, at = [], 0
    for k, group in enumerate(g for g in groups if g):
        weight = {s: (targets or {}).get(s) or float(size[s]) ** (1.0 if targets else temper) for s in group}
        credit, owed = dict.fromkeys(group, 0.0), {s: list(queues[s]) for s in group}
        while any(owed.values()):
            for s in sorted(group):
                credit[s] += weight[s] / sum(weight.values()) * length
                while owed[s] and credit[s] > waits[s] * owed[s][0][2] + 1e-6:
                    doc, start, n = owed[s].pop(0)
                    out.append((doc, start, n, at))
                    credit[s] -= n
                    at += n
    return out


@pytest.mark.parametrize("options", [{}, {"temper": 0.5, "unit_ids": 100}, {"targets": {"a": 3.0, "b": 1.0, "absent": 9.0}, "length": 256}, {"targets": {"a": 1.0, "c": 0.0}}])
def test_placement_is_deficit_round_robin(spark, options):
    r = np.random.default_rng(1)
    text = lambda: " ".join("abcdefgh"[x] for x in r.integers(0, 8, int(r.choice([0, 3, 40, 300, 1500]))))
    rows = [(i, text() or None, [None, "a", "b", "a", "c", f"s{i}"][i % 6]) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = placed(spark, docs, **options)
    length = options.get("length", packing.LENGTH)
    want = {}
    for doc, start, n, at in plain(spark, docs, options.get("targets"), options.get("temper", 1.0), options.get("unit_ids", packing.UNIT_IDS), length):
        want |= {(doc, start + i): at + i for i in range(n)}
    found = {(p.doc_id, p.start + i): p.at + i for p in got.itertuples() for i in range(p.length)}
    assert found == want


def test_mixture_of_the_small_table(spark):
    """Shares of every 16 windows, as long as all sources last, and how many short documents are cut."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    pieces = placed(spark, docs, temper=registry.MIXTURE).merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    size = pieces.groupby("source").length.sum()
    share = size**registry.MIXTURE / (size**registry.MIXTURE).sum()
    last = pieces.groupby("source")["at"].max().min() // packing.LENGTH // 16 * 16
    some = pieces[pieces.sequence_id < last]
    each = some.groupby([some.sequence_id // 16, "source"]).length.sum().unstack(fill_value=0) / (16 * packing.LENGTH)
    assert last >= 32 and (each - share).abs().max().max() < 0.05
    short = pieces[pieces.doc_tokens <= packing.UNIT_IDS].groupby("doc_id").size()
    assert (short > 1).mean() < 0.3


@pytest.mark.parametrize("hot", [0, 300])
def test_many_small_sources(spark, hot):
    r = np.random.default_rng(3)
    rows = [(i, " ".join("abcdefgh"[x] for x in r.integers(0, 8, int(r.choice([20, 40, 70, 300])))), f"s{i % 2000:04}") for i in range(2500)]
    rows += [(10_000 + i, "a b c d e f g h " * 125, "hot") for i in range(hot)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = placed(spark, docs).merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    windows = pieces.sequence_id.max() // 8 * 8
    some = pieces[pieces.sequence_id < windows]
    small = some[some.source != "hot"].groupby(some.sequence_id // 8).length.sum() / (8 * packing.LENGTH)
    assert windows >= 40 and (small - pieces[pieces.source != "hot"].length.sum() / pieces.length.sum()).abs().max() < 0.12
    assert packing.pack(docs.limit(0), registry.tokenizer_path()).count() == 0


def test_targets_must_be_weights(spark):
    for targets in ({}, {"a": -1.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, "a", "a")], SCHEMA), registry.tokenizer_path(), targets=targets)
