"""The pipeline's near-duplicate stage links by fingerprints, and the tables of known units."""

import numpy as np

from gridloom.llm import near_copies, simhash, tokens


def test_near_copies_that_no_band_brings_together_meet_by_fingerprint(spark, monkeypatch):
    """Without bands the stage finds what links by four bits, verified on whole sets."""
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 5000, 800)), "x") for i in range(12)]
    rows += [(20 + i, f"{t} and{i}", "x") for i, (_, t, _) in enumerate(rows[:6])]
    monkeypatch.setattr(near_copies, "bands", lambda least: r.integers(0, 1 << 62, (len(least), near_copies.BANDS)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string").coalesce(1)
    prints = {i: simhash.fingerprint(t) for i, t, _ in rows}
    linked = {i for i in range(6) if (prints[i] ^ prints[20 + i]).bit_count() <= 4}
    assert len(linked) >= 3
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == {i for i, *_ in rows} - {20 + i for i in linked}


def test_units_are_known_in_both_tables(monkeypatch):
    from gridloom.llm.registry import tokenizer_path

    monkeypatch.setattr(tokens, "LATE_UNITS", 50)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 200)
    r = np.random.default_rng(4)
    texts = [" ".join(f"unit{x}" for x in r.integers(0, 400, 30)) for _ in range(60)]
    coder = tokens.Encoder(tokenizer_path())
    want = [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    assert len(coder.early[0]) > 50 and np.all(np.diff(coder.early[0].astype(object)) > 0)
