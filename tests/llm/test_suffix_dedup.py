"""Substring dedup against brute force: removed bytes, passages, the sort and the splits of frequent minimizers."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import registry, suffix_dedup

from test_operators import CLASHES, SMALL, bag, none, odd, texts  # noqa: F401

WHITE = b" \t\n\v\f\r"


def merged(runs):
    out = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def passage(t, p):
    """The string from p to the end of the 50th word that it touches."""
    ends = (i for i in range(p + 1, len(t) + 1) if t[i - 1] not in WHITE and (i == len(t) or t[i] in WHITE))
    last = next((e for k, e in enumerate(ends, 1) if k == suffix_dedup.PASSAGE_WORDS), p + suffix_dedup.LENGTH)
    return min(max(last - p, suffix_dedup.WINDOW), suffix_dedup.LENGTH)


def plain(rows, with_passages=True):
    length, window = suffix_dedup.LENGTH, suffix_dedup.WINDOW
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    near = {}
    for k, (_, t) in enumerate(rows):
        for i in range(len(t) - window + 1) if with_passages else ():
            near.setdefault(t[i : i + window], []).append((k, i))
    for k, (i, t) in enumerate(rows):
        gone = merged((p, p + length) for p in range(len(t) - length + 1) if count[t[p : p + length]] > 1)
        shared = []
        for p in range(len(t) - window + 1) if with_passages else ():
            if len(same := near[t[p : p + window]]) > 1:
                r = passage(t, p)
                if p + r <= len(t) and any((j, q) != (k, p) and rows[j][1][q : q + r] == t[p : p + r] for j, q in same):
                    shared.append((p, p + r))
        shared = merged(shared)
        edges = [0, *(x for g in gone for x in g), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
        row = (i, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
        yield (*row, len(shared), sum(b - a for a, b in shared), gone, shared, kept) if with_passages else (*row, gone, kept)


def got(df):
    return bag((*r[:-1], bytes(r.kept)) for r in df.collect())


def test_odd_documents(odd, none):  # noqa: F811
    found = suffix_dedup.dedup_substrings(odd)
    assert bag((*r[:5], r.spans, bytes(r.kept)) for r in found.collect()) == bag(plain([(i, t.encode()) for i, t in texts()], False))
    assert suffix_dedup.dedup_substrings(none).count() == 0


def surroundings(seed, n):
    """A passage of 60 words and one of 500 bytes in n different surroundings each, copies, and short words."""
    r = np.random.default_rng(seed)
    words = lambda k: " ".join("".join(map(chr, r.integers(97, 123, int(r.integers(2, 9))))) for _ in range(k))
    some, long = words(60), words(100)
    rows = [f"{words(int(r.integers(1, 40)))} {x}{words(int(r.integers(1, 40)))}" for x in [some + " ", long + "\n"] * n]
    return [*rows, rows[0], some, long + " " + long, "of " * 300, words(30) + " " + "of " * 200, "z" * 900, "é" * 300]


@pytest.mark.parametrize("group_classes", [suffix_dedup.GROUP_CLASSES, 3, 1])
def test_passages_and_frequent_minimizers(spark, group_classes):
    rows = list(enumerate(surroundings(2, 25)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.dedup_substrings(docs, group_classes=group_classes)
    want = list(plain([(i, t.encode()) for i, t in rows]))
    assert got(found) == bag(want) and all(w[5] for w in want[:52]) and sum(not w[2] for w in want) > 10


def test_small_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(registry.QUERIES["op6_suffix_dedup"](spark, SMALL)) == bag(plain([(r.doc_id, (r.text or "").encode()) for r in docs.collect()]))


def test_text_longer_than_a_chunk(spark):
    r = np.random.default_rng(3)
    text = r.integers(97, 123, 2 * suffix_dedup.CHUNK_BYTES + 5000).astype(np.uint8).tobytes().decode()
    cut = suffix_dedup.CHUNK_BYTES
    rows = [(0, text), (1, text[cut - 450 : cut + 10] + "Q" * 5 + text[cut - 10 : cut + 395]), (2, text[2 * cut - 700 : 2 * cut + 700])]
    found = {x.doc_id: x.spans for x in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: [[cut - 450, cut + 395], [2 * cut - 700, 2 * cut + 700]], 1: [[0, 460], [465, 870]], 2: [[0, 1400]]}


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_sort(seed, monkeypatch):
    r = np.random.default_rng(seed)
    length, letters = int(r.integers(1, 14)), [b"a", b"ab ", b"\x00\xffab", b"cba"][seed % 4]
    window = int(r.integers(1, length + 1))
    for name, value in (("LENGTH", length), ("WINDOW", window), ("PASSAGE_WORDS", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    whole = [bytes(r.choice(list(letters), int(r.integers(length, 60))).tolist()) for _ in range(int(r.integers(1, 7)))]
    counts = r.integers(1, 3, len(whole)).tolist()
    each = [i for i, n in enumerate(counts) for _ in range(n)]
    want = dict(zip(each, plain([(i, whole[i]) for i in each])))
    found = suffix_dedup.repeats(whole, counts, [len(p) - window + 1 for p in whole])
    for i, (runs, passages) in enumerate(found):
        assert suffix_dedup.spans(np.array([0]), [runs]).tolist() == want[i][7] and suffix_dedup.spans(np.array([0]), [passages]).tolist() == want[i][8]
    text = np.frombuffer(b"\0".join([*whole, b""]), np.uint8).astype(np.int16) + 1
    text[np.cumsum([len(p) + 1 for p in whole]) - 1] = 0
    order = suffix_dedup.suffix_order(text, text > 0)
    ends = np.flatnonzero(text == 0)
    suffixes = [(text[i : ends[np.searchsorted(ends, i)]]).tolist() for i in order]
    assert suffixes == sorted(suffixes) and len(order) == (text > 0).sum()
    prefix = suffix_dedup.common_prefixes(b"\0".join([*whole, b""]), ends[np.searchsorted(ends, np.arange(len(text)))], order, 1, 1000)
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefix.tolist() == [0, *(same(a, b) for a, b in zip(suffixes, suffixes[1:]))]
