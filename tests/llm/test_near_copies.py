"""The pipeline's near-duplicate stage against brute force over five-word Jaccard."""

import re

import numpy as np

from gridloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, _hash string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return len({find(i) for i in range(len(rows))}), [find(i) for i in range(len(rows))]


def changed(words, n, r):
    out = list(words)
    for i in np.linspace(3, len(words) - 3, n).astype(int):
        out[i] = f"new{r.integers(1 << 40)}"
    return " ".join(out)


def test_similarity_of_eight_tenths(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in r.integers(0, 5000, int(r.integers(60, 500)))]
        rows.append((len(rows), " ".join(words), "x"))
        rows += [(len(rows) + i, changed(words, n, r), "x") for i, n in enumerate(sorted({1, len(words) // 60, len(words) // 48, len(words) // 40, len(words) // 25}))]
    rows += [(len(rows) + i, t, "x") for i, t in enumerate([None, "", " ", "a b", "A  b", "a b c"])]
    count, root = plain_kept(rows)
    least = {rows[x][0] for x in root}
    got = [x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got) == sorted(least) and len(got) == count < len(rows) - 100


def test_large_group_and_odd_ones(spark):
    r = np.random.default_rng(11)
    words = [f"w{x}" for x in r.integers(0, 5000, 200)]
    rows = [(i, changed(words, 3 if i % 3 else 9, r), "x") for i in range(150)]
    count, root = plain_kept(rows)
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(x.doc_id for x in got.collect()) == sorted({rows[x][0] for x in root}) and 1 < count < 150


def test_shingles_hash_whole_words():
    assert len(near_copies.shingles("a b c d e f")) == 2 and len(near_copies.shingles(None)) == 0
    assert near_copies.shingles("A b\tc").tolist() == near_copies.shingles("a b c").tolist()


def test_documents_without_ids_or_with_one_id(spark):
    r = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 100)) for _ in range(20)]
    rows = [(None, t, "x") for t in texts[:8]] + [(5, t, "x") for t in texts[8:16]] + [(100 + i, t, "x") for i, t in enumerate(texts[16:])]
    again = [(None, texts[0], "x"), (5, texts[8], "x"), (None, texts[9], "x"), (7, texts[1], "x"), (5, changed(texts[16].split(), 1, r), "x"), (None, changed(texts[2].split(), 1, r), "x")]
    got = simhash.keep_one(spark.createDataFrame(rows + again, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "_hash"]
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert len(kept) == 20 and {i for i, t in kept if t == texts[1]} == {7} and {i for i, t in kept if t == texts[9]} == {5}
    assert (5, again[4][1]) in kept and len({t for _, t in kept}) == 20 and {x for _, x in kept if x in (texts[2], again[5][1])}


def test_agreeing_bytes(spark):
    r = np.random.default_rng(17)
    a = r.integers(0, 256, (50, near_copies.HASHES), np.uint8)
    b = np.where(r.random(a.shape) < 0.5, a, a ^ r.choice([1, 128, 255], a.shape).astype(np.uint8))
    rows = [(x.view(np.int64).tolist(), y.view(np.int64).tolist()) for x, y in zip(a, b)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_copies.agreeing("a", "b").alias("n")).collect()
    assert [x.n for x in got] == (a == b).sum(axis=1).tolist()
