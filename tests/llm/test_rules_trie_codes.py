"""The rule ensemble, the prefix trie and the vector codes against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import prefix_trie, rule_ensemble, vector_codes

SMALL = "/root/testdata/sf0.01"
CLASHES = ["node", "parent", "kids", "part", "place", "size", "said", "tie", "at", "h", "from", "taken", "label_error", "error", "code", "salt", "copy", "of", "words", "lines", "score", "x"]


def clash(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


def bag(rows):
    return Counter(map(repr, rows))


# ---- rule ensemble ----------------------------------------------------------------------


def auc(scores, good):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks = {}
    for i in range(len(order)):
        ranks.setdefault(scores[order[i]], []).append(i + 1)
    mean = {s: sum(r) / len(r) for s, r in ranks.items()}
    n = sum(good)
    return (sum(mean[s] for s, g in zip(scores, good, strict=True) if g) - n * (n + 1) / 2) / (n * (len(good) - n))


def test_held_out_accuracy(spark):
    docs, labels = (clash(spark.read.parquet(f"{SMALL}/{t}.parquet")) for t in ("documents", "labels"))
    found = rule_ensemble.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    kept = [r for r in found if r.held_out]
    assert auc([r.score for r in kept], [r.quality for r in kept]) > 0.97
    good = [r.predicted for r in kept if r.quality]
    assert sum(good) > 0.97 * len(good)
    assert sum(r.predicted == 0 for r in kept if not r.quality) > 0.8 * sum(1 - r.quality for r in kept)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 400")
    outside = rule_ensemble.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(outside, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (bag(rule_ensemble.classify(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert one == two


def test_statistics_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "AB, cd! cd|\n\nAB 12 é.\nAB 12 é."), (None, "x x x"), (5, "w" * 300_000 + " v")]
    found = {(r.doc_id, round(2**r.log_words) - 1): r for r in rule_ensemble.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows) and not any(v is None for r in found.values() for v in r[1:])
    assert all(not any(found[i, 0][1:]) for i in (1, 2, 3))
    r = found[5, 9]
    solid = len("AB,cd!cd|AB12é.AB12é.")
    assert r.word_length == solid / 9 and r.words_a_line == 3 and r.upper_share == 6 / solid and r.digit_share == 4 / solid
    assert r.bar_share == 1 / 9 and r.bang_share == 1 / 9 and r.stop_share == 2 / 9 and r.comma_share == 1 / 9 and r.wide_share == 2 / solid
    assert r.repeated_lines == 1 / 3 and r.repeated_words == 3 / 9 and r.stutters == 0
    assert found[None, 3].stutters == 2 / 3


def test_paths_weights_and_score_agree(spark):
    """The compiled score is the logistic of the weights of the rules that hold."""
    stats = rule_ensemble.statistics(spark.read.parquet(f"{SMALL}/documents.parquet")).limit(300).cache()
    model = rule_ensemble.fit(stats.withColumn("label", (F.col("symbol_share") + F.col("stutters") < 0.02).cast("double")), trees=4)
    assert model.weights and len(model.weights) <= 4 * 14
    for row in stats.withColumn("got", model.score()).collect():
        held = [w for r, w in model.weights.items() if all(lower < row[name] <= upper for name, lower, upper in r.bounds)]
        assert row.got == pytest.approx(1 / (1 + math.exp(-model.intercept - sum(held))))


def test_without_labels_or_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    assert rule_ensemble.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in rule_ensemble.classify(docs.limit(9), labels.limit(0)).collect()} == {0.5}
    only = rule_ensemble.classify(docs.limit(40), labels.where("quality = 1")).select("score").distinct().collect()
    assert len(only) == 1 and only[0].score > 0.5


# ---- prefix trie ------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        yield min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_conversations(spark):
    rows = [(0, t, "user", f"t{t % 3}") for t in range(300)]  # longer than a part
    rows += [(1, 0, "user", "a"), (2, None, "user", None), (2, 1, None, "b"), (2, None, "", ""), (-3, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "a")]
    rows += [(5, 2, "user", "a"), (5, 2, "assistant", "a"), (6, 9, "q", "z"), (10, 0, "", ""), (11, 0, "", "é" * 50_000), (13, 4, "user", "a"), (1003, 1, "user", "a")]
    rows += [(c, 0, "user", "same") for c in range(20, 120)]
    got = prefix_trie.trie(clash(spark.createDataFrame(rows, TURNS).repartition(3)))
    assert bag(map(tuple, got.collect())) == bag(plain_trie(rows))


def test_trie_of_the_table_and_of_none(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert bag(map(tuple, prefix_trie.trie(df).collect())) == bag(plain_trie(df.select("conv_id", "turn", "role", "text").collect()))
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom", "one"])
def test_contraction(spark, shape):
    n = 60
    random = np.random.default_rng(3)
    parent = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(random.integers(0, i)), "broom": lambda i: i - 1 if i < 30 else 29, "one": lambda i: 0,
    }[shape]
    up = [None, *(parent(i) for i in range(1, n if shape != "one" else 1))]
    weight = [i * i for i in range(len(up))]
    total, size = list(weight), [1] * len(up)
    for i in range(len(up) - 1, 0, -1):
        total[up[i]] += total[i]
        size[up[i]] += size[i]
    tree = spark.createDataFrame([(i, p, w, 1) for i, (p, w) in enumerate(zip(up, weight, strict=True))], "node long, parent long, w long, one long")
    assert {tuple(r) for r in prefix_trie.subtree_totals(tree, "w", "one").collect()} == {(i, total[i], size[i]) for i in range(len(up))}


# ---- vector codes -----------------------------------------------------------------------


def plain_codes(rows, entries=64):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 256).astype(np.int64).reshape(len(kept), 16, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return gaps.argmin(-1), gaps.min(-1)

    for _ in range(2):
        code, _ = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = [int(s) // int((code[:, p] == e).sum()) for s in x[code[:, p] == e, p].sum(0)]
    code, squared = assign()
    error = squared.sum(1)
    by = Counter()
    for r, e in zip(kept, error.tolist(), strict=True):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(r[0], bytes(c.astype(np.uint8)).hex(), e, by[r[2]], digest) for r, c, e in zip(kept, code, error.tolist(), strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_of_odd_vectors(spark):
    random = np.random.default_rng(5)
    wide = lambda: [float(x) for x in random.integers(-3, 4, 48) / 128]  # few values: many ties
    rows = [(i, wide(), None if i % 5 == 0 else i % 3) for i in range(400)]
    rows += [rows[7], rows[7], (None, wide(), 1), (7, wide(), 2), (1000, None, 1), (1001, [None, *wide()[1:]], 1), (1002, [math.nan, *wide()[1:]], None), (1003, [-math.inf, *wide()[1:]], 9)]
    got = vector_codes.encode(clash(spark.createDataFrame(rows, VECTORS).repartition(3)))
    assert bag(map(tuple, got.collect())) == bag(plain_codes(rows))


def test_codes_of_what_cannot_be_cut_alike(spark):
    one = [0.5] * 16
    rows = [(1, one, 1), (2, [0.5] * 17, 1), (3, [0.5] * 32, 1), (0, [], 1), (4, [2.0e9] * 16, 1), (5, [-0.5] * 16, None)]
    assert {r.vec_id for r in vector_codes.encode(spark.createDataFrame(rows, VECTORS)).collect()} == {1, 5}
    assert vector_codes.encode(spark.createDataFrame(rows, VECTORS).limit(0)).count() == 0
    assert vector_codes.encode(spark.createDataFrame([(0, [], 1), (1, None, 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("high", [2, 60, 1 << 20])
def test_tree_search_is_exact_and_looks_at_less(high):
    random = np.random.default_rng(high)
    points, queries = random.integers(-high, high + 1, (64, 4)), random.integers(-high, high + 1, (3000, 4))
    entry, squared, looked = vector_codes.nearest(vector_codes.grow(np.arange(64), points), queries)
    every = ((queries[:, None] - points[None]) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (squared == every.min(1)).all()
    assert looked < (0.75 if high > 2 else 1) * every.size


# ---- links of a dense cluster of fingerprints ---------------------------------------------


def test_links_of_a_dense_cluster_are_few(spark):
    """All fingerprints within two bits of one are within four of each other: 2,081 of them have 2,164,240 pairs."""
    from itertools import combinations

    from gridloom.llm import components, simhash

    base = 0x0123456789ABCDEF
    cluster = [base] + [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i, j in combinations(range(64), 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = [(0x5555 << 40) ^ ((1 << 3 * k) - 1) for k in range(6)]  # each three bits from the one before
    prints = spark.createDataFrame([(signed(x),) for x in cluster + chain], "print long")
    found = simhash.connecting_links(prints).collect()
    assert len(found) < 30 * len(cluster) and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert len({roots[signed(x)] for x in cluster}) == 1 and len({roots[signed(x)] for x in chain}) == 1 and len(set(roots.values())) == 2
