"""Every operator against a plain version, over documents with every oddity at once."""

import hashlib
import json
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.common import written
from gridloom.llm import chat, components, decontam, licenses, line_dedup, packing, quality, registry, sharding, simhash, suffix_dedup, token_blocks, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an operator might use a name of, beside those of documents.
CLASHES = ["text_hash", "hash", "part", "seq", "n_ids", "ids", "queue", "before", "base", "n", "shard", "slot", "print", "root", "line", "place", "_doc", "_hash", "_covered", "_id", "n_lines", "n_removed", "kept", "score", "minimizer", "list"]
SMALL = "/root/testdata/sf0.001"


def odd_rows():
    prose = open(__file__, encoding="utf8").read()
    big = " ".join(f"w{i * i % 977}" for i in range(60_000))
    texts = [
        (0, prose), (1, None), (2, ""), (3, "  \n\t "), (4, big), (5, prose), (6, prose[:3000]), (6, prose[:3000]), (None, prose[100:2500]),
        (7, "A\nB\nC\nD"), (8, "x\nA\nB\nC\ny"), (9, "a a a a a a a a a a " * 9), (10, "Ünï cödé  <|endoftext|> a  b c ½x don't 3.14 \x1c q"),
        (11, "Licensed under the Apache License, Version 2.0.\nCC BY CC by\nMIT license"), (12, "a\n" * 7), (13, "| # $ | % " * 40), (14, "one two"), (15, "one two"),
    ]
    return [(i, t, "en", s, None) for (i, t), s in zip(texts, ["a", "b", None, "", "a"] * 9)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def texts():
    return [(r[0], r[1] or "") for r in odd_rows()]


def bag(rows):
    return Counter(map(repr, rows))


# ---- 1 --------------------------------------------------------------------------------


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (13, 0, 0), (None, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    want = [(i, *plain_statistics(t)) for i, t in texts()]
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == bag(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(none, labels).count() == 0
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == sum(not r.base_failed for r in got)


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_quality_verdicts_by_a_plain_forest(spark):
    """Scores, threshold and verdicts of the small table, one document after another."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        labels[r.doc_id].append(r.quality)
    rows = {}
    for r in docs:
        n, chars, symbols, dup, again = plain_statistics(r.text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n"))
        stutters = sum(a == b for a, b in zip(words, words[1:]))
        if n >= 20 and 100 * again <= 30 * n:
            rows[r.doc_id] = [min(50_000, int(1000 * x + 0.5)) for x in (symbols / n, symbols / chars, stutters / n, dup / lines, again / n, chars / n, np.log2(n + 1))]
    good = [v for i, v in rows.items() if i in labels and min(labels[i])]
    bad = [v for i, v in rows.items() if i in labels and not min(labels[i])]
    stats = quality.features(quality.rule_statistics(spark.createDataFrame(docs)).where(~quality.base_failed()))
    frame = stats.join(spark.createDataFrame([(i, min(v)) for i, v in labels.items()], "doc_id long, good int"), "doc_id")
    assert {r.doc_id: [r[f] for f in quality.FEATURES] for r in stats.collect()} == rows
    grown, marks = quality.sample(frame)
    assert sorted([*x, g] for x, g in zip(grown.tolist(), marks)) == sorted([*np.log1p(v), g] for g, rows_ in ((1, good), (0, bad)) for v in rows_)
    forest = quality.grow(grown, marks)

    def score(v):
        total, v = 0.0, [float(np.log1p(x)) for x in v]
        for feature, value, left, path in zip(*(x.tolist() for x in (forest.feature, forest.value, forest.left, forest.path))):
            node = 0
            while feature[node] >= 0:
                node = left[node] + (v[feature[node]] >= value[node])
            total += path[node]
        return round(1000 * 2 ** -(total / len(forest.feature) / forest.usual))

    scores = {i: score(v) for i, v in rows.items() if i in labels}
    fine, poor = ([scores[i] for i in scores if bool(min(labels[i])) is kind] for kind in (True, False))
    share = lambda of, t: sum(x >= t for x in of) / len(of)
    best = max(range(1002), key=lambda t: (share(fine, t) <= 0.005) * (share(poor, t) - share(fine, t)))
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    upper = next((x for x in sorted(set(scores.values())) if x >= best), 1001)  # thresholds between two scores of labelled documents are alike
    assert len(fine) == len(good) and len(poor) == len(bad)
    for i, x in scores.items():
        assert kept[i] == (x < upper)
    assert not any(kept[r.doc_id] for r in docs if r.doc_id not in rows)


def test_forest_scores_outliers_higher():
    rows = np.concatenate([np.random.default_rng(1).normal(size=(500, 2)), [[9.0, 9.0]]])
    scores = quality.grow(rows, np.ones(501)).scores(rows)
    assert scores.argmax() == 500 and np.median(scores) < 0.55 < scores[500]
    none = np.zeros((0, 2))
    assert len(quality.grow(none, np.zeros(0)).scores(np.zeros((3, 2)))) == 3
    assert len(quality.grow(rows, np.zeros(501)).scores(rows)) == 501  # no crowd


def test_forest_isolates_what_lies_between_usual_values():
    """Good documents crowd at 0 to 1 and 9 to 10 of a feature; a bad one at 5 is inside their range, yet isolated."""
    random = np.random.default_rng(3)
    good = np.concatenate([random.uniform(0, 1, (400, 2)), random.uniform(9, 10, (400, 2))])
    odd = np.array([[5.0, 5.0], [0.5, 9.5]])
    rows, marks = np.concatenate([good, odd]), np.r_[np.ones(800), 0, 0]
    scores = quality.grow(rows, marks).scores(rows)
    assert scores[800:].min() > scores[:800].max()


def test_forest_and_a_range_rule(spark):
    """Verdicts come from the forest: they keep good documents that ranges of single statistics (all but 1 % at either end) would reject."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.features(quality.rule_statistics(docs).where(~quality.base_failed())).join(labels.select("doc_id", "quality"), "doc_id")
    ends = stats.where("quality = 1").agg(*[F.percentile_approx(f, F.array(F.lit(0.01), F.lit(0.99)), F.lit(100_000)).alias(f) for f in quality.FEATURES]).first()
    usual = F.lit(True)
    for f in quality.FEATURES:
        usual &= F.col(f).between(*ends[f])
    kept = quality.judge(docs, labels).where("kept").select("doc_id")
    saved = stats.where("quality = 1").where(~usual).join(kept, "doc_id", "left_semi")
    assert saved.count() > 0


# ---- 2, 10 ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(registry.tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_tokenizer(encode):
    tricky = [t for _, t in texts()] + [" a  b", "it's 'tis ''s", "éé Ω≈ç αβγ абв 漢字 ½a a½ ²x", "\x1ca \x85b", " \n \n", "a" * 5000, "a\r\n\r\n b"]
    e = tokens.Encoder(registry.tokenizer_path(), cache_units=50)
    for _ in 0, 1:
        assert [x.tolist() for x in e.encode(tricky)] == [encode(t) for t in tricky]


@pytest.mark.parametrize("change", [None, {"add_prefix_space": True}, {"use_regex": False}, "word_bpe_49k.json"])
def test_encoder_of_other_tokenizers(change, tmp_path):
    setting = json.load(open(registry.tokenizer_path(change if isinstance(change, str) else registry.BYTE_BPE), encoding="utf8"))
    if isinstance(change, dict):
        setting["pre_tokenizer"] |= change
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(setting), encoding="utf8")
    own, e = Tokenizer.from_file(str(path)), tokens.Encoder(str(path))
    some = ["A b  c", "don't stop", "", "ÉÀ x"]
    assert [x.tolist() for x in e.encode(some)] == [own.encode(t, add_special_tokens=False).ids for t in some] and e.by_units == (change is None)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = r.integers(0, [2, 50257, 2**32, 5, 2**16, 1][seed], int(r.integers(0, 5000)), dtype=np.uint64).astype(np.uint32)
    ids[r.random(len(ids)) < 0.03] = 2**32 - 1
    raw = token_blocks.pack(ids, block_ids=int(r.integers(1, 300)))
    assert np.array_equal(token_blocks.unpack(raw), ids)
    a, b = sorted(r.integers(0, len(ids) + 1, 2))
    assert np.array_equal(token_blocks.unpack(raw, a, b), ids[a:b])


def test_exceptions_keep_blocks_narrow():
    ids = np.full(1024, 7, np.uint32)
    ids[::100] = 50_000
    assert len(token_blocks.pack(ids)) < 1024


def test_token_file(spark, odd, none, encode):
    path = token_blocks.write_tokens(odd, registry.tokenizer_path())
    rows = token_blocks.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    assert bag((r.doc_id, r.ids) for r in rows) == bag((i, [*encode(t), 0]) for i, t in texts())
    assert token_blocks.read_tokens(spark, token_blocks.write_tokens(none, registry.tokenizer_path())).count() == 0


@pytest.mark.parametrize("targets,length", [(None, 256), ({"a": 0.5, "b": 0.5}, 64), ({"a": 1.0}, 64)])
def test_packing(odd, encode, targets, length):
    rows = packing.pack(odd, registry.tokenizer_path(), length=length, targets=targets).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, group in by_sequence.items():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [0, *np.cumsum([r.length for r in group])[:-1]]
        assert sum(r.length for r in group) == length or s == len(by_sequence) - 1
    want = Counter((i, tuple([*encode(t), 1])) for i, t in texts())
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    for (i, tokens_), n in want.items():
        if n == 1 and sum(k[0] == i and len(k[1]) == len(tokens_) for k in want) == 1:
            pieces = sorted(by_doc[i, len(tokens_)], key=lambda r: r.start)
            assert [x for p in pieces for x in p.ids] == list(tokens_)
    whole = packing.sequences(packing.pack(odd, registry.tokenizer_path(), length=length), length).collect()
    assert all(len(r.ids) == length for r in whole)


# ---- 3 --------------------------------------------------------------------------------


def test_chat(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "<|im_start|>x<|"), (1, 2, "assistant", "<||a|>\n<|im_end|>\n"), (2, 0, "assistant", "no"), (3, 0, "user", None), (3, 1, "assistant", ""),
        (None, 0, "user", "q"), (None, None, "user", "q"), (4, 5, "user\n%0A<|", "t"), (4, 5, None, "t"), *[(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(600)], (6, 0, "user", "x"), (6, 0, "user", "x"), *[(7, 0, "user", f"t{i % 3}") for i in range(900)],
    ]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    formatted = written(chat.format_conversations(turns), "formatted")
    assert formatted.agg(F.max("n_turns")).first()[0] <= chat.PART_TURNS
    read = defaultdict(list)
    for r in chat.parsed(formatted).orderBy("part").collect():
        read[r.conv_id] += [(t.role, t.text) for t in r.turns]
        joined = "".join(s.text for p in formatted.where(F.col("conv_id").eqNullSafe(r.conv_id)).orderBy("part").collect() for s in p.segments)
        assert joined.count("<|im_start|>") == joined.count("<|im_end|>") == sum(x[0] == r.conv_id for x in rows)
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        assert read[c] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    loss = {r.conv_id: r.loss_text for r in chat.parsed(formatted).where("conv_id < 4").collect()}
    assert loss == {1: "<||a|>\n<|im_end|>\n", 2: "no", 3: ""}
    assert {r.conv_id: r.valid for r in chat.verdicts(formatted).collect()} == {1: True, 2: False, 3: True, None: False, 4: False, 5: True, 6: False, 7: False}
    assert chat.format_conversations(turns.limit(0)).count() == 0


# ---- 4 --------------------------------------------------------------------------------


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_licenses(odd, none):
    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        base, labels, score = {x for _, x in at}, {x for _, x in at}, 0.0
        for label, t in licenses.TEMPLATES:
            whole = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            own, step = set(whole), max(8, len(whole))
            for k in range(0, len(words), step):
                if (share := len(own.intersection(words[k : k + 2 * step])) / len(own)) >= licenses.CONTAINMENT:
                    labels, score = labels | {label}, max(score, share)
        places = [i for i, _ in at]
        return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    got = [tuple(r) for r in licenses.scan(odd).collect()]
    assert bag(got) == bag((i, *plain(t)) for i, t in texts())
    assert any(r[6] == "apache,cc-by,mit" and r[2] == 4 and r[7] == 1.0 for r in got)
    assert licenses.scan(none).count() == 0


def test_wrapped_and_commented_notices(spark):
    filler = " ".join(f"w{i}" for i in range(1000))
    rows = []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        lines = textwrap.wrap(text, 60)
        rows += [(3 * k, "/*\n * " + "\n * ".join(lines) + "\n */\ncode"), (3 * k + 1, f"{filler}\n# " + "\n# ".join(lines) + f"\n{filler}"), (3 * k + 2, filler + " " + " ".join(text.split()[::2]))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[3 * k + i][0] and got[3 * k + i][1] == 1.0 for i in (0, 1)) and got[3 * k + 2][1] == 0.0


def test_long_templates_are_found_anywhere(spark):
    filler = lambda n: " ".join(f"f{i % 700}" for i in range(n))
    for size in (300, 5000):
        long = " ".join(f"t{i}" for i in range(size))
        rows = [(k, f"{filler(k)} {long}\n{filler(9)}") for k in (0, 1, 37, 255, 511, 700, 8191)] + [(-1, " ".join(long.split()[: size * 4 // 5]))]
        got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("long", long)]).collect()}
        assert got.pop(-1) == ("", 0.0) and len(got) == 7 and set(got.values()) == {("long", 1.0)}


def test_scattered_words_are_no_notice(spark):
    rows = [
        (1, "the quarterly review of the version listed under item 2 says that apache helicopters were licensed in 1990 and a driving license costs 0 euros"),
        (2, "the stores got a boost from version 1 of the software, and parts are distributed under a plan that leaves 0 to chance; a license isn't needed"),
        (3, "Licensed under the Apache License, Version 2.0"), (4, "Distributed under the Boost Software License, Version 1.0."),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "apache", 4: "boost"}


# ---- 5 --------------------------------------------------------------------------------


def test_line_dedup(odd, none):
    docs = sorted({(i, t) for i, t, *_ in odd_rows() if t is not None}, key=lambda d: (d[0] is not None, d[0]))
    seen, kept = set(), {}
    for i, t in docs:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        kept[i, t] = (i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    got = line_dedup.dedup_lines(odd).select("doc_id", "text", "n_lines", "n_removed").collect()
    want = [kept[i, t] if t is not None else (i, None, 0, 0) for i, t, *_ in odd_rows()]
    assert bag(map(tuple, got)) == bag(want)
    left = line_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == sum(not (w[3] and w[3] == w[2]) for w in want)
    assert line_dedup.dedup_lines(none).count() == 0


# ---- 7 --------------------------------------------------------------------------------


def test_sharding(spark, odd, none):
    def plain(i, weights):
        score = lambda j: weights[j] / -np.log((int(hashlib.md5(f"{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        return max((j for j in range(len(weights)) if weights[j]), key=score)

    docs = odd.unionByName(spark.range(100, 1100).select(F.col("id").alias("doc_id")), allowMissingColumns=True)
    weights = [1.0, 2.0, 0.0, 1.0]
    rows = sharding.assign(docs, weights).collect()
    for r in rows:
        assert r.shard == plain(r.doc_id, weights) and r.grown_shard == plain(r.doc_id, [*weights, 1.0]) and r.grown_shard in (r.shard, 4)
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    want = bag((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts())
    assert want - bag((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter()
    share = Counter(r.shard for r in rows)
    assert share[2] == 0 and 1.4 < share[1] / share[0] < 2.8
    assert sharding.assign(none, weights).count() == 0


# ---- 8 --------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash(odd, none):
    found = [(i, plain_fingerprint(t)) for i, t in texts()]
    root = plain_components({p for _, p in found})
    name = {r: min((i for i, p in found if root[p] == r and i is not None), default=None) for r in set(root.values())}
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert bag(got) == bag((i, f"{p:016x}", name[root[p]]) for i, p in found)
    one = simhash.keep_one(odd)  # by shingles, not fingerprints
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in texts()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    assert one.columns == odd.columns and one.count() == len(set(group))
    assert simhash.near_duplicates(none).count() == 0


def test_links_are_complete(spark):
    r = np.random.default_rng(5)
    prints = {int(x) for x in r.integers(0, 1 << 63, 40, dtype=np.uint64)}
    for p in list(prints):
        for k in range(7):
            prints.add(p ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    assert got == want and len(want) > 100


def test_golay_code_is_perfect():
    own, start, near = simhash.near_keys()
    assert own.max() < 4096 and {int(start[i + 1] - start[i]) for i in range(0, 65536, 7)} <= set(range(1, 18))
    for x in range(0, 65536, 97):
        mine = set(near[start[x] : start[x + 1]].tolist())
        assert own[x] in mine and all(own[x ^ (1 << b)] in mine for b in range(16))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (7, 7), (502, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9 --------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [decontam.MOST_BITS, 8])
def test_decontamination(spark, odd, none, bits, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "LEAST_BITS", min(bits, decontam.LEAST_BITS))
    prose = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(odd_rows()[0][1]))
    items = [(1, " ".join(prose[50:70])), (2, " ".join(prose[80:96] + ["zz"] * 4 + prose[96:120])), (3, "one two"), (4, None), (5, "no such words are here at all"), (None, " ".join(prose[20:30])), (6, " ".join(prose[:300] + [f"q{i}" for i in range(300)]))]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))] for i in range(len(w) - 4)}
    want = set()
    for i, t, *_ in odd_rows():
        for k, q in items:
            own = shingles(q)
            if own and 5 * len(own & shingles(t)) >= 4 * len(own):
                want.add((i, k, len(own & shingles(t)), len(own)))
    frame = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, shingle string")
    got = decontam.find_items(odd, frame).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert {tuple(r) for r in got} == want and len(want) > 4
    clean = decontam.drop_contaminated(odd, frame)
    assert clean.columns == odd.columns and clean.count() == sum(i not in {w[0] for w in want} for i, *_ in odd_rows())
    assert decontam.find_items(none, frame).count() == 0 == decontam.find_items(odd, frame.limit(0)).count()


def test_stems_that_items_and_documents_share(spark):
    """300 items and 300 documents with a stem of nine words: pairs are those of the items' own words."""
    stem = "which of the following statements is true about the"
    items = [(i, f"{stem} " + " ".join(f"i{i}w{k}" for k in range(16))) for i in range(300)]
    docs = [(i, f"d{i} {stem} " + (items[i][1] if i % 10 == 0 else " ".join(f"d{i}w{k}" for k in range(30)))) for i in range(300)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), frame)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in found.collect()} == {(i, i, 21) for i in range(0, 300, 10)}
    known = frame.select(F.col("item_id").cast("string").alias("item"), "text").rdd.flatMap(lambda r: [(r.item, int(h) - (1 << 63), " ".join(r.text.split()[k : k + 5])) for k, h in enumerate(decontam.shingle_hashes(r.text.encode().split()))])
    signed = decontam.signatures(known.toDF("item string, hash long, shingle string"))
    assert signed.groupBy("hash").count().agg(F.max("count")).first()[0] == 1  # no signature has the stem
    sizes = signed.groupBy("item").agg(F.count("*").alias("k"), F.first("n_item").alias("m"), F.first("least").alias("t")).select("k", "m", "t").distinct().collect()
    assert [(r.k, r.m, r.t) for r in sizes] == [(7, 21, 3)]
