"""Quality rules and an isolation forest on their statistics.

Every document gets rule statistics; fixed rules reject some documents outright.  The
forest sees the statistics' ratios themselves, on a logarithmic scale.  Its random
splits go through all of the space that labelled documents take up, and a path ends
where at most one good document is left: documents in parts of the space where good
ones are rare or absent have short paths and are anomalous.  It is grown on a bounded
sample of labelled documents; the score at which a document goes is calibrated on all
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, shuffled, use_package, written

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\v\f\r"

#: The forest: trees, rows a tree, and the labelled documents (those with the least hashes) it is grown on.
TREES, TREE_ROWS, SAMPLE_ROWS = 100, 256, 25_600
#: No threshold takes more than this share of the labelled good documents.
MAX_GOOD_LOSS = 0.005
#: Scores are compared in steps of 1 / SCORE_STEPS.
SCORE_STEPS = 1000

STATISTICS = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stutters long"
#: The statistics in relation to each other, in whole steps of a thousandth (length: of a binary logarithm).
FEATURES = ("symbols_per_word", "symbol_share", "stutter_share", "duplicate_line_share", "repeat_share", "word_length", "length")
FEATURE_STEPS, MOST_STEPS = 1000, 50_000


def _repeat_words(words: Sequence[bytes], hashes: np.ndarray) -> int:
    """Words inside windows that occur twice or more.

    Texts in which no two windows have the same hash have none; in the others
    windows are compared by word numbers, first in pairs, then pairs of pairs.
    """
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW_WORDS):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        code = np.unique(code[:-step] * (int(code.max()) + 1) + code[step:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW_WORDS, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of a whole text, from n_words on; none of a null or empty one."""
    if not text:
        return (0,) * 7
    words = text.encode().split()  # of bytes: ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    chars = len(text) - sum(map(text.count, _WHITE))
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    stutters = int((hashes[1:] == hashes[:-1]).sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words, hashes), len(lines), stutters


def rule_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row of STATISTICS for every document."""
    use_package(docs.sparkSession)
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(x.as_py()) for x in batch.column(2)], np.int64).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), *map(pa.array, np.ascontiguousarray(found.T))], names)

    rows = columns(docs, doc_id=id_column, text=text_column).select("doc_id", F.xxhash64("text"), "text")
    return rows.mapInArrow(run, STATISTICS)


def base_failed() -> Column:
    """The fixed rules, as a column over STATISTICS."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """`stats` with FEATURES, whole numbers from 0 to MOST_STEPS."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    made = [
        share("n_symbols", "n_words"), share("n_symbols", "word_chars"), share("n_stutters", "n_words"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("word_chars", "n_words"), F.log2(F.col("n_words") + 1.0),
    ]
    step = lambda x: F.least(F.round(x * FEATURE_STEPS), F.lit(float(MOST_STEPS))).cast("int")
    return stats.withColumns({n: step(x) for n, x in zip(FEATURES, made, strict=True)})


def view(values: np.ndarray) -> np.ndarray:
    """FEATURES as the forest sees them: logarithms, so that small ratios are as far apart as large ones."""
    return np.log1p(values.astype(float))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: split feature (-1 in a leaf), split value, left child, path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for anomalies, under 0.5 in the crowd."""
        total = np.zeros(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            feature, value, left = self.feature[tree], self.value[tree], self.left[tree]
            while True:
                split = feature[node]
                live = split >= 0
                if not live.any():
                    break
                at = node[live]
                node[live] = left[at] + (rows[live, split[live]] >= value[at])
            total += self.path[tree][node]
        return 2.0 ** -(total / len(self.feature) / self.usual)


def _usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, good: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """An isolation forest on sample rows (one column a feature), of which those marked `good` are the crowd.

    A tree draws `tree_rows` of all rows, whose least and greatest values bound its splits,
    and as many of the crowd, which its paths isolate: a part of the space without crowd
    ends a path at once.
    """
    random = np.random.default_rng(seed)
    crowd = rows[good > 0]
    size = min(tree_rows, len(crowd))
    deepest = max(1, int(np.ceil(np.log2(max(2, size)))))
    shape = (trees, 2 ** (deepest + 1))
    feature, value = np.full(shape, -1), np.zeros(shape)
    left, path = np.zeros(shape, np.int64), np.zeros(shape)
    for tree in range(trees if size else 0):
        seen = rows[random.choice(len(rows), min(tree_rows, len(rows)), replace=False)]
        own = crowd[random.choice(len(crowd), size, replace=False)]
        both = np.concatenate([seen, own])
        waiting, used = [(0, own, both.min(axis=0), both.max(axis=0), 0)], 1
        while waiting:
            node, own, least, most, depth = waiting.pop()
            spread = np.flatnonzero(most > least)
            if depth == deepest or len(own) < 2 or not len(spread):
                path[tree, node] = depth + _usual_path(len(own))
                continue
            f = random.choice(spread)
            cut = random.uniform(least[f], most[f])
            feature[tree, node], value[tree, node], left[tree, node] = f, cut, used
            right, below, above = own[:, f] >= cut, most.copy(), least.copy()
            below[f] = above[f] = cut
            waiting += [(used, own[~right], least, below, depth + 1), (used + 1, own[right], above, most, depth + 1)]
            used += 2
    return Forest(feature, value, left, path, max(_usual_path(size), 1e-9))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """STATISTICS and score_step, the forest's score in steps (an int)."""
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            steps = np.rint(forest.scores(view(rows)) * SCORE_STEPS).astype(np.int32)
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(steps)], [*names, "score_step"])

    return features(stats).mapInArrow(run, STATISTICS + ", score_step int")


def threshold(counts: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> int:
    """The step from which documents go: it best separates labelled bad (row 0) and good (row 1) documents.

    That is, the share of bad ones that go less the share of good ones is largest, of
    steps at which at most `max_good_loss` of the good ones go; of equal steps the
    middle one.  Without labels of both kinds nothing goes.
    """
    bad, good = counts.sum(axis=1)
    if not bad or not good:
        return SCORE_STEPS + 1
    gone = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    gain = np.where(gone[1] <= max_good_loss * good, gone[0] / bad - gone[1] / good, -1)
    best = np.flatnonzero(gain == gain.max())
    return int(best[(len(best) - 1) // 2])


def label_counts(rows: DataFrame) -> np.ndarray:
    """Documents of each score step (columns), bad and good (rows), of all labelled ones."""
    counts = np.zeros((2, SCORE_STEPS + 2))
    for r in rows.groupBy("score_step", "good").agg(F.count("*").alias("n")).collect():
        counts[r.good, r.score_step] = r.n
    return counts


def sample(rows: DataFrame, size: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The forest's view of `size` documents with FEATURES, or of all if there are fewer, and which are good.

    Those with the least hashes: a bound on the hash first leaves about `size` rows and
    a tenth, whatever the corpus, and only these are sorted and sent to the driver.
    """
    total, spread = rows.count(), 1 << 50
    draw = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(spread))
    bound = spread if total <= size else int(spread * min(1.0, 1.1 * (size + 100) / total))
    few = rows.where(draw < bound).orderBy(draw, *FEATURES, "good").limit(size).select(*FEATURES, "good").collect()
    values = np.array([tuple(r) for r in few], np.int64).reshape(-1, len(FEATURES) + 1)
    return view(values[:, :-1]), values[:, -1]


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """STATISTICS, base_failed, score and kept for every document.

    Null and empty texts have no words and fail; equal rows come out each, with the
    same verdict; a null doc_id has no label.  A document with several labels is bad if
    one says so.  Documents that fail the fixed rules count neither for the forest nor
    for the threshold.  An empty table gives an empty result.
    """
    stats = written(rule_statistics(docs, id_column, text_column), "statistics")
    marks = columns(labels, doc_id="doc_id", quality="quality").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    labelled = written(features(stats.where(~base_failed())).join(marks, "doc_id").where("good is not null"), "labelled")
    forest = grow(*sample(labelled))
    found = scored(stats, forest)
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    known = scored(labelled.select(*names), forest).join(marks, "doc_id")
    limit = threshold(label_counts(known))
    verdict = ~base_failed() & (F.col("score_step") < limit)
    return found.select("*", base_failed().alias("base_failed"), (F.col("score_step") / SCORE_STEPS).alias("score"), verdict.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `judge` keeps, with their columns; found again by id and text hash."""
    good = judge(docs, labels).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(docs["text"]) == good["_hash"])
    return shuffled(docs).join(good, same, "left_semi")
