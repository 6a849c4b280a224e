"""A sparse rule ensemble that scores the quality of texts.

Statistics of every whole text come from built-in functions.  A forest of shallow trees
is grown on the labelled documents of the learning fold; every path from a root to a
node is a rule, a conjunction of bounds on statistics.  A logistic regression with an
L1 penalty weighs the rules, most of them by 0.  The rest are compiled into one column
expression over the statistics, so scoring stays in the JVM and nothing is collected
but trees and weights, whose size parameters bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, written

#: The forest: trees and their depth, so at most TREES * (2 ** (DEPTH + 1) - 2) rules.
TREES, DEPTH = 20, 3
#: The L1 penalty on a rule's weight.
PENALTY = 0.0005
#: Documents of this remainder of crc32(doc_id as text) by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
#: The score from which a document counts as good.
GOOD = 0.7

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>~^_={}[]\\@+/"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All are 0 for a text without words.
STATISTICS = (
    "log_words", "word_length", "words_a_line", "upper_share", "digit_share", "symbol_share", "bar_share", "bang_share", "stop_share", "comma_share",
    "wide_share", "repeated_lines", "repeated_words", "stutters", "long_words", "short_words",
)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and STATISTICS (doubles) of every row; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    rows = columns(docs, doc_id=id_column, text=text_column).select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"({_WORD})")).alias("words"), F.split("text", "\n", -1).alias("lines"))
    many = lambda chars: (F.char_length("text") - F.char_length(F.translate("text", chars, ""))).cast("double")
    n, solid = F.size("words").cast("double"), F.char_length(F.translate("text", _SPACE, "")).cast("double")
    lines = F.filter("lines", lambda x: F.trim(x) != "")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    before = F.concat(F.array(F.lit("")), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    same = F.size(F.filter(F.zip_with("words", before, lambda a, b: a == b), lambda x: x))
    length = lambda lo, hi: F.size(F.filter("words", lambda w: F.char_length(w).between(lo, hi)))
    made = [
        F.log2(n + 1), share(solid, n), share(n, F.size(lines)), share(many(_UPPER), solid), share(many("0123456789"), solid), share(many(_SYMBOLS), solid),
        share(many("|"), n), share(many("!?"), n), share(many("."), n), share(many(",;:"), n), share((F.octet_length("text") - F.char_length("text")).cast("double"), solid),
        share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)), share(n - F.size(F.array_distinct("words")), n), share(same, n),
        share(length(15, 1 << 30), n), share(length(1, 3), n),
    ]
    return rows.select("doc_id", *[x.cast("double").alias(name) for name, x in zip(STATISTICS, made, strict=True)])


@dataclass(frozen=True)
class Rule:
    """A conjunction: lower < statistic <= upper for each statistic it names."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = [F.col(name) > lower for name, lower, _ in self.bounds if lower > -math.inf] + [F.col(name) <= upper for name, _, upper in self.bounds if upper < math.inf]
        found = tests[0]
        for test in tests[1:]:
            found &= test
        return found


def paths(node, bounds: dict[str, tuple[float, float]] | None = None) -> set[Rule]:
    """The rules of a tree of the ML library: one for every node but the root."""
    bounds = bounds or {}
    found = {Rule(tuple((name, *bounds[name]) for name in sorted(bounds)))} if bounds else set()
    if node.getClass().getSimpleName() == "InternalNode":
        name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
        lower, upper = bounds.get(name, (-math.inf, math.inf))
        found |= paths(node.leftChild(), bounds | {name: (lower, min(upper, at))})
        found |= paths(node.rightChild(), bounds | {name: (max(lower, at), upper)})
    return found


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with weights; the score of a row of STATISTICS is the logistic of their sum."""

    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total += F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 11) -> RuleEnsemble:
    """Learn from STATISTICS and label (1.0 or 0.0) of every given row.

    Without rows of both labels the score is one number for all documents: the share of
    label 1, as if one more document of each label had been seen.
    """
    n, good = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)))
    rows = labelled.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInfoGain=1e-4, seed=seed).fit(rows)
    found: set[Rule] = set()
    for tree in forest.trees:
        found |= paths(tree._call_java("rootNode"))
    rules = sorted(found, key=lambda r: r.bounds)
    if not rules:
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)))
    held = F.array(*[r.column().cast("double") for r in rules])
    fitted = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(labelled.select("label", array_to_vector(held).alias("x")))
    return RuleEnsemble(float(fitted.intercept), {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; one without an id isn't, nor can it have a label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from GOOD on) and STATISTICS of every row of `docs`.

    Learns from labelled documents outside the held-out fold, all of them, and from
    their texts alone.  A null or empty text has statistics of 0 and is scored like any
    other.  Repeated rows come out each, with one score; a document with several labels
    is bad if one says so, null labels don't count.  An empty table gives an empty result;
    without labels of both kinds all scores are equal (see `fit`).
    """
    stats = written(statistics(docs, id_column, text_column), "statistics")
    marks = columns(labels, doc_id="doc_id", quality="quality").groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("label")).where("label is not null")
    learned = stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("label", *STATISTICS)
    model = fit(written(learned, "learned"))
    score = model.score()
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), *STATISTICS).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
