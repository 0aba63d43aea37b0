"""Quality classifier: rules from tree paths, lasso weights, one compiled column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.common import keep_table, let, words
from wellspan.llm.rules import repeat_words, without


@dataclass(frozen=True)
class Fit:
    """``sample``: most labelled rows that are learned from, chosen by hash; the fit's memory does not grow beyond it."""

    sample: int = 20_000
    trees: int = 30
    depth: int = 3
    lasso: float = 0.002
    threshold: float = 0.3
    folds: int = 5
    seed: int = 17


FEATURES = ["log_words", "word_length", "symbols", "bars", "shouts", "upper", "digits", "marks", "dup_lines", "repeated", "distinct", "words_per_line", "long_share", "other"]


def held_out(doc_id: Column, folds: int = Fit.folds) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns in ``carry`` and FEATURES, all of the whole text alone; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeated"), F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x: F.length(x) > 15)).alias("long"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    raw = docs.select(
        "doc_id", *carry, by_word.alias("_w"), by_line.alias("_l"), without(text, r"[^#*$%&|<>]+").alias("_symbols"), without(text, r"[^|]+").alias("_bars"), without(text, r"[^!?]+").alias("_shouts"),
        without(text, r"[^\p{Lu}]+").alias("_upper"), without(text, r"[^0-9]+").alias("_digits"), without(text, r"[\p{L}\p{N}\s]+").alias("_marks"), without(text, r"[\x21-\x7E\s\p{L}]+").alias("_other"),
    )
    n, chars = F.greatest(F.col("_w.n"), F.lit(1)), F.greatest(F.col("_w.chars"), F.lit(1))
    made = {
        "log_words": F.log1p(F.col("_w.n")), "word_length": F.col("_w.chars") / n, "symbols": F.col("_symbols") / n, "bars": F.col("_bars") / n, "shouts": F.col("_shouts") / n,
        "upper": F.col("_upper") / chars, "digits": F.col("_digits") / chars, "marks": F.col("_marks") / n, "dup_lines": F.col("_l.dup") / F.greatest(F.col("_l.n"), F.lit(1)),
        "repeated": F.col("_w.repeated") / n, "distinct": F.col("_w.distinct") / n, "words_per_line": F.col("_w.n") / F.greatest(F.col("_l.n"), F.lit(1)), "long_share": F.col("_w.long") / n, "other": F.col("_other") / chars,
    }
    return raw.select("doc_id", *carry, *[made[f].cast("double").alias(f) for f in FEATURES])


def training_rows(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """Statistics and label of a bounded sample of the labelled documents that are not held out.

    The ids of the sample are at most ``fit.sample`` (plus chance) longs, so they are broadcast and texts are not shuffled.
    """
    known = labels.select("doc_id", F.col("quality").alias("_label")).filter("doc_id is not null and _label is not null").filter(~held_out(F.col("doc_id"), fit.folds))
    known = known.groupBy("doc_id").agg((F.avg("_label") >= 0.5).cast("double").alias("_label"))
    n = known.count()
    if n > fit.sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit.sample / n))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return keep_table(statistics(chosen, "_label")).coalesce(2)  # at most the sample, so few tasks do for each step of the fit


def tree_rules(model) -> list[tuple[tuple[int, bool, float], ...]]:
    """All paths from a root to an inner or leaf node as conjunctions of (feature, is at most, threshold)."""
    found = set()

    def walk(node, path):
        if path:
            found.add(tuple(sorted(path)))
        if node.getClass().getSimpleName().startswith("Internal"):
            split = node.split()
            f, cut = split.featureIndex(), split.threshold()
            walk(node.leftChild(), {*path, (f, True, cut)})
            walk(node.rightChild(), {*path, (f, False, cut)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), set())
    return sorted(found)


def rule_column(rule) -> Column:
    parts = [F.col(FEATURES[f]) <= cut if at_most else F.col(FEATURES[f]) > cut for f, at_most, cut in rule]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p
    return whole.cast("double")


def lasso_weights(fires: np.ndarray, label: np.ndarray, n: np.ndarray, penalty: float, tolerance: float = 1e-8) -> tuple[float, np.ndarray]:
    """Intercept and weights of least mean logistic loss plus ``penalty`` times the sum of absolute weights.

    A row of ``fires`` stands for ``n`` equal documents. Accelerated proximal steps, begun anew whenever the momentum points
    uphill, until no number moves by more than ``tolerance`` times the largest.
    """
    x, share = np.hstack([np.ones((len(fires), 1)), fires]), n / n.sum()
    step = 4 / np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2
    at = np.zeros(x.shape[1])
    ahead, pace = at, 1.0
    while True:
        slope = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500))) - label))
        moved = ahead - step * slope
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        change = moved - at
        uphill = (ahead - moved) @ change > 0
        if np.abs(change).max() <= tolerance * max(1.0, np.abs(moved).max()) and np.abs(ahead - moved).max() <= tolerance * max(1.0, np.abs(moved).max()):
            return float(moved[0]), moved[1:]
        faster = 1.0 if uphill else (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved if uphill else moved + (pace - 1) / faster * change
        at, pace = moved, faster


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) with the rules that the lasso keeps.

    Without rows of both labels there are no rules and the intercept alone stands for the share of label 1.
    """
    rows = training_rows(docs, labels, fit)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    prior = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return math.log(prior / (1 - prior)), []
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=fit.trees, maxDepth=fit.depth, seed=fit.seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return math.log(prior / (1 - prior)), []
    facts = rows.groupBy(F.array(*[rule_column(r) for r in rules]).alias("fires"), "_label").agg(F.count("*").alias("n")).collect()  # at most the sample's rows
    facts.sort()
    intercept, weights = lasso_weights(np.array([f["fires"] for f in facts]), np.array([f["_label"] for f in facts]), np.array([f["n"] for f in facts], float), fit.lasso)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights) if w]


def score_column(intercept: float, weighted: list[tuple[tuple, float]]) -> Column:
    total = F.lit(intercept)
    for rule, weight in weighted:
        total = total + F.lit(weight) * rule_column(rule)
    return 1 / (1 + F.exp(-total))


def classified(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), *carry: str) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for every document.

    Labels of ids whose crc32 leaves remainder 0 are never read; lang, source and doc_id are no inputs. Null and empty texts get
    the score of a text without words. Repeated rows are scored one by one; of several labels of one id the mean decides; null
    labels are ignored. Without both labels the score is the share of label 1 for every row. An empty table gives no rows.
    ``carry`` names columns of ``docs`` to keep; all others are ignored.
    """
    model = learn(docs, labels, fit)
    scored = statistics(docs, *carry).withColumn("score", score_column(*model))
    return scored.select("doc_id", *carry, held_out(F.col("doc_id"), fit.folds).alias("held_out"), "score", (F.col("score") >= fit.threshold).cast("int").alias("predicted"))
