"""Quality rules: measure once, store failure bits, apply policies and ablations to the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.common import let, words

WINDOW = 8

#: name -> condition on the measurements that fails the rule; the position in this list is the rule's bit. Only ever append.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "n_symbols > 0.5 * n_words"),
    ("duplicate_lines", "n_dup_lines > 0.3 * n_lines and n_dup_lines >= 3"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "n_words >= 20 and n_upper > 0.5 * word_chars"),
    ("many_marks", "n_marks > 1.5 * n_words"),
]


@dataclass(frozen=True)
class Policy:
    """A named version: the rules of which one failure rejects."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(name for name, _ in RULES))
POLICIES = (BASE, STRICT)


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the array of words.

    Windows are compared by their 64-bit hash. Sorted by (hash, start), equal windows are neighbours, so two lookups per window
    tell repeats; sorted by start, each repeated window adds the words up to the next one.
    """
    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("long"),
            lambda total, i: total + F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(window))).cast("long"),
        )

    def marked(seen: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(seen, i)["h"] == F.get(seen, j)["h"], F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(seen) - 1), lambda i: same(i, i + 1) | same(i, i - 1))
        return let(F.array_sort(F.transform(at, lambda i: F.get(seen, i)["start"])), lambda starts: F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(covered(starts)))

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("start"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, marked))

    def from_words(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))), counted)

    return let(ws, lambda w: F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(from_words(w)))


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns named in ``carry`` and the measurements of the whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    wide = docs.select("doc_id", *carry, counts.alias("_w"), line_counts.alias("_l"), without(text, r"[^#*$%&|<>]+").alias("n_symbols"), without(text, r"[^\p{Lu}]+").alias("n_upper"), without(text, r"[\p{L}\p{N}\s]+").alias("n_marks"))
    return wide.select("doc_id", *carry, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_upper", "n_marks")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements of each document and ``failures``, a long whose bit k is set if rule k fails.

    Every rule is evaluated once and none shadows another, so policies and ablations never read a text again.
    Null and empty texts have no words and fail ``too_few_words``. Repeated rows are judged one by one. An empty table gives no
    rows; other columns are ignored.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured(docs).withColumn("failures", total)


def judged(rows: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Add ``base_failed`` and the policy's verdict ``kept``; what fails the base is never kept."""
    failed = lambda mask: F.col("failures").bitwiseAND(F.lit(mask).cast("long")) != 0
    return rows.withColumns({"base_failed": failed(BASE.mask), "policy": F.lit(policy.name), "kept": ~failed(policy.mask | BASE.mask)})


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: documents the rule fails, documents only it rejects, and documents kept without it.

    One aggregation over distinct failure words, then arithmetic on as many rows as there are such words.
    """
    words_ = rows.groupBy("failures").agg(F.count("*").alias("n"))
    plans = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for p in policies for k, (name, _) in enumerate(RULES) if name in p.rules]
    each = words_.select("n", "failures", F.explode(F.array(*plans)).alias("p")).select("n", "failures", "p.*")
    hit = F.col("failures").bitwiseAND(F.col("bit")) != 0
    rest = F.col("failures").bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit")))) == 0
    return each.groupBy("policy", "rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("n_only_this"), F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"))
