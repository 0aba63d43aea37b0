"""Personal data: fixed patterns as seeds, contexts learned from them, and identifiers that the contexts reveal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.common import keep_table, let

#: Kinds in the order of the contract, with patterns that scan linearly: a quantifier that can never give back is possessive,
#: and a match may not begin inside a run that an earlier start would have taken.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a scan.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A word with a digit or an at sign can be an identifier, and so can a run of words of digits that it begins; no shape holds more
#: than 19 digits, so at most 18 words join it. The words before it are its context.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[(]?[0-9][().0-9-]*+[^\x20\x09-\x0D0-9A-Za-z@]*+(?![^\x20\x09-\x0D])){0,18}+"
#: Shapes in which an identifier of a kind may be written where the context is sure: the most words from the first one on that fit.
SHAPES = {
    "email": r"^[^@\x20]+@[^@\x20]+(?![^\x20])",
    "ip": r"^[^0-9\x20]*[0-9]{1,3}(?:[.:][0-9]{1,5}){3,4}[^0-9\x20]*(?![^\x20])",
    "card": r"^[^0-9\x20]*[0-9](?:[.\x20-]?[0-9]){11,18}[^0-9\x20]*(?![^\x20])",
    "phone": r"^[^0-9\x20]*[0-9](?:[().\x20-]{0,2}[0-9]){6,14}[^0-9\x20]*(?![^\x20])",
}
CONTEXT = 80  # characters before a candidate in which its context words are looked for


@dataclass(frozen=True)
class Bootstrap:
    """A context is believed if so many distinct identifiers of one kind, and such a share of all it introduces, are known."""

    support: int = 5
    confidence: float = 0.8


def running(lengths: Column) -> Column:
    """Sum of the entries before each entry: sums of blocks of 64 first, so long lists cost little more than their length."""
    size, block = F.size(lengths), 64

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("int"), lambda a, x: a + x)

    def from_blocks(sums: Column) -> Column:
        heads = F.aggregate(F.sequence(F.lit(0), F.size(sums) - 1), F.array(F.lit(0)), lambda a, k: F.array_append(a, F.get(a, k) + F.get(sums, k)))
        return let(heads, lambda h: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(h, F.floor(i / block).cast("int")) + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block))))

    return let(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda k: total(F.slice(lengths, k * block + 1, block))), from_blocks)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of all matches, in code points; ``before`` is the text since the last match."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(h: Column, p: Column, lengths: Column) -> Column:
        return let(running(lengths), lambda at: F.transform(h, lambda x, i: F.struct(
            (F.get(at, i) + F.length(F.get(p, i))).alias("start"), (F.get(at, i) + F.get(lengths, i)).alias("end"), x.alias("value"), F.right(F.get(p, i), F.lit(CONTEXT)).alias("before"))))

    def some(h: Column) -> Column:
        return let(pieces, lambda p: let(F.transform(h, lambda x, i: F.length(F.get(p, i)) + F.length(x)), lambda n: placed(h, p, n)))

    empty = "array<struct<start:int,end:int,value:string,before:string>>"
    return let(hits, lambda h: F.when(F.size(h) == 0, F.array().cast(empty)).otherwise(some(h).cast(empty)))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda part: (F.length(short(part)) <= 3) & (F.when(F.length(short(part)) <= 3, short(part)).otherwise(F.lit("999")).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """(start, end, kind number, value) of the fixed pattern's matches that pass its test."""
    number, shape = KINDS.index(kind), "array<struct<start:int,end:int,kind:int,value:string>>"
    found = F.transform(F.filter(located(text, PATTERNS[kind]), lambda m: passes(kind, m["value"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind"), m["value"].alias("value")))
    worth = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    return F.when(worth, found.cast(shape)).otherwise(F.array().cast(shape))


def context(before: Column) -> Column:
    """The two words before, lower-cased, digits as 0; null if there is none on the way to the last match."""
    words = F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 0)
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(words, r"[\x20\x09-\x0D]+", " "))), "[0-9]", "0"), F.lit(""))


def scanned(docs: DataFrame, *carry: str) -> DataFrame:
    """One row for each document: its base spans with their values, and candidates (start, end, value, context)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[base_spans(text, k) for k in KINDS]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    first = docs.select("doc_id", *carry, text.alias("_text"), base.alias("base"))
    worth = F.col("_text").rlike("[0-9@]")
    shape = "array<struct<start:int,end:int,value:string,context:string>>"
    candidates = F.transform(located(F.col("_text"), CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), context(m["before"]).alias("context")))
    rows = first.select("doc_id", *carry, "base", F.when(worth, candidates.cast(shape)).otherwise(F.array().cast(shape)).alias("candidates"))
    return keep_table(rows.withColumn("_row", F.monotonically_increasing_id()))


def instances(rows: DataFrame) -> DataFrame:
    """(_row, start, context, value, kind) of all places with a context; the kind is null for what no fixed pattern knows.

    A base span is one instance with its whole text as value, blanks included, and the words before its first word as
    context; a span that begins inside an earlier one is the same place. Other candidates end before the first base span.
    """
    spots = rows.filter(F.size("candidates") > 0).select("_row", "base", F.explode("candidates").alias("c")).filter("c.context is not null")
    met = F.filter("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    spots = spots.select("_row", "c.*", met.alias("met"))
    word_end = F.col("start") + F.length(F.substring_index("value", " ", 1))
    fresh = lambda b: (b["start"] >= F.col("start")) & (b["start"] < word_end) & ~F.exists("met", lambda o: (o["start"] < b["start"]) & (o["end"] > b["start"]))
    known = F.transform(F.filter("met", fresh), lambda b: F.struct(b["start"].alias("start"), b["value"].alias("value"), b["kind"].alias("kind")))
    free = F.substring(F.col("value"), F.lit(1), F.coalesce(F.get("met", 0)["start"] - F.col("start"), F.length("value")))  # met is in order of start
    free = F.when(F.size("met") == 0, free).otherwise(F.regexp_replace(free, r"\x20[^\x20]*$", ""))
    other = F.array(F.struct("start", free.alias("value"), F.lit(None).cast("int").alias("kind")))
    shape = "array<struct<start:int,value:string,kind:int>>"
    places = F.when(F.exists("met", lambda b: b["start"] < word_end), known.cast(shape)).otherwise(other.cast(shape))
    return spots.select("_row", "context", F.explode(places).alias("p")).select("_row", "context", "p.*")


def reach(value: Column, kind: Column) -> Column:
    """Code points of the value, from its start, that have the shape of the kind; 0 if none."""
    return F.element_at(F.array(*[F.length(F.regexp_extract(value, SHAPES[k], 0)) for k in KINDS]), kind + 1)


def revealed(places: DataFrame, how: Bootstrap) -> DataFrame:
    """(context, value, kind) of candidates that trusted contexts reveal beyond the fixed patterns.

    The graph has contexts on one side and values on the other, one edge for each distinct meeting. In each round a
    context's confidence for a kind is the share of known values of that kind among all its values; values of a fitting shape
    beside a believed context become known, and the next round scores with them. Known values only grow, so it ends.
    """
    edges = keep_table(places.groupBy("context", "value").agg(F.max("kind").alias("kind")))
    known = keep_table(edges.filter("kind is not null").select("value", "kind").distinct())
    seeds = known.count()
    fits = reach(F.col("value"), F.col("kind")) > 0
    while True:
        scored = edges.select("context", "value").join(known, "value", "left").groupBy("context").agg(
            F.countDistinct("value").alias("every"), *[F.countDistinct(F.when(F.col("kind") == k, F.col("value"))).alias(f"k{k}") for k in range(len(KINDS))]
        )
        each = scored.select("context", "every", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("n")) for k in range(len(KINDS))])).alias("s")).select("context", "every", "s.*")
        believed = keep_table(each.filter((F.col("n") >= how.support) & (F.col("n") >= how.confidence * F.col("every"))).select("context", "kind"))
        fresh = edges.filter("kind is null").select("context", "value").join(believed, "context").filter(fits).select("value", "kind")
        known = keep_table(known.unionByName(fresh).distinct())
        now = known.count()
        if now == seeds:
            break
        seeds = now
    return edges.filter("kind is null").select("context", "value").join(believed, "context").filter(fits).groupBy("context", "value").agg(F.min("kind").alias("kind"))


def found(docs: DataFrame, how: Bootstrap = Bootstrap(), *carry: str) -> DataFrame:
    """All spans of personal data: ``base`` by the fixed patterns and ``spans`` with those that learned contexts add.

    Null and empty texts have none. Repeated rows and null ids are rows of their own. An empty table gives no rows. Offsets are
    code points, ends exclusive. ``carry`` names columns of ``docs`` to keep; all others are ignored.
    """
    rows = scanned(docs, *carry)
    places = keep_table(instances(rows))
    new = revealed(places, how)
    span = F.struct("start", (F.col("start") + reach(F.col("value"), F.col("kind"))).alias("end"), "kind")
    added = keep_table(places.filter("kind is null").drop("kind").join(new, ["context", "value"]).groupBy("_row").agg(F.collect_list(span).alias("added")))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))
    whole = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:int>>"))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return rows.join(added, "_row", "left").select("doc_id", *carry, base.alias("base"), whole.alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(rows: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the list of all spans."""
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)  # noqa: E731  a second argument of the inner one would be the place in the list
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by its first kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def cut(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], gap, F.get(names, s["kind"]))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, cut, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
