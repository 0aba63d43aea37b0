"""Mix sources to target weights by nested hash thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.llm.common import GAP, keep_table, row_numbers

#: The hash has 60 bits; each round of histograms reads the next eight.
HASH_BITS, STEP = 60, 8


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in code point order (repeating, null last), share of all words to take, most repeats of a document."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2


def document_hash(doc_id: Column) -> Column:
    """60 bits of the id's md5, equal in every engine; ids that are null share one value."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Number of words: gaps between words, counted on what is left once each word is one character."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w"), GAP, "")).cast("long")


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, what exceeds ``most`` sizes reshared until nothing does.

    All sources below their limit get the same level per weight, so each round only needs two sums.
    """
    ranked, _ = row_numbers(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "_rank")
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = keep_table(ranked.select("source", "source_size", F.get(weights, (F.col("_rank") % len(mix.weights)).cast("int")).alias("_weight"), (mix.most * F.col("source_size")).cast("double").alias("_limit")))
    total = mix.share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("_limit") <= F.col("_weight") * level
        fixed, open_weight = ranked.agg(F.sum(F.when(full, F.col("_limit"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not open_weight or (now := (total - (fixed or 0.0)) / open_weight) <= level:
            break
        level = now
    return ranked.select("source", "source_size", F.least("_limit", F.col("_weight") * level).alias("target"))


def thresholds(narrow: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash ``_below`` under which its documents are taken once more, for (source, _rest) budgets.

    One histogram of sizes per round: the bucket in which the running sum passes the budget is the only one that the next
    round looks into. At the last bits a bucket is one hash value; it is taken if its middle lies below the budget.
    """
    state = budgets.withColumns({"_from": F.lit(0).cast("long"), "_used": F.lit(0).cast("long"), "_below": F.lit(None).cast("long")})
    bits = HASH_BITS
    while bits > 0:
        step = min(STEP, bits)
        bits -= step
        width = 1 << bits
        open_ = state.filter("_below is null").select("source", "_rest", "_from", "_used")
        inside = narrow.join(open_, narrow["source"].eqNullSafe(open_["source"])).select(narrow["source"], "size", "_hash", "_rest", "_from", "_used").filter(
            (F.col("_hash") >= F.col("_from")) & (F.shiftright(F.col("_hash") - F.col("_from"), bits) < (1 << step))
        )
        bucket = F.shiftright(F.col("_hash") - F.col("_from"), bits)
        sums = inside.groupBy("source", "_rest", "_from", "_used", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
        running = F.col("_used") + F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket"))
        found = sums.withColumn("_after", running).filter(F.col("_after") > F.col("_rest")).groupBy("source", "_rest").agg(
            F.min(F.struct("_bucket", "_from", "_size", "_after", "_least", "_most")).alias("b")
        )
        start = F.col("b._from") + F.col("b._bucket") * F.lit(width)
        before = F.col("b._after") - F.col("b._size")
        single = F.col("b._least") == F.col("b._most")
        taken = before + F.col("b._after") < 2 * F.col("_rest")
        moved = found.select(
            F.col("source").alias("_s"), start.alias("_from1"), before.alias("_used1"),
            F.when(single, F.when(taken, F.col("b._most") + 1).otherwise(F.col("b._least"))).alias("_below1"), F.lit(True).alias("_hit"),
        )
        # no bucket passes the budget: every document below is taken
        state = keep_table(
            state.join(moved, state["source"].eqNullSafe(moved["_s"]), "left").select(
                "source", "_rest", F.coalesce("_from1", "_from").alias("_from"), F.coalesce("_used1", "_used").alias("_used"),
                F.when(F.col("_below").isNotNull(), F.col("_below")).when(F.col("_hit"), F.col("_below1")).otherwise(F.lit(1 << HASH_BITS)).alias("_below"),
            )
        )
        if state.filter("_below is null").isEmpty():
            break
    return state.select("source", "_below")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How many words of each document the mix takes: whole documents, each source near its target.

    Every document of a source is taken floor(target / source size) times, and those below the source's hash threshold once
    more. Returns doc_id, source, size, source_size, target, taken, times.

    A null text has size 0. Null is a source of its own, after all others. A source without words has target 0. Rows with the
    same id share a hash and are taken or left together. An empty table gives no rows. Other columns are ignored.
    """
    narrow = _narrow(docs)
    facts = _facts(narrow, mix)
    times = _times(mix)
    return narrow.join(facts, narrow["source"].eqNullSafe(facts["_source"])).select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Each row of ``docs`` as many times as ``mixed`` takes it.

    How often follows from a row's id and its source's facts, one row for each source, so texts meet those facts where they are and are not shuffled.
    """
    facts = _facts(_narrow(docs), mix).drop("source_size", "target")
    rows = docs.withColumn("_hash", document_hash(F.col("doc_id")))
    taken = rows.join(facts, rows["source"].eqNullSafe(facts["_source"])).select(*[rows[c] for c in docs.columns], _times(mix).alias("_times")).filter("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(docs.columns)


def _narrow(docs: DataFrame) -> DataFrame:
    return keep_table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("_hash")))


def _facts(narrow: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: _source, source_size, target, how often all its documents are taken, and the hash below which they are once more."""
    sources = keep_table(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), mix))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = keep_table(sources.select("source", (F.col("target") - whole * F.col("source_size")).alias("_rest")))
    below = thresholds(narrow, budgets)
    facts = sources.join(below, sources["source"].eqNullSafe(below["source"])).select(sources["source"].alias("_source"), "source_size", "target", whole.alias("_whole"), "_below")
    return keep_table(facts)


def _times(mix: Mix) -> Column:
    return F.least(F.col("_whole") + (F.col("_hash") < F.col("_below")).cast("long"), F.lit(mix.most).cast("long"))


#: DuckDB's form of the same mix: all documents of a source in hash order instead of thresholds.
MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source
), c as (  -- limits in the order in which a rising level reaches them
  select *, 2.0 * source_size as lim,
         coalesce(sum(2.0 * source_size) over (order by 2.0 * source_size / w, source rows between unbounded preceding and 1 preceding), 0) as fixed,
         sum(w) over (order by 2.0 * source_size / w, source rows between current row and unbounded following) as open_w
  from s
), l as (  -- the first limit that the level does not reach
  select min_by(level, lim / w) as level from (select lim, w, (1.5 * (select sum(source_size) from s) - fixed) / open_w as level from c) where level <= lim / w
), t as (
  select source, source_size, least(lim, w * level)::double as target from c, l
), r as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole
  from d join t on d.source is not distinct from t.source
), m as (
  select *, sum(size) over (partition by source order by h) as after1,
         sum(size) over (partition by source order by h) - sum(size) over (partition by source, h) as before1
  from r
)
select doc_id, source, size, source_size, target,
       (least(whole + case when before1 + after1 < 2 * (target - whole * source_size) then 1 else 0 end, 2) * size)::bigint as taken,
       least(whole + case when before1 + after1 < 2 * (target - whole * source_size) then 1 else 0 end, 2)::bigint as times
from m
"""
