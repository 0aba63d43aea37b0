"""Sectors: connected groups of nearby injectors and producers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.quantiles import group_quantile
from wellspan.operators.spatial import nearest, pairs_within
from wellspan.session import cut_lineage


def block_map(entities: DataFrame, category: DataFrame) -> DataFrame:
    """Block of each entity's well; NULL acts as a wildcard."""
    blocks = category.where(F.col("block").isNotNull()).groupBy("field", "well").agg(F.max("block").alias("block"))
    return entities.join(blocks, ["field", "well"], "left")


def points(entities: DataFrame, role: str) -> DataFrame:
    return entities.where(F.col("role") == role).select("field", F.col("entity").alias("id"), "x", "y")


def nearest_both(entities: DataFrame) -> DataFrame:
    """Nearest opposite entity of every entity: (field, role, id, other, d)."""
    i, p = points(entities, "I"), points(entities, "P")
    a = nearest(i, p).withColumn("role", F.lit("I"))
    return a.unionByName(nearest(p, i).withColumn("role", F.lit("P")))


def cutoff_radius(near: DataFrame, factor: float) -> DataFrame:
    """Influence radius per field: a multiple of the median nearest distance over both sides.

    The two roles of a converted well share one place and say nothing about spacing, so zero distances are left out; a field
    that has no others gets the radius 0, which holds the pairs at one place."""
    med = group_quantile(near.where(F.col("d") > 0), ["field"], "d", 0.5, "median_d")
    every = near.select("field").distinct().join(med, "field", "left")
    return every.select("field", F.coalesce("median_d", F.lit(0.0)).alias("median_d")).withColumn("r", factor * F.col("median_d"))


def pair_distances(entities: DataFrame, factor: float, near: DataFrame | None = None) -> DataFrame:
    """Injector-producer pairs inside the influence radius; one rule for fields of every size."""
    near = cut_lineage(nearest_both(entities)) if near is None else near
    pairs = pairs_within(points(entities, "I"), points(entities, "P"), cutoff_radius(near, factor).select("field", "r"))
    return pairs.select("field", F.col("a_id").alias("injector"), F.col("b_id").alias("producer"), "d")


def sector_edges(blocked: DataFrame, cfg: Settings = DEFAULTS, near: DataFrame | None = None) -> DataFrame:
    """Edges of the sector graph; ``blocked`` has field, entity, role, x, y, block."""
    pairs = pair_distances(blocked, cfg.sector_cutoff_factor, near)
    side = lambda role, name, b: blocked.where(F.col("role") == role).select(
        "field", F.col("entity").alias(name), F.col("block").alias(b)
    )
    e = pairs.join(side("I", "injector", "bi"), ["field", "injector"]).join(side("P", "producer", "bp"), ["field", "producer"])
    same = F.col("bi").isNull() | F.col("bp").isNull() | (F.col("bi") == F.col("bp"))
    return e.where(same).select("field", "injector", "producer", "d")


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("field", "a").agg(F.min("b").alias("m"))
    return cut_lineage(least.select("field", "a", F.least("a", "m").alias("m")))


def _hang_above(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour moves to the least neighbour of the node it hangs on."""
    both = pairs.unionByName(pairs.select("field", F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.where(F.col("b") > F.col("a")).join(_least_neighbour(both), ["field", "a"])
    return moved.select("field", F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _hang_below(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the least of them."""
    least = _least_neighbour(pairs)
    moved = pairs.join(least, ["field", "a"]).where(F.col("b") != F.col("m")).select("field", F.col("b").alias("a"), F.col("m").alias("b"))
    whole = moved.unionByName(least.select("field", "a", F.col("m").alias("b")))
    return whole.where(F.col("a") != F.col("b")).distinct()


def _component_labels(edges: DataFrame) -> DataFrame:
    """Smallest label reachable from each node.  Labels start with 0 for injectors and 1 for producers, so a
    component is named by its first injector.

    The two star steps take turns until each node hangs on its component's least one; rounds grow as the logarithm of the
    nodes, also along a chain, and end only when nothing moves."""
    link = edges.select("field", F.concat(F.lit("1"), "producer").alias("a"), F.concat(F.lit("0"), "injector").alias("b"))
    now, mark = cut_lineage(link.distinct()), None
    while True:
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("field", "a", "b").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        mark, now = found, cut_lineage(_hang_below(cut_lineage(_hang_above(now))))
    heads = now.select("field", F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select("field", F.col("a").alias("node"), F.col("b").alias("label")).unionByName(heads)


def _numbered(heads: DataFrame) -> DataFrame:
    """(field, label, number): the place of each label in its field, from 1.  Ranges are numbered by themselves and moved by
    the rows that the field has in ranges before, so no task sees a whole field."""
    dealt = cut_lineage(heads.repartitionByRange("field", "label").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("field", "part").agg(F.count(F.lit(1)).alias("n"))  # one row per field and range
    before = F.sum("n").over(Window.partitionBy("field").orderBy("part")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("field", "part").orderBy("label"))
    out = dealt.withColumn("own", own).join(sizes.select("field", "part", before.alias("before")), ["field", "part"])
    return out.select("field", "label", (F.col("own") + F.col("before")).alias("number"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(field, entity, role, sector) for every entity that has an edge; sectors numbered by their first injector."""
    labels = _component_labels(edges)
    heads = _numbered(labels.select("field", "label").distinct())
    role = F.when(F.col("node").startswith("0"), "I").otherwise("P")
    return labels.join(heads, ["field", "label"]).select(
        "field", F.substring("node", 2, 1 << 20).alias("entity"), role.alias("role"), F.concat(F.lit("S"), "number").alias("sector")
    )


def assign_isolated(entities: DataFrame, components: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Entities without an edge join the sector of their nearest opposite well: injectors first, then producers.
    A field without any edge is one sector; without coordinates everything isolated goes to S1."""
    near = nearest_both(entities) if near is None else near
    left = entities.join(components.select("field", "entity"), ["field", "entity"], "left_anti").select("field", "entity", "role")
    has = components.select("field").distinct().withColumn("real", F.lit(True))
    left = left.join(has, "field", "left").join(
        near.select("field", F.col("id").alias("entity"), "other"), ["field", "entity"], "left"
    )
    lone = left.where(F.col("real").isNull()).select("field", "entity", "role", F.lit("S1").alias("sector"))
    blind = left.where(F.col("real") & F.col("other").isNull()).select("field", "entity", "role", F.lit("S1").alias("sector"))
    left = left.where(F.col("real") & F.col("other").isNotNull())

    def follow(role, known):
        target = known.select("field", F.col("entity").alias("other"), "sector")
        return left.where(F.col("role") == role).join(target, ["field", "other"]).select("field", "entity", "role", "sector")

    base = components.select("field", "entity", "role", "sector")
    with_i = base.unionByName(follow("I", base))
    return with_i.unionByName(follow("P", with_i)).unionByName(lone).unionByName(blind)


def influence_scale(near: DataFrame, length: float, cutoff: float) -> DataFrame:
    """Decay length and cutoff per field as multiples of the median nearest distance, so that the number of pairs per
    well does not depend on how densely a field is drilled."""
    med = cutoff_radius(near, 1.0).where(F.col("median_d") > 0)
    return med.select("field", (length * F.col("median_d")).alias("length"), (cutoff * F.col("median_d")).alias("cutoff"))


def influence_distance_prior(entities: DataFrame, scale: DataFrame, injector_sum: float) -> DataFrame:
    """Prior coupling exp(-d/L) inside the cutoff, each injector's row scaled to ``injector_sum``.
    scale: field, length, cutoff."""
    pairs = pairs_within(points(entities, "I"), points(entities, "P"), scale.select("field", F.col("cutoff").alias("r")))
    raw = pairs.join(scale.select("field", "length"), "field").withColumn("w", F.exp(-F.col("d") / F.col("length")))
    total = raw.groupBy("field", "a_id").agg(F.sum("w").alias("tot"))
    return raw.join(total, ["field", "a_id"]).select(
        "field", F.col("a_id").alias("injector"), F.col("b_id").alias("producer"), "d",
        (F.col("w") / F.col("tot") * injector_sum).alias("f"),
    )


def distance_mask(entities: DataFrame, factor: float, cfg: Settings = DEFAULTS) -> DataFrame:
    """Pairs that may connect: inside the radius, plus each producer's nearest injector (ties included)."""
    near = cut_lineage(nearest_both(entities))
    radius = cutoff_radius(near, factor)
    i, p = points(entities, "I"), points(entities, "P")
    inside = pairs_within(i, p, radius.select("field", "r"))
    closest = nearest(p, i, ties=True).select("field", F.col("other").alias("a_id"), F.col("id").alias("b_id"), "d")
    return inside.unionByName(closest).distinct().select(
        "field", F.col("a_id").alias("injector"), F.col("b_id").alias("producer"), "d"
    )
