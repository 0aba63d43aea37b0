"""Well roles from rates: modes, types, conversions, role entities and commingled wells.

Everything is keyed by (field, well) and shares one hash partitioning, so the windows below need one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.functions.numeric import safe_div

WELL = ["field", "well"]
RATES = ["q_oil", "q_water", "q_gas", "q_inj"]


def classify_steps(rates: DataFrame) -> DataFrame:
    """Add ``mode``: P producing, I injecting, B both, Z idle."""
    prod = F.coalesce("q_oil", F.lit(0.0)) + F.coalesce("q_water", F.lit(0.0)) > 0
    inj = F.coalesce("q_inj", F.lit(0.0)) > 0
    return rates.withColumn("mode", F.when(prod & inj, "B").when(prod, "P").when(inj, "I").otherwise("Z"))


def _well_type(has_p: Column, has_i: Column) -> Column:
    return F.when(has_p & has_i, "MIXED").when(has_p, "PROD").when(has_i, "INJ").otherwise("NONE")


def well_types(rates: DataFrame) -> DataFrame:
    active = F.col("mode") != "Z"
    out = classify_steps(rates).groupBy(*WELL).agg(
        F.bool_or(F.col("mode").isin("P", "B")).alias("has_p"),
        F.bool_or(F.col("mode").isin("I", "B")).alias("has_i"),
        F.min(F.when(active, F.col("date"))).alias("first"),
        F.max(F.when(active, F.col("date"))).alias("last"),
        F.count_if(active).alias("n_active"),
        F.count_if(F.col("mode") == "B").alias("n_simultaneous"),
    )
    return out.select(
        *WELL, _well_type(F.col("has_p"), F.col("has_i")).alias("type"), "first", "last", "n_active", "n_simultaneous"
    )


def resolved_role(rates: DataFrame) -> DataFrame:
    """Role per active step.  A step with both rates takes the next clear role, else the previous, else P.

    "Next" is read as "previous" in reverse date order: a frame growing from the start costs one pass, a frame
    shrinking towards the end would be re-evaluated for every row.
    """
    steps = classify_steps(rates).where(F.col("mode") != "Z")
    clear = F.when(F.col("mode") != "B", F.col("mode"))
    back = Window.partitionBy(*WELL).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*WELL).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    nxt, prev = F.last(clear, ignorenulls=True).over(back), F.last(clear, ignorenulls=True).over(ahead)
    return steps.withColumn("role", F.coalesce(clear, nxt, prev, F.lit("P")))


def conversions(rates: DataFrame) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy(*WELL).orderBy("date"))
    changed = resolved_role(rates).withColumn("from_role", before).where(F.col("from_role") != F.col("role"))
    return changed.select(*WELL, "date", "from_role", F.col("role").alias("to_role"))


def conversion_events(rates: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.col(c) == "P", "producer").otherwise("injector")
    return conversions(rates).select(
        *WELL, "date", F.lit("CONVERSION").alias("type"),
        F.concat(name("from_role"), F.lit(" to "), name("to_role")).alias("note"),
    )


def merge_events(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Well events followed by the detected conversions."""
    return events.unionByName(conversion_events(rates), allowMissingColumns=True)


def split_roles(rates: DataFrame) -> DataFrame:
    """Rows per role entity.  A well that does both becomes ``well@P`` and ``well@I``; one pass, no self-join."""
    per_well = Window.partitionBy(*WELL)
    steps = classify_steps(rates).withColumn(
        "type",
        _well_type(
            F.max(F.col("mode").isin("P", "B")).over(per_well), F.max(F.col("mode").isin("I", "B")).over(per_well)
        ),
    )
    mixed = F.col("type") == "MIXED"
    as_p = (F.col("type") == "PROD") | (mixed & F.col("mode").isin("P", "B"))
    as_i = (F.col("type") == "INJ") | (mixed & F.col("mode").isin("I", "B"))
    roles = F.filter(
        F.array(F.when(as_p, F.lit("P")), F.when(as_i, F.lit("I"))), lambda r: r.isNotNull()
    )
    out = steps.withColumn("role", F.explode(roles))
    entity = F.when(mixed, F.concat("well", F.lit("@"), "role")).otherwise(F.col("well"))
    zeroed = lambda c, role: F.when(mixed & (F.col("role") == role), F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return out.select(
        *WELL, entity.alias("entity"), "role", "date",
        zeroed("q_oil", "I"), zeroed("q_water", "I"), zeroed("q_gas", "I"), zeroed("q_inj", "P"), "days_on",
    )


def commingled_factors(category: DataFrame) -> DataFrame:
    """Normalised share per reservoir for wells listed under several; equal shares when any factor is missing."""
    w = Window.partitionBy(*WELL)
    rows = category.where(F.col("reservoir").isNotNull())
    rows = (
        rows.withColumn("n_res", F.size(F.collect_set("reservoir").over(w)))
        .withColumn("n_rows", F.count(F.lit(1)).over(w))
        .withColumn("n_factor", F.count("alloc_factor").over(w))
        .withColumn("total", F.sum("alloc_factor").over(w))
        .where(F.col("n_res") > 1)
    )
    given = F.col("n_factor") == F.col("n_rows")
    return rows.select(
        *WELL, "reservoir",
        F.when(given, safe_div(F.col("alloc_factor"), F.col("total"))).otherwise(1.0 / F.col("n_rows")).alias("share"),
        (~given).alias("equal_split"),
    )


def split_commingled(rates: DataFrame, category: DataFrame) -> DataFrame:
    """Replicate the rows of commingled wells per reservoir (``well#reservoir``); other wells pass unchanged."""
    joined = rates.join(commingled_factors(category), WELL, "left")
    share = F.coalesce("share", F.lit(1.0))
    well = F.when(F.col("share").isNotNull(), F.concat("well", F.lit("#"), "reservoir")).otherwise(F.col("well"))
    return joined.select("field", well.alias("well"), "date", *[(F.col(c) * share).alias(c) for c in RATES], "days_on")
