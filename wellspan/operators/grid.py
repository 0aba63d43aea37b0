"""The common time grid as long rows (field, well, entity, role, step, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import safe_div
from wellspan.functions.text import base_well
from wellspan.functions.units import liquid_constant_pvt

ENTITY = ["field", "well", "entity"]


def field_dates(entity_rates: DataFrame) -> DataFrame:
    """Sorted distinct dates per field as one array, bounded by the length of the history."""
    return entity_rates.groupBy("field").agg(F.array_sort(F.collect_set("date")).alias("dates"))


def time_axis(entity_rates: DataFrame) -> DataFrame:
    """Step, elapsed days and step length.  The first step borrows the length of the second; a lone date gets 30."""
    axis = field_dates(entity_rates).select("field", "dates", F.posexplode("dates").alias("step", "date"))
    first, n = F.element_at("dates", 1), F.size("dates")
    gap = F.datediff("date", F.get("dates", F.col("step") - 1))
    opening = F.datediff(F.get("dates", F.lit(1)), first)
    dt = F.when(F.col("step") > 0, gap).when(n > 1, opening).otherwise(30)
    return axis.select(
        "field", "step", "date", F.datediff("date", first).cast("double").alias("t_days"),
        dt.cast("double").alias("dt_days"), n.alias("n_steps"),
    )


def drop_duplicates_keep_last(entity_rates: DataFrame, order_col: str) -> DataFrame:
    """One row per (entity, date), the last in input order."""
    keys = [*ENTITY, "role", "date"]
    vals = [c for c in entity_rates.columns if c not in keys and c != order_col]
    kept = entity_rates.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col(order_col)).alias("r"))
    return kept.select(*keys, "r.*")


def densify(entity_rates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every entity on every date of its field; missing months are zero with zero days on.

    Gaps are filled by expanding each row up to the next one, so there is no entity x date cross join and no join
    of the facts to a skeleton: one exchange on (field, well) carries this and every later per-entity window.
    """
    rows = entity_rates.join(field_dates(entity_rates), "field").repartition("field", "well")
    rows = rows.withColumn("at", F.array_position("dates", F.col("date")).cast("int") - 1)
    w = Window.partitionBy(*ENTITY).orderBy("at")
    start = F.when(F.lag("at").over(w).isNull(), 0).otherwise(F.col("at"))
    stop = F.coalesce(F.lead("at").over(w) - 1, F.size("dates") - 1)
    rows = rows.withColumns({"from": start.cast("int"), "to": stop.cast("int")})
    rows = rows.withColumn("step", F.explode(F.sequence("from", "to")))
    own = F.col("step") == F.col("at")
    value = lambda c: F.when(own, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    first = F.element_at("dates", 1)
    date = F.get("dates", F.col("step"))
    gap = F.when(F.col("step") > 0, F.datediff(date, F.get("dates", F.col("step") - 1)))
    gap = gap.when(F.size("dates") > 1, F.datediff(F.get("dates", F.lit(1)), first)).otherwise(30).cast("double")
    grid = rows.select(
        *ENTITY, "role", "step", date.alias("date"), F.datediff(date, first).cast("double").alias("t_days"),
        gap.alias("dt_days"), F.size("dates").alias("n_steps"),
        value("q_oil").alias("oil"), value("q_water").alias("water"), value("q_gas").alias("gas"),
        value("q_inj").alias("inj_s"), value("days_on").alias("days_on"),
    )
    rate = F.when(F.col("role") == "P", F.col("oil") + F.col("water")).otherwise(F.col("inj_s"))
    on = F.when((F.col("days_on") <= 0) & (rate > 0), F.col("dt_days")).otherwise(F.col("days_on"))
    return grid.withColumn("days_on", on)


def reservoir_grid(grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Add reservoir-volume liquid for producers and injection for injectors."""
    liq = F.when(F.col("role") == "P", liquid_constant_pvt(F.col("oil"), F.col("water"), F.col("gas"), cfg))
    return grid.withColumn("liq", liq).withColumn("inj", F.when(F.col("role") == "I", F.col("inj_s") * cfg.bw))


def build_grid(entity_rates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return reservoir_grid(densify(entity_rates, cfg), cfg)


def pivot_wide(grid: DataFrame, value: str, entities: list[str]) -> DataFrame:
    """A reporting matrix: one column per named entity."""
    part = grid.where(F.col("entity").isin(*entities))
    return part.groupBy("field", "date").pivot("entity", entities).agg(F.first(value))


def pivot_pages(grid: DataFrame, value: str, width: int = 8) -> DataFrame:
    """The reporting matrix of every entity, in pages of ``width`` columns: field, date, page, e0.. (names), v0.. (values).

    Entities of a field are numbered by name; a page is as wide for a field of ten wells as for one of a million. A cell
    without a row is null, name and value. Dates that a whole page lacks have no row in it.
    """
    names = grid.select("field", "entity").distinct()
    numbered = names.withColumn("_k", F.row_number().over(Window.partitionBy("field").orderBy("entity")) - 1)
    rows = grid.select("field", "date", "entity", F.col(value).alias("_v")).join(numbered, ["field", "entity"])
    here = lambda c, i: F.max(F.when(F.col("_k") % width == i, F.col(c)))
    cells = [here("entity", i).alias(f"e{i}") for i in range(width)] + [here("_v", i).alias(f"v{i}") for i in range(width)]
    return rows.groupBy("field", "date", F.floor(F.col("_k") / width).cast("int").alias("page")).agg(*cells)


def entity_coords(entities: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates of each entity's well; ``usable`` is false for a field where any entity lacks them."""
    known = coords.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "field", F.col("well").alias("base"), "x", "y"
    )
    e = entities.select("field", "entity", "role", base_well(F.col("entity")).alias("base")).join(
        known, ["field", "base"], "left"
    )
    missing = e.groupBy("field").agg(F.count_if(F.col("x").isNull()).alias("n_missing"))
    return e.join(missing, "field").select(
        "field", "entity", "role", F.col("base").alias("well"), "x", "y", (F.col("n_missing") == 0).alias("usable")
    )


def window_slice(grid: DataFrame, start, stop) -> DataFrame:
    """Steps [start, stop) re-based to the slice's first step; ``start`` and ``stop`` may be columns."""
    part = grid.where((F.col("step") >= start) & (F.col("step") < stop))
    w = Window.partitionBy(*ENTITY).orderBy("step")
    dt = F.when(F.row_number().over(w) == 1, F.coalesce(F.lead("dt_days").over(w), F.col("dt_days"))).otherwise(
        F.col("dt_days")
    )
    return (
        part.withColumn("dt_days", dt)
        .withColumn("t_days", F.col("t_days") - F.min("t_days").over(Window.partitionBy(*ENTITY)))
        .withColumn("step", (F.col("step") - start).cast("int"))
        .withColumn("n_steps", (F.least(F.lit(stop), F.col("n_steps")) - start).cast("int"))
    )


def active_entities(grid: DataFrame, min_steps: int = 3) -> DataFrame:
    """Keep entities with enough active steps and some volume.  A window over the entity keeps the partitioning."""
    w = Window.partitionBy(*ENTITY)
    rate = F.coalesce("liq", "inj")
    return (
        grid.withColumn("_on", F.sum((F.col("days_on") > 0).cast("int")).over(w))
        .withColumn("_vol", F.sum(rate).over(w))
        .where((F.col("_on") >= min_steps) & (F.col("_vol") > 0))
        .drop("_on", "_vol")
    )


def field_collapse(grid: DataFrame, bhp: str | None = None) -> DataFrame:
    """Field totals per step as one injector and one producer."""
    prod = F.col("role") == "P"
    liq = F.coalesce("liq", F.lit(0.0))
    aggs = [
        F.sum(F.coalesce("inj", F.lit(0.0))).alias("inj"), F.sum(liq).alias("liq"),
        F.sum(F.when(prod, F.col("oil")).otherwise(0.0)).alias("oil"),
        F.sum(F.when(prod, F.col("water")).otherwise(0.0)).alias("water"),
        F.max(F.when(prod, F.col("days_on"))).alias("days_on_prod"),
        F.max(F.when(~prod, F.col("days_on"))).alias("days_on_inj"),
    ]
    if bhp:
        weight = F.greatest(liq, F.lit(0.0))
        aggs += [
            F.sum(F.when(prod, F.col(bhp) * weight)).alias("_pw"), F.sum(F.when(prod, weight)).alias("_w"),
            F.avg(F.when(prod, F.col(bhp))).alias("_p"),
        ]
    out = grid.groupBy("field", "step", "date", "t_days", "dt_days", "n_steps").agg(*aggs)
    if bhp:
        out = out.withColumn("bhp", F.when(F.col("_w") > 0, F.col("_pw") / F.col("_w")).otherwise(F.col("_p")))
        out = out.drop("_pw", "_w", "_p")
    return out


def add_water_cut(grid: DataFrame) -> DataFrame:
    return grid.withColumn("water_cut", safe_div(F.col("water"), F.col("oil") + F.col("water")))
