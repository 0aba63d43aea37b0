"""Events on the grid: steps, breaks, history windows, shut-ins and fit weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.text import base_well
from wellspan.operators.grid import ENTITY


def event_step(events: DataFrame, dates: DataFrame) -> DataFrame:
    """First grid step at or after the event (the number of steps when there is none).

    The dates of a field travel as one array bounded by the history, so no range join is needed.
    """
    d = F.col("date")
    return (
        events.join(dates, "field")
        .withColumn("step", F.size(F.filter("dates", lambda g: g < d)))
        .withColumn("n_steps", F.size("dates"))
        .drop("dates")
    )


def break_points(events: DataFrame, dates: DataFrame, cfg: Settings = DEFAULTS, order_col: str = "seq") -> DataFrame:
    """Steps where history breaks; the first event in input order names the reason."""
    at = event_step(events.where(F.col("date").isNotNull()), dates)
    at = at.where(F.upper("type").isin(*cfg.break_types) & (F.col("step") > 0) & (F.col("step") < F.col("n_steps")))
    reason = F.concat(F.col("type"), F.lit(" at "), F.col("well"), F.lit(" ("), F.col("date").cast("string"), F.lit(")"))
    return at.groupBy("field", "step", "n_steps").agg(
        F.min_by(reason, F.struct(F.col(order_col), F.col("well"), F.col("type"))).alias("reason")
    )


def history_windows(breaks: DataFrame, dates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Consecutive windows between breaks, short ones merged.  Breaks per field are bounded by the number of steps,
    so the merge is a fold over one small array per field."""
    m = cfg.min_window_steps
    per_field = breaks.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("step", "reason"))).alias("cuts"))
    base = dates.select("field", F.size("dates").alias("n")).join(per_field, "field", "left")
    none = F.array().cast("array<struct<step:int,reason:string>>")
    cuts = F.coalesce("cuts", none)
    opening = F.array(F.struct(F.lit(0).alias("step"), F.lit("full history").alias("reason")))
    starts = F.concat(opening, F.transform(cuts, lambda c: F.struct(c["step"].alias("step"), F.concat(F.lit("after "), c["reason"]).alias("reason"))))
    base = base.withColumn("starts", starts)
    raw = F.transform(
        "starts",
        lambda s, i: F.struct(
            s["step"].alias("a"), F.coalesce(F.get("starts", i + 1)["step"], F.col("n")).alias("b"), s["reason"].alias("reason")
        ),
    )

    def step(acc, w):
        last = F.element_at(acc, -1)
        kept = F.slice(acc, 1, F.size(acc) - 1)
        short = w["b"] - w["a"] < m
        into_last = F.concat(kept, F.array(F.struct(last["a"].alias("a"), w["b"].alias("b"), last["reason"].alias("reason"))))
        over_last = F.concat(kept, F.array(F.struct(last["a"].alias("a"), w["b"].alias("b"), w["reason"].alias("reason"))))
        return (
            F.when(F.size(acc) == 0, F.array(w)).when(short, into_last)
            .when(last["b"] - last["a"] < m, over_last).otherwise(F.concat(acc, F.array(w)))
        )

    empty = F.array().cast("array<struct<a:int,b:int,reason:string>>")
    merged = F.aggregate(raw, empty, step)
    out = base.select("field", F.posexplode(merged).alias("window_id", "w"))
    return out.select("field", "window_id", F.col("w.a").alias("step_from"), F.col("w.b").alias("step_to"), "w.reason")


def events_per_well(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events per entity of the field; zero where there are none."""
    n_events = events.groupBy("field").agg(F.count(F.lit(1)).alias("n_events"))
    n_wells = entities.groupBy("field").agg(F.count_distinct("entity").alias("n_wells"))
    per = F.coalesce(F.col("n_events") / F.col("n_wells"), F.lit(0.0))
    return n_wells.join(n_events, "field", "left").select("field", per.alias("events_per_well"))


def lift_event_counts(events: DataFrame, producers: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Lift events of each producer's well."""
    counts = events.where(F.upper("type").isin(*cfg.lift_types)).groupBy("field", F.col("well").alias("base")).agg(
        F.count(F.lit(1)).alias("n")
    )
    p = producers.select("field", "entity", base_well(F.col("entity")).alias("base"))
    return p.join(counts, ["field", "base"], "left").select(
        "field", "entity", F.coalesce("n", F.lit(0)).alias("n_lift_events")
    )


def long_shutins(grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Closed spells of at least the given length, not at the start or the end of history."""
    p = grid.where(F.col("role") == "P").withColumn("off", F.col("days_on") <= 0)
    order = Window.partitionBy(*ENTITY).orderBy("step")
    p = p.withColumn("_chg", F.when(F.col("off") != F.lag("off").over(order), 1).otherwise(0))
    p = p.withColumn("_run", F.sum("_chg").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.where("off").groupBy(*ENTITY, "_run", "n_steps").agg(
        F.min("step").alias("step_from"), (F.max("step") + 1).alias("step_to"), F.min("date").alias("since")
    )
    long = F.col("step_to") - F.col("step_from") >= cfg.long_shutin_steps
    inner = (F.col("step_from") > 0) & (F.col("step_to") < F.col("n_steps"))
    return runs.where(long & inner).select(
        "field", "entity", "step_from", "step_to", (F.col("step_to") - F.col("step_from")).alias("months"), "since"
    )


def fit_weights(grid: DataFrame, half_life: float = 0.0, after_restart: int = 0, before_shutin: int = 0) -> DataFrame:
    """Weight per producer step: on-stream mask, age decay and switched-off transients."""
    p = grid.where(F.col("role") == "P")
    on = F.col("days_on") > 0
    order = Window.partitionBy(*ENTITY).orderBy("step")
    w = on.cast("double")
    if half_life > 0:
        w = w * F.pow(F.lit(0.5), (F.col("n_steps") - 1 - F.col("step")) / half_life)
    was_on = F.lag("days_on").over(order) > 0
    p = p.withColumn("_re", F.coalesce(on & ~was_on, F.lit(False)).cast("int"))
    p = p.withColumn("_si", F.coalesce(~on & was_on, F.lit(False)).cast("int"))
    p = p.withColumn("_w", w)
    cut = F.lit(False)
    if after_restart > 0:
        cut = cut | (F.max("_re").over(order.rowsBetween(-(after_restart - 1), 0)) > 0)
    if before_shutin > 0:
        cut = cut | (F.coalesce(F.max("_si").over(order.rowsBetween(1, before_shutin)), F.lit(0)) > 0)
    return p.withColumn("weight", F.when(cut, 0.0).otherwise(F.col("_w"))).drop("_re", "_si", "_w")
