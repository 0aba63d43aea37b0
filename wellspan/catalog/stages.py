"""Intermediate tables shared by queries, written once per session and folder to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan.catalog.base import raw_grid
from wellspan.functions.response import exp_filter
from wellspan.operators import fit, gates, sectors
from wellspan.session import cut_lineage
from wellspan.sources.bindings import Tables

_DONE: dict[tuple, DataFrame] = {}

LENGTH, CUTOFF, ROW_SUM = 1.5, 3.0, 0.8
MEMBERS = 5


def stage(t: Tables, name: str, build) -> DataFrame:
    key = (t.spark.sparkContext.applicationId, t.dir, name)
    if key not in _DONE:
        _DONE[key] = cut_lineage(build())
    return _DONE[key]


def grid(t: Tables) -> DataFrame:
    return stage(t, "grid", lambda: raw_grid(t))


def entities(t: Tables) -> DataFrame:
    """One row per entity with coordinates."""
    e = grid(t).where(F.col("step") == 0).select("field", "well", "entity", "role")
    return stage(t, "entities", lambda: e.join(t.coords().select("field", "well", "x", "y"), ["field", "well"]))


def pairs(t: Tables) -> DataFrame:
    """Couplings used where an operator is given parameters: the distance prior."""
    return stage(t, "pairs", lambda: sectors.influence_distance_prior(entities(t), scale(t), ROW_SUM))


def scale(t: Tables) -> DataFrame:
    """Decay length and cutoff per field."""
    near = stage(t, "near", lambda: sectors.nearest_both(entities(t)))
    return stage(t, "scale", lambda: sectors.influence_scale(near, LENGTH, CUTOFF))


def tau_of(well):
    return (60 + 30 * (F.substring(well, 3, 20).cast("int") % 5)).cast("double")


def params(t: Tables) -> DataFrame:
    e = entities(t).where(F.col("role") == "P")
    tau = tau_of(F.col("well"))
    return e.select("field", F.col("entity").alias("producer"), tau.alias("tau"), F.lit(1.0).alias("gain_p"), tau.alias("tau_p"))


def member_pairs(t: Tables) -> DataFrame:
    m = F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))
    return pairs(t).withColumn("member", m).withColumn("f", F.col("f") * (0.9 + 0.05 * F.col("member")))


def member_params(t: Tables) -> DataFrame:
    m = F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))
    k = 0.8 + 0.1 * F.col("member")
    return params(t).withColumn("member", m).withColumns({"tau": F.col("tau") * k, "tau_p": F.col("tau_p") * k})


def predictions(t: Tables) -> DataFrame:
    """Fitted history of the five members."""
    return stage(
        t, "pred", lambda: fit.predict_history(grid(t), member_pairs(t), member_params(t), ["member"])
    )


def n_train(t: Tables) -> DataFrame:
    n = grid(t).groupBy("field").agg(F.max("n_steps").alias("n"))
    return stage(t, "n_train", lambda: n.select("field", (F.col("n") - gates.n_blind(F.col("n"))).cast("int").alias("n_train")))


def tank_rows(t: Tables) -> DataFrame:
    """Field totals with a known injection response laid over the real production noise."""
    return stage(t, "tank_rows", lambda: _tank_rows(t))


def response(t: Tables) -> DataFrame:
    """Producer liquid with a known response: primary decline plus the filtered prior couplings, with the share of closed
    producers passed on; no noise."""
    return stage(t, "response", lambda: _response(t))


def _tank_rows(t: Tables) -> DataFrame:
    g = grid(t)
    tot = g.groupBy("field", "step", "t_days", "dt_days").agg(
        F.sum(F.coalesce("inj", F.lit(0.0))).alias("inj"), F.sum(F.coalesce("liq", F.lit(0.0))).alias("raw")
    )
    no = t.read("region").select(F.col("r_name").alias("field"), F.col("r_regionkey").alias("no"))
    tot = tot.join(no, "field").withColumn("tau0", (60 + 30 * F.col("no")).cast("double"))
    tot = exp_filter(tot.repartition("field"), ["field"], F.col("inj"), F.col("tau0"), "x0")
    mean = g.groupBy("field").agg((F.sum(F.coalesce("liq", F.lit(0.0))) / F.max("n_steps")).alias("mean_raw"))
    q = 200.0 * F.exp(-F.col("t_days") / F.col("tau0")) + 0.6 * F.col("x0") + 0.02 * (F.col("raw") - F.col("mean_raw"))
    out = tot.join(mean, "field").withColumn("q", q)
    first = out.where(F.col("step") == 0).select("field", F.col("q").alias("q0"))
    return out.join(first, "field").join(n_train(t), "field").select(
        "field", "step", "t_days", "dt_days", "inj", "q", "q0", F.lit(1.0).alias("w"), "n_train"
    )


def _response(t: Tables) -> DataFrame:
    g = grid(t)
    prod, inj = fit.producer_rows(g), fit.injector_rows(g)
    src = fit.allocated_source(pairs(t), inj, ["field"], fit.shutin_redistribution(pairs(t), prod, ["field"]))
    rows = prod.join(params(t), fit.PROD).join(src, [*fit.PROD, "step"], "left").repartition("field", "producer")
    first = F.min(F.when(F.col("on"), F.col("step")))
    starts = prod.groupBy(*fit.PROD).agg(first.alias("start"))
    rows = rows.join(starts, fit.PROD).where(F.col("step") >= F.col("start"))
    rows = exp_filter(rows, fit.PROD, F.coalesce("support", F.lit(0.0)), F.col("tau"), "x", F.col("on"))
    t0 = rows.groupBy(*fit.PROD).agg(F.min("t_days").alias("t0"))
    rows = rows.join(t0, fit.PROD)
    q = F.when(F.col("on"), 60.0 * F.exp(-(F.col("t_days") - F.col("t0")) / F.col("tau")) + F.col("x")).otherwise(0.0)
    return rows.select(*fit.PROD, "step", "date", "t_days", "dt_days", "n_steps", "on", q.alias("liq"), F.col("on").cast("double").alias("w"))
