"""Forecast of producers over an injection plan from the state at the end of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import clip, safe_div
from wellspan.functions.response import exp_filter
from wellspan.operators.oilcut import eval_wor_power

PROD = ["field", "producer"]


def calendar(last: DataFrame, months: int) -> DataFrame:
    """First-of-month dates after the last one: field, h, date, dt_days, t_cum.  last: field, last_date."""
    c = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(months))))
    month = F.trunc("last_date", "MM")
    date, prev = F.add_months(month, F.col("h")), F.add_months(month, F.col("h") - 1)
    dt = F.when(F.col("h") == 1, F.datediff(date, "last_date")).otherwise(F.datediff(date, prev))
    return c.select(
        "field", "h", date.alias("date"), dt.cast("double").alias("dt_days"), F.datediff(date, "last_date").cast("double").alias("t_cum")
    )


def expand_plan(blocks: DataFrame, n_blocks: int, horizon: int) -> DataFrame:
    """Piecewise-constant blocks to monthly steps: block k covers [floor(H k / P), floor(H (k + 1) / P))."""
    k = F.col("block")
    lo, hi = F.floor(horizon * k / n_blocks).cast("int"), F.floor(horizon * (k + 1) / n_blocks).cast("int")
    b = blocks.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_hi") > F.col("_lo"))
    return b.withColumn("h", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi")))).drop("_lo", "_hi")


def redistribution_at_end(pairs: DataFrame, active: DataFrame, keys: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Multiplier per injector while the producers closed at the end of history stay closed."""
    p = pairs.join(active, PROD).groupBy(*keys, "injector").agg(
        F.sum("f").alias("tot"), F.sum(F.when(F.col("active"), F.col("f")).otherwise(0.0)).alias("open_sum")
    )
    g = F.when(F.col("open_sum") > 1e-12, F.col("tot") / F.greatest("open_sum", F.lit(1e-12))).otherwise(1.0)
    return p.select(*keys, "injector", F.least(g, F.lit(max(1.0, cfg.shut_in_max_multiplier))).alias("g"))


def plan_sources(
    plan: DataFrame, pairs: DataFrame, g: DataFrame, plan_keys: list[str], member: str = "member", producers: DataFrame | None = None
) -> DataFrame:
    """Source and allocated support per plan, member and producer.  plan: plan_keys (with field), injector, rate[, h].

    ``producers`` (field, member, producer) adds those without any coupled injector, with a zero source. A pair is dealt to its
    producer with all members and plans in one row, and unfolded there.
    """
    extra = ["h"] if "h" in plan.columns else []
    k = [*plan_keys, member, "producer", *extra]
    named = [c for c in [*plan_keys, *extra] if c != "field"]
    rates = plan.groupBy("field", "injector").agg(F.collect_list(F.struct(*named, "rate")).alias("_plans"))
    if "_shares" not in pairs.columns:
        pairs = injector_shares(pairs, g, member)
    rows = pairs.join(rates, ["field", "injector"]).select("field", "producer", "_shares", "_plans")
    if producers is not None:
        none = F.struct(member, F.lit(0.0).alias("f"), F.lit(0.0).alias("g"))
        idle = producers.groupBy("field", "producer").agg(F.collect_list(none).alias("_shares"))
        still = plan.select("field", *named).distinct().groupBy("field").agg(F.collect_list(F.struct(*named, F.lit(0.0).alias("rate"))).alias("_plans"))
        rows = rows.unionByName(idle.join(still, "field"))
    rows = rows.repartition("field", "producer").withColumn("_m", F.explode("_shares")).withColumn("_p", F.explode("_plans"))
    v = F.col("_m.f") * F.col("_p.rate")
    rows = rows.select("field", "producer", f"_m.{member}", *[f"_p.{c}" for c in named], (v * F.col("_m.g")).alias("source"), v.alias("support"))
    return rows.groupBy(*k).agg(F.sum("source").alias("source"), F.sum("support").alias("support"))


def injector_shares(pairs: DataFrame, g: DataFrame, member: str = "member") -> DataFrame:
    """One row per pair with the couplings and multipliers of its members: field, injector, producer, _shares. ``plan_sources`` takes
    them in place of pairs, so that a search puts them together once."""
    rows = pairs.join(g, ["field", member, "injector"])
    return rows.groupBy("field", "injector", "producer").agg(F.collect_list(F.struct(member, "f", "g")).alias("_shares"))


def dealt(rows: DataFrame, member: str = "member") -> DataFrame:
    """Rows dealt to their producers for ``simulate``: few bytes but much work each, so as many tasks as a shuffle has, which Spark does not merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field", member, "producer")


def simulate(sources: DataFrame, state: DataFrame, cal: DataFrame, plan_keys: list[str], member: str = "member") -> DataFrame:
    """Monthly forecast per plan, member and producer.

    state: field, member, producer, x0, tau, gain_p, tau_p, q0, age (days from the producer's start to the end of
    history), cwi0, ratio, level, active, alpha, beta, offset, anchor.  A source that is constant over the horizon has
    a closed form and needs no window; a monthly one goes through the response filter. Constant ``sources`` keep the tasks that ``dealt``
    gives them, and the months of their field come to them.
    """
    k = [*plan_keys, member, "producer"]
    e = F.exp(-F.col("t_cum") / F.col("tau"))
    if "h" not in sources.columns:
        months = cal.groupBy("field").agg(F.collect_list(F.struct("h", "date", "dt_days", "t_cum")).alias("cal"))
        r = sources.join(state, ["field", member, "producer"]).join(F.broadcast(months), "field")
        r = r.withColumn("c", F.explode("cal")).drop("cal").select("*", "c.h", "c.date", "c.dt_days", "c.t_cum").drop("c")
        moved = F.col("x0") * e + F.col("source") * (1.0 - e)
        r = r.withColumn("x", F.when(F.col("active"), moved).otherwise(F.col("x0")))
        r = r.withColumn("cwi", F.col("cwi0") + F.col("support") * F.col("t_cum"))
    else:
        r = sources.join(cal, ["field", "h"])
        start = r.groupBy(*k).agg(F.lit(0).alias("h")).withColumns({"source": F.lit(0.0), "support": F.lit(0.0), "dt_days": F.lit(0.0), "t_cum": F.lit(0.0)})
        r = r.unionByName(start, allowMissingColumns=True).join(state, ["field", member, "producer"])
        r = exp_filter(r, k, F.col("source"), F.col("tau"), "x", F.col("active"), order="h", initial=F.col("x0"))
        w = Window.partitionBy(*k).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        r = r.withColumn("cwi", F.col("cwi0") + F.sum(F.col("support") * F.col("dt_days")).over(w)).where(F.col("h") > 0)
    prim = F.col("gain_p") * F.col("q0") * F.exp(-(F.col("age") + F.col("t_cum")) / F.col("tau_p"))
    liq = F.greatest(F.col("x") + prim, F.lit(0.0)) * F.coalesce("level", F.lit(1.0)) * F.col("active").cast("double")
    r = r.withColumn("liq", liq)
    return oil_and_water(r).select(*k, "h", "date", "dt_days", "t_cum", "cwi", "liq", "oil", "water")


def oil_and_water(r: DataFrame) -> DataFrame:
    """Oil cut from the fitted curve, rescaled through the observed level; a collapsed curve holds the level."""
    fo = eval_wor_power(F.col("alpha"), F.col("beta"), F.col("offset"), F.col("cwi"))
    end = eval_wor_power(F.col("alpha"), F.col("beta"), F.col("offset"), F.col("cwi0"))
    a = F.col("anchor")
    scaled = F.when((end > 1e-3) & (end < 0.999), clip(fo * (a / end), 0.0, 1.0)).otherwise(a)
    cut = F.when(F.col("alpha").isNull(), F.coalesce(a, F.lit(0.5))).when(a.isNull(), fo).otherwise(scaled)
    surface = F.col("liq") * F.col("ratio")
    r = r.withColumn("oil", surface * cut)
    return r.withColumn("water", F.greatest(surface - F.col("oil"), F.lit(0.0)))


def forecast_totals(fc: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative oil and water and the water cut over the horizon."""
    s = fc.groupBy(*keys).agg(
        F.sum(F.col("oil") * F.col("dt_days")).alias("cum_oil"), F.sum(F.col("water") * F.col("dt_days")).alias("cum_water"),
        F.sum(F.col("liq") * F.col("dt_days")).alias("cum_liq"),
    )
    return s.withColumn("water_cut", safe_div(F.col("cum_water"), F.col("cum_oil") + F.col("cum_water")))


def _band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    b = df.groupBy(*keys).agg(q.alias("q"))
    return b.select(*keys, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def producer_fan(fc: DataFrame, plan_keys: list[str]) -> DataFrame:
    return _band(fc, [*plan_keys, "producer", "h"], "oil")


def field_fan(fc: DataFrame, plan_keys: list[str], member: str = "member") -> DataFrame:
    """Field band: producers are summed inside each member before the percentiles."""
    tot = fc.groupBy(*plan_keys, member, "h").agg(F.sum("oil").alias("oil"))
    return _band(tot, [*plan_keys, "h"], "oil")


def cumulative_fan(fc: DataFrame, plan_keys: list[str], member: str = "member") -> DataFrame:
    tot = forecast_totals(fc, [*plan_keys, member])
    return _band(tot, plan_keys, "cum_oil")


def rolling_blend_params(member_pairs: DataFrame, last: DataFrame, weights: DataFrame) -> DataFrame:
    """Members' couplings mixed with the latest window.  last: field, injector, producer, f; weights: field, w_last."""
    k = ["field", "injector", "producer"]
    p = member_pairs.join(last.withColumnRenamed("f", "f_last"), k, "left").join(weights, "field")
    mixed = F.col("w_last") * F.coalesce("f_last", F.lit(0.0)) + (1.0 - F.col("w_last")) * F.col("f")
    return p.withColumn("f", mixed).drop("f_last", "w_last")
