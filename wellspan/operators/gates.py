"""Data profile, gates and which model variants may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import safe_div
from wellspan.functions.quantiles import ordered_values
from wellspan.functions.units import water_cut


def n_blind(n_steps: Column, cfg: Settings = DEFAULTS) -> Column:
    """Held-out steps: a share rounded half to even, a minimum, and at least two training steps left."""
    share = F.rint(n_steps * cfg.blind_fraction)
    return F.least(F.greatest(F.lit(cfg.min_blind_steps), share), F.greatest(F.lit(0), n_steps - 2)).cast("int")


def blind_split(axis: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    s = axis.groupBy("field").agg(F.count(F.lit(1)).alias("n_total"))
    return s.select("field", (F.col("n_total") - n_blind(F.col("n_total"), cfg)).cast("int").alias("n_train"),
                    n_blind(F.col("n_total"), cfg).alias("n_blind"), "n_total")


def injection_cv(grid: DataFrame) -> DataFrame:
    """Variation of injection over the active steps of each injector; an injector without one has zero."""
    act = F.when(F.col("days_on") > 0, F.col("inj"))
    g = grid.where(F.col("role") == "I").groupBy("field", "entity").agg(F.avg(act).alias("m"), F.stddev_pop(act).alias("s"))
    return g.select("field", "entity", F.coalesce(safe_div(F.col("s"), F.col("m")), F.lit(0.0)).alias("cv"))


def n_params(ni: Column, np_: Column, has_bhp: bool) -> tuple[Column, Column]:
    extra = 4 if has_bhp else 3
    return np_ * (ni + extra), F.lit(extra) * ni * np_


def support_ratio(grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Produced over injected reservoir volume on the training steps; infinite without injection."""
    train = F.col("step") < F.col("n_steps") - n_blind(F.col("n_steps"), cfg)
    vol = grid.where(train).groupBy("field").agg(
        F.sum(F.coalesce("liq", F.lit(0.0)) * F.col("dt_days")).alias("q"),
        F.sum(F.coalesce("inj", F.lit(0.0)) * F.col("dt_days")).alias("i"),
    )
    ratio = F.when(F.col("i") > 0, F.col("q") / F.col("i")).otherwise(F.lit(float("inf")))
    return vol.select("field", F.col("q").alias("produced"), F.col("i").alias("injected"), ratio.alias("support_ratio"))


def data_profile(grid: DataFrame, coords_usable: DataFrame, has_bhp: bool = False, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row of facts per field."""
    prod = F.col("role") == "P"
    on = prod & (F.col("days_on") > 0)
    facts = grid.groupBy("field").agg(
        F.max("n_steps").alias("n_steps"),
        F.count_if((~prod) & (F.col("step") == 0)).alias("n_inj"), F.count_if(prod & (F.col("step") == 0)).alias("n_prod"),
        F.avg(F.when(F.col("step") > 0, F.col("dt_days"))).alias("dt_tail"), F.avg("dt_days").alias("dt_all"),
        F.count_if(on).alias("points_available"),
        F.avg(F.when(on, water_cut(F.col("oil"), F.col("water")))).alias("mean_wc"),
    )
    cv = injection_cv(grid).groupBy("field").agg(F.min("cv").alias("inj_cv_min"), F.avg("cv").alias("inj_cv_mean"))
    f = facts.join(cv, "field", "left").join(support_ratio(grid, cfg).select("field", "support_ratio"), "field")
    f = f.join(coords_usable.groupBy("field").agg(F.bool_and("usable").alias("has_xy")), "field", "left")
    crmp, crmip = n_params(F.col("n_inj"), F.col("n_prod"), has_bhp)
    f = f.withColumns({"n_params_producer": crmp, "n_params_pair": crmip, "dt_days": F.coalesce("dt_tail", "dt_all")})
    return f.select(
        "field", "n_steps", "n_inj", "n_prod", "dt_days", (F.col("n_steps") / (F.col("n_inj") + 1)).alias("od"),
        "n_params_producer", "n_params_pair", "points_available",
        safe_div(F.col("points_available"), F.col("n_params_producer")).alias("ratio_producer"),
        safe_div(F.col("points_available"), F.col("n_params_pair")).alias("ratio_pair"),
        F.coalesce("inj_cv_min", F.lit(0.0)).alias("inj_cv_min"), F.coalesce("inj_cv_mean", F.lit(0.0)).alias("inj_cv_mean"),
        F.coalesce("mean_wc", F.lit(0.0)).alias("mean_water_cut"), F.coalesce("has_xy", F.lit(False)).alias("has_xy"),
        F.lit(has_bhp).alias("has_bhp"), (F.col("dt_days") >= 28.0).alias("monthly_allocated"), "support_ratio",
    )


def flank_signature(sums: DataFrame, value: str = "sum_f", cfg: Settings = DEFAULTS) -> DataFrame:
    """Producers whose sum exceeds a floor and a multiple of the median of the others.

    The median without one member depends only on the values at three ranks of the whole group and on which side of
    them the member lies, so it needs no self-join.
    """
    at = ordered_values(
        sums, ["field"], value,
        {"below": lambda n: F.floor(n / 2) - 1, "mid": lambda n: F.floor(n / 2), "above": lambda n: F.floor(n / 2) + 1},
    )
    s = sums.join(at, "field").where(F.col("n") >= 3)
    v = F.col(value)
    # odd n: the others are even in number; even n: the others are odd in number
    odd = F.when(v < F.col("mid"), (F.col("mid") + F.col("above")) / 2).when(
        v > F.col("mid"), (F.col("below") + F.col("mid")) / 2
    ).otherwise((F.col("below") + F.col("above")) / 2)
    even = F.when(v <= F.col("below"), F.col("mid")).otherwise(F.col("below"))
    s = s.withColumn("median_others", F.when(F.col("n") % 2 == 1, odd).otherwise(even))
    flank = (v > cfg.flank_sum_f_min) & (F.col("median_others") > 0) & (v > cfg.flank_over_median_min * F.col("median_others"))
    return s.select("field", "entity", F.col(value), "median_others", flank.alias("is_flank"))


def run_gates(profile: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Gate columns from a profile that also has tau_over_dt, max_injector_sum, events_per_well and has_relperm."""
    ratio, c = F.col("tau_over_dt"), F.col
    influx = F.coalesce(c("support_ratio") > cfg.sum_f_aquifer, F.lit(False)) | (
        F.coalesce(c("max_injector_sum"), F.lit(0.0)) > cfg.injector_sum_f_max
    )
    return profile.withColumns({
        "g_history_min": c("n_steps") >= cfg.min_steps_hard,
        "g_od": c("od") > cfg.od_min,
        "g_points_per_param": c("ratio_producer") >= cfg.points_per_param_min,
        "g_pair_data": c("ratio_pair") >= cfg.points_per_param_floor,
        "g_inj_cv": c("inj_cv_min") >= cfg.inj_cv_min,
        "g_tau_dt": ratio.isNull() | (ratio >= cfg.tau_over_dt_min),
        "g_influx": influx,
        "g_event_heavy": c("events_per_well") >= cfg.events_per_well_crossflow,
        "g_mature": c("mean_water_cut") >= cfg.water_cut_mature,
        "g_long_history": c("n_steps") >= cfg.history_long_min,
        "g_has_xy": c("has_xy"),
        "g_has_bhp": c("has_bhp"),
    })


def gates_long(gated: DataFrame) -> DataFrame:
    names = [c for c in gated.columns if c.startswith("g_")]
    out = gated.unpivot(["field"], names, "gate", "passed")
    return out.withColumn("gate", F.substring("gate", 3, 100))


VARIANTS = ("crmt", "crmp", "aquifer")


def eligibility(gated: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per field and model variant: eligible, suitability and the reason.

    Variants outside ``VARIANTS`` are rated by the same rules but marked as not available.
    """
    c, f1, f2 = F.col, lambda x: F.format_string("%.1f", x), lambda x: F.format_string("%.2f", x)
    od, rp, rip = c("od"), c("ratio_producer"), c("ratio_pair")
    rich, influx, heavy = c("g_inj_cv"), c("g_influx"), c("g_event_heavy")
    no = lambda reason: F.struct(F.lit(False).alias("eligible"), F.lit(0.0).alias("suitability"), reason.alias("reason"))
    yes = lambda s, reason: F.struct(F.lit(True).alias("eligible"), F.round(s, 6).alias("suitability"), reason.alias("reason"))
    text, num = F.lit, lambda x: F.lit(float(x))
    pick = lambda cond, a, b: F.when(cond, num(a)).otherwise(num(b))
    crmp_s = (
        num(0.6) + pick(od > cfg.od_min, 0.15, -0.15) + pick(rp >= cfg.points_per_param_min, 0.1, 0.0)
        + pick(rich, 0.05, -0.1) - pick(influx, 0.1, 0.0) - pick(heavy, 0.1, 0.0)
    )
    crmp_why = F.concat_ws(
        "; ",
        F.when(od > cfg.od_min, F.concat(text("observability "), f1(od))).otherwise(F.concat(text("low observability "), f1(od))),
        F.when(rp >= cfg.points_per_param_min, text("enough points")).otherwise(F.concat(text("points per parameter "), f1(rp))),
        F.when(rich, text("rich injection signal")).otherwise(text("flat injection signal")),
        F.when(influx, text("influx suspected")), F.when(heavy, text("frequent events")),
    )
    pair_s = num(0.45) + pick(rip >= cfg.points_per_param_min, 0.2, 0.0) + pick(rich, 0.1, -0.15)
    rules = {
        "mpi": F.when(~c("g_has_xy"), no(text("no coordinates"))).otherwise(yes(num(0.45), text("geometric prior"))),
        "mlr": F.when(od < cfg.od_regression_floor, no(F.concat(text("observability "), f1(od), text(" under 3")))).otherwise(
            yes(num(0.35) + pick(od > cfg.od_min, 0.15, 0.0), text("screening only"))
        ),
        "crmt": F.when(~c("g_history_min"), no(text("history too short"))).otherwise(
            yes(num(0.55) + pick(rich, 0.0, 0.1) + pick(od < cfg.od_min, 0.15, 0.0), text("always identifiable"))
        ),
        "crmp": F.when(rp < 1, no(text("fewer points than parameters"))).otherwise(yes(F.least(num(1.0), crmp_s), crmp_why)),
        "crmip": F.when(rip < 1, no(text("fewer points than parameters"))).when(
            ~c("g_pair_data"), no(F.concat(text("points per parameter "), f1(rip)))
        ).otherwise(yes(F.least(num(1.0), pair_s), text("pair-level structure"))),
        "aquifer": F.when(~influx, no(text("no influx signature"))).when(
            rp < cfg.points_per_param_floor, no(text("not enough data"))
        ).otherwise(yes(num(0.8), text("external support"))),
        "twophase": F.when(c("g_mature"), no(F.concat(text("mean water cut "), f2(c("mean_water_cut"))))).when(
            ~c("has_relperm"), no(text("no saturation curve"))
        ).otherwise(yes(num(0.78), text("water cut still rising"))),
        "crossflow": F.when(~heavy, no(text("few events"))).when(~c("g_has_bhp"), no(text("no flowing pressure"))).otherwise(
            yes(num(0.72), text("allocation drifts with events"))
        ),
        "pinn": F.when(~c("g_long_history"), no(text("history under 120 steps"))).when(
            od < cfg.od_min, no(text("base model not identifiable"))
        ).otherwise(yes(num(0.5) + pick(heavy, 0.15, 0.0), text("only if residuals show structure"))),
        "rnn": no(text("not interpretable")),
    }
    rows = F.array(*[
        F.struct(text(v).alias("variant"), r["eligible"].alias("eligible"), r["suitability"].alias("suitability"),
                 F.lit(v in VARIANTS).alias("available"), r["reason"].alias("reason"))
        for v, r in rules.items()
    ])
    return gated.select("field", F.explode(rows).alias("r")).select("field", "r.*")
