"""Plans, bounds, what-if cases and the search over allocations.

A change at one injector only moves the producers coupled to it, so what-if cases are evaluated on those pairs and
added to the base, never by simulating the whole field once per well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.quantiles import group_quantile, ordered_values
from wellspan.plans.economics import posture_stat
from wellspan.plans.forecast import dealt, injector_shares, plan_sources, simulate

INJ = ["field", "injector"]


def plan_bounds(current: DataFrame, idle: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """0 up to a multiple of the mean of the injectors in use; idle ones stay at zero."""
    c = current.join(idle, INJ)
    m = c.groupBy("field").agg(
        F.avg(F.when(~F.col("idle"), F.col("rate"))).alias("mean_active"), F.avg("rate").alias("mean_all"),
        F.sum("rate").alias("total_water"),
    )
    hi = F.when(F.col("idle"), 0.0).otherwise(cfg.injector_max_multiple * F.coalesce("mean_active", "mean_all"))
    return c.join(m, "field").select(*INJ, "rate", "idle", F.lit(0.0).alias("lo"), hi.alias("hi"), "total_water")


def equal_split(current: DataFrame) -> DataFrame:
    m = current.groupBy("field").agg(F.avg("rate").alias("m"))
    return current.join(m, "field").select(*INJ, F.col("m").alias("rate"))


def plan_feasibility(plans: DataFrame, bounds: DataFrame, facts: DataFrame, limits: dict, tol: float = 1e-6) -> DataFrame:
    """Checks per plan.  plans: field, plan, injector, rate; facts: field, plan, max_water_cut, max_liquid, vrr, and the
    plan named ``base`` among them.  A limit the base already breaks is relaxed to the base's level."""
    b = plans.join(bounds.select(*INJ, "lo", "hi", "total_water"), INJ)
    water = b.groupBy("field", "plan").agg(
        F.sum("rate").alias("used"), F.max("total_water").alias("total_water"),
        F.bool_and((F.col("rate") >= F.col("lo") - tol) & (F.col("rate") <= F.col("hi") + tol)).alias("within_bounds"),
    )
    names = ["max_water_cut", "max_liquid", "vrr"]
    base = facts.where(F.col("plan") == "base").select("field", *[F.col(n).alias(f"base_{n}") for n in names])
    f = water.join(facts, ["field", "plan"]).join(base, "field")
    cut = F.col("max_water_cut") <= F.greatest(F.lit(limits["max_water_cut"]), F.col("base_max_water_cut")) + tol
    liq = F.col("max_liquid") <= F.greatest(F.lit(limits["max_liquid"]), F.col("base_max_liquid")) + tol
    lo, hi = limits["vrr"]
    vrr = (F.col("vrr") >= F.least(F.lit(lo), F.col("base_vrr")) - tol) & (F.col("vrr") <= F.greatest(F.lit(hi), F.col("base_vrr")) + tol)
    bal = F.abs(F.col("used") - F.col("total_water")) <= tol * F.greatest("total_water", F.lit(1.0))
    return f.select(
        "field", "plan", bal.alias("water_ok"), "within_bounds", cut.alias("water_cut_ok"), liq.alias("liquid_ok"), vrr.alias("vrr_ok"),
        (bal & cut & liq & vrr).alias("feasible"),
    )


def changed_oil(
    changes: DataFrame, current: DataFrame, pairs: DataFrame, g: DataFrame, base_sources: DataFrame, state: DataFrame, cal: DataFrame
) -> DataFrame:
    """Oil per case and member after a rate change, minus the base, over the producers the change reaches.

    changes: field, case, injector, delta. Pairs are dealt to their producers once, for the sums, the base and the simulation.
    """
    moved = changes.join(pairs, INJ).join(g, ["field", "member", "injector"])
    moved = dealt(moved.select("field", "case", "member", "producer", "f", "delta", "g"))
    v = F.col("f") * F.col("delta")
    d = moved.groupBy("field", "case", "member", "producer").agg(F.sum(v * F.col("g")).alias("ds"), F.sum(v).alias("dp"))
    src = d.join(base_sources.select("field", "member", "producer", "source", "support"), ["field", "member", "producer"])
    both = F.array(
        F.struct(F.lit(-1.0).alias("sign"), F.col("source").alias("source"), F.col("support").alias("support")),
        F.struct(F.lit(1.0).alias("sign"), (F.col("source") + F.col("ds")).alias("source"), (F.col("support") + F.col("dp")).alias("support")),
    )
    src = src.select("field", "case", "member", "producer", F.explode(both).alias("b")).select("field", "case", "member", "producer", "b.*")
    fc = simulate(src, state, cal, ["field", "case", "sign"])
    return fc.groupBy("field", "case", "member").agg(F.sum(F.col("sign") * F.col("oil") * F.col("dt_days")).alias("d_oil"))


def case_values(deltas: DataFrame, base_totals: DataFrame, posture: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Value of each case beside the base.  base_totals: field, member, cum_oil."""
    v = deltas.join(base_totals, ["field", "member"]).withColumn("v", F.col("cum_oil") + F.col("d_oil"))
    s = v.groupBy("field", "case").agg(posture_stat(F.col("v"), posture, cfg).alias("value"))
    base = base_totals.groupBy("field").agg(posture_stat(F.col("cum_oil"), posture, cfg).alias("base_value"))
    out = s.join(base, "field").withColumn("delta", F.col("value") - F.col("base_value"))
    pct = F.when(F.col("base_value") != 0, 100.0 * F.col("delta") / F.abs("base_value")).otherwise(0.0)
    return out.withColumn("delta_pct", pct)


def marginal_value(
    current: DataFrame, pairs: DataFrame, g: DataFrame, base_sources: DataFrame, state: DataFrame, cal: DataFrame,
    base_totals: DataFrame, posture: str, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Value gained per unit of rate at each injector by a small step."""
    m = current.groupBy("field").agg(F.avg("rate").alias("m"))
    h = F.greatest(1e-3 * F.greatest("m", F.lit(1.0)), F.lit(1e-6))
    ch = current.join(m, "field").select("field", F.col("injector").alias("case"), "injector", h.alias("delta"))
    d = changed_oil(ch, current, pairs, g, base_sources, state, cal)
    v = case_values(d, base_totals, posture, cfg).join(ch.select("field", "case", F.col("delta").alias("h")), ["field", "case"])
    return v.select("field", F.col("case").alias("injector"), (F.col("delta") / F.col("h")).alias("marginal"))


def plan_gains(values: DataFrame) -> DataFrame:
    """Percent gain of each plan over ``base`` and ``equal``.  values: field, plan, value."""
    ref = values.groupBy("field").agg(
        F.max(F.when(F.col("plan") == "base", F.col("value"))).alias("b"), F.max(F.when(F.col("plan") == "equal", F.col("value"))).alias("e")
    )
    pct = lambda c: F.when(F.col(c) != 0, 100.0 * (F.col("value") - F.col(c)) / F.abs(c)).otherwise(0.0)
    return values.join(ref, "field").select("field", "plan", "value", pct("b").alias("gain_vs_base_pct"), pct("e").alias("gain_vs_equal_pct"))


# ---------------------------------------------------------------------------------------------- priors
def distance_trend(pairs: DataFrame, min_pairs: int = 4) -> DataFrame:
    """ln f = a + b d per field on the connected pairs; NULL below four pairs."""
    ok = pairs.where(F.col("f") > 0.02)
    t = ok.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.log("f"), F.col("d")).alias("b"), F.regr_intercept(F.log("f"), F.col("d")).alias("a")
    )
    return t.where(F.col("n") >= min_pairs).select("field", "a", "b", "n")


def scaled_prior(prior: DataFrame, trend: DataFrame, row_sum: DataFrame) -> DataFrame:
    """Prior rows bent to the field's distance trend and scaled to its usual row sum.

    prior: field, injector, producer, d, f; row_sum: field, row_sum.
    """
    p = prior.join(trend, "field", "left").join(row_sum, "field")
    bent = F.sqrt(F.greatest("f", F.lit(1e-12)) * F.greatest(F.exp(F.col("a") + F.col("b") * F.col("d")), F.lit(1e-12)))
    p = p.withColumn("shape", F.when(F.col("a").isNotNull(), bent).otherwise(F.col("f")))
    tot = p.groupBy(*INJ).agg(F.sum("shape").alias("tot"))
    return p.join(tot, INJ).select(
        *INJ, "producer", "d", F.when(F.col("tot") > 0, F.col("shape") / F.col("tot") * F.col("row_sum")).otherwise(F.col("shape")).alias("f")
    )


def median_row_sum(pairs: DataFrame) -> DataFrame:
    sums = pairs.groupBy(*INJ).agg(F.sum("f").alias("s"))
    return group_quantile(sums, ["field"], "s", 0.5, "row_sum")


def infill_split(fitted: DataFrame, share: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new producer takes a share of each injector; the injector's row sum is kept.

    fitted: field, injector, producer, f; share: field, injector, producer (the new one), share.
    """
    tot = fitted.groupBy(*INJ).agg(F.sum("f").alias("tot"))
    new = share.join(tot, INJ).select(*INJ, "producer", (F.col("tot") * F.col("share")).alias("f"))
    taken = share.groupBy(*INJ).agg(F.sum("share").alias("share"))
    old = fitted.join(taken, INJ, "left").select(*INJ, "producer", (F.col("f") * (1.0 - F.coalesce("share", F.lit(0.0)))).alias("f"))
    return new, old


def pattern_balance(current: DataFrame, liquid: DataFrame, vrr: float) -> DataFrame:
    """Scale injection of a field to a voidage target.  liquid: field, liq (recent total)."""
    tot = current.groupBy("field").agg(F.sum("rate").alias("tot"))
    c = current.join(tot, "field").join(liquid, "field")
    return c.select(*INJ, (F.col("rate") * vrr * F.col("liq") / F.greatest("tot", F.lit(1e-9))).alias("rate"))


def gradient_by(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """Derivative on an uneven grid: second-order inside, one-sided at the ends; null where two neighbours share one x."""
    w = Window.partitionBy(*keys).orderBy(x)
    xl, xr, yl, yr = F.lag(x).over(w), F.lead(x).over(w), F.lag(y).over(w), F.lead(y).over(w)
    hs, hd = F.col(x) - xl, xr - F.col(x)
    inner = F.try_divide(hs * hs * yr + (hd * hd - hs * hs) * F.col(y) - hd * hd * yl, hs * hd * (hd + hs))
    left, right = F.try_divide(yr - F.col(y), hd), F.try_divide(F.col(y) - yl, hs)
    return df.withColumn(out, F.when(xl.isNull(), left).when(xr.isNull(), right).otherwise(inner))


# ---------------------------------------------------------------------------------------------- search
def _uniform(*cols) -> Column:
    """Repeatable uniform number in (0, 1) from keys, so a retried task draws the same candidates."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def greedy_fill(bounds: DataFrame, marginal: DataFrame) -> DataFrame:
    """Injectors in use filled to the bound in order of marginal value until the water is spent.

    All of them share one bound, so the order only matters through the value at one rank, found without sorting a field
    in one task.  Injectors tied at that rank share what is left.
    """
    b = bounds.join(marginal, INJ).where(F.col("hi") > 0)
    n = b.groupBy("field").agg(F.count(F.lit(1)).alias("n_open"), F.max("hi").alias("h"), F.max("total_water").alias("w"))
    k = n.withColumn("full", F.least(F.floor(F.col("w") / F.col("h")), F.col("n_open")))
    keyed = b.join(k, "field").withColumn("neg", -F.col("marginal"))
    at = ordered_values_at(keyed, "neg", "full")
    e = keyed.join(at, "field", "left")
    above = e.withColumns({"over": F.col("cut").isNull() | (F.col("neg") < F.col("cut")), "tied": F.coalesce(F.col("neg") == F.col("cut"), F.lit(False))})
    s = above.groupBy("field").agg(F.sum(F.when(F.col("over"), F.col("hi")).otherwise(0.0)).alias("spent"), F.count_if("tied").alias("n_tied"))
    left = F.greatest(F.col("w") - F.col("spent"), F.lit(0.0))
    rate = F.when(F.col("over"), F.col("hi")).when(F.col("tied"), left / F.col("n_tied")).otherwise(0.0)
    return above.join(s, "field").select(*INJ, rate.alias("rate"))


def ordered_values_at(df: DataFrame, value: str, rank_col: str) -> DataFrame:
    """Value at a per-field rank held in a column: ranks enter as part of the key."""
    keyed = df.select("field", rank_col, value)
    got = ordered_values(keyed, ["field", rank_col], value, {"_z": lambda n: F.least(F.col(rank_col), n)})
    return got.select("field", F.col("_z").alias("cut"))


def draw_candidates(bounds: DataFrame, n: int, seed: int, shrink: float | None = None, best: DataFrame | None = None) -> DataFrame:
    """Random allocations that use exactly the water and respect the bounds.

    Normalised exponentials are clipped and what the clipping frees is spread over the headroom.  Around a best plan a
    candidate is a mixture of the two, feasible because the constraints are convex.
    """
    b = bounds.withColumn("cand", F.explode(F.sequence(F.lit(1), F.lit(n))))
    e = F.when(F.col("hi") > 0, -F.log(_uniform(F.lit(seed), F.col("cand"), F.col("injector")))).otherwise(0.0)
    b = b.withColumn("e", e)
    tot = b.groupBy("field", "cand").agg(F.sum("e").alias("te"))
    b = b.join(tot, ["field", "cand"]).withColumn("x", F.least(F.coalesce(F.try_divide("e", "te"), F.lit(0.0)) * F.col("total_water"), F.col("hi")))
    room = b.groupBy("field", "cand").agg(F.sum("x").alias("sx"), F.sum(F.col("hi") - F.col("x")).alias("room"))
    b = b.join(room, ["field", "cand"])
    lift = F.when(F.col("room") > 0, (F.col("total_water") - F.col("sx")) / F.col("room")).otherwise(0.0)
    b = b.withColumn("rate", F.col("x") + lift * (F.col("hi") - F.col("x")))
    if best is not None:
        b = b.join(best.select(*INJ, F.col("rate").alias("rb")), INJ).withColumn("rate", F.col("rb") + shrink * (F.col("rate") - F.col("rb")))
    name = F.concat(F.lit(f"draw{seed}-"), F.col("cand"))
    return b.select("field", name.alias("plan"), "injector", "rate")


def evaluate_plans(plans: DataFrame, pairs: DataFrame, g: DataFrame, state: DataFrame, cal: DataFrame) -> DataFrame:
    """Cumulative oil per plan and member."""
    src = dealt(plan_sources(plans, pairs, g, ["field", "plan"], producers=state))
    fc = simulate(src, state, cal, ["field", "plan"])
    return fc.groupBy("field", "plan", "member").agg(F.sum(F.col("oil") * F.col("dt_days")).alias("cum_oil"))


def pick_plan(totals: DataFrame, posture: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Best plan per field; the robust posture drops any plan that loses oil in some member."""
    base = totals.where(F.col("plan") == "base").select("field", "member", F.col("cum_oil").alias("b"))
    v = totals.join(base, ["field", "member"]).groupBy("field", "plan").agg(
        posture_stat(F.col("cum_oil"), posture, cfg).alias("value"), F.bool_and(F.col("cum_oil") >= F.col("b") - 1e-9).alias("no_loss")
    )
    ok = v.where(F.col("no_loss")) if posture == "robust" else v
    return ok.groupBy("field").agg(F.max_by(F.struct("plan", "value"), F.struct("value", "plan")).alias("p")).select("field", "p.plan", "p.value")


def plan_search(
    bounds: DataFrame, current: DataFrame, marginal: DataFrame, pairs: DataFrame, g: DataFrame, state: DataFrame, cal: DataFrame,
    posture: str = "balanced", draws: int = 8, keep=None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Best allocation found: field, plan, injector, rate, value.

    Each round draws around the best so far, closer.  A field is done when a round brings it no gain beyond rounding (1e-9 of
    its value); draws that have come so close that they equal the best bring none, so the search ends.
    """
    keep = keep or (lambda d: d)
    named = lambda df, name: df.select("field", F.lit(name).alias("plan"), "injector", "rate")
    pairs = None if pairs is None else keep(injector_shares(pairs, g))
    plans = named(current, "base").unionByName(named(greedy_fill(bounds, marginal), "greedy"))
    plans = keep(plans.unionByName(draw_candidates(bounds, draws, 0)))
    best = keep(plans.join(pick_plan(evaluate_plans(plans, pairs, g, state, cal), posture, cfg), ["field", "plan"]))
    open_, r = best, 0
    while True:
        r += 1
        around = draw_candidates(bounds.join(open_.select("field").distinct(), "field", "left_semi"), draws, r, 0.5**r, open_)
        own = named(current, "base").join(open_.select("field").distinct(), "field", "left_semi").unionByName(open_.select("field", "plan", "injector", "rate"))
        plans = keep(own.unionByName(around).dropDuplicates(["field", "plan", "injector"]))
        won = pick_plan(evaluate_plans(plans, pairs, g, state, cal), posture, cfg)
        before = open_.groupBy("field").agg(F.max("value").alias("before"))
        open_ = keep(plans.join(won.join(before, "field").where(F.col("value") > F.col("before") + 1e-9 * F.abs("before")).drop("before"), ["field", "plan"]))
        if open_.isEmpty():
            break
        best = keep(best.join(open_.select("field").distinct(), "field", "left_anti").unionByName(open_, allowMissingColumns=True))
    return best
