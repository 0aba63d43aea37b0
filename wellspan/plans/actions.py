"""From a plan to weekly moves and an ordered list of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.config import BBL_PER_M3, DEFAULTS, Settings

INJ = ["field", "injector"]


def small_change(cur: Column, tgt: Column, cfg: Settings = DEFAULTS) -> Column:
    """Too small to act on: under a share of the rate or under the meter resolution (given in bbl/d)."""
    d = F.abs(tgt - cur)
    return (d < cfg.min_change_frac * F.greatest(cur, F.lit(1e-9))) | (d < cfg.meter_resolution_bbl_d / BBL_PER_M3)


def ramp(moves: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Add ``target`` (changes worth making), ``suppressed`` and ``weekly`` (rates after week 1, 2, ...).

    moves: field, injector, rate_from, rate_to, confidence; rates are not negative.  One fold per row over as many weeks as
    the closed form allows: equal steps while the rate lies under the floor, then a constant factor up or down to the target.
    """
    cur = F.col("rate_from")
    m = moves.withColumn("suppressed", small_change(cur, F.col("rate_to"), cfg))
    m = m.withColumn("target", F.when(F.col("suppressed"), cur).otherwise(F.col("rate_to")))
    m = m.withColumn("step_frac", F.when(F.col("confidence") == "HIGH", cfg.step_frac_high).otherwise(cfg.step_frac_other))
    floor = cfg.min_change_frac * F.greatest("target", F.lit(1e-9))

    def week(acc, _):
        x = F.when(F.size(acc) == 0, F.col("rate_from")).otherwise(F.element_at(acc, -1))
        cap = F.col("step_frac") * F.greatest(x, floor)
        move = F.least(F.greatest(F.col("target") - x, -cap), cap)
        return F.when(F.abs(F.col("target") - x) < 1e-9, acc).otherwise(F.concat(acc, F.array(x + move)))

    low = F.greatest("rate_from", floor)
    linear = F.ceil(F.greatest(floor - F.col("rate_from"), F.lit(0.0)) / (F.col("step_frac") * floor))
    up = F.log(F.greatest(F.col("target") / low, F.lit(1.0))) / F.log1p("step_frac")
    down = F.log(F.greatest(F.col("rate_from") / F.greatest("target", F.lit(1e-9)), F.lit(1.0))) / -F.log1p(-F.col("step_frac"))
    weeks = F.sequence(F.lit(1), (linear + F.ceil(up) + F.ceil(down)).cast("int") + 2)
    return m.withColumn("weekly", F.aggregate(weeks, F.array().cast("array<double>"), week)).withColumn("weeks", F.size("weekly"))


def weekly_rows(ramped: DataFrame) -> DataFrame:
    return ramped.select(*INJ, F.posexplode("weekly").alias("w", "rate")).select(*INJ, (F.col("w") + 1).alias("week"), "rate")


def action_list(ramped: DataFrame, gains: DataFrame, marginal: DataFrame, start: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Changes with first step, target date and share of the gain.

    gains: field, total_gain; marginal: field, injector, marginal; ramped also carries facility.  Shares follow the
    size of a change times its marginal value, or the size alone when no value is positive.
    """
    a = ramped.join(marginal, INJ, "left").join(gains, "field")
    delta = F.col("target") - F.col("rate_from")
    a = a.withColumns({"delta": delta, "s1": F.abs(delta) * F.greatest(F.coalesce("marginal", F.lit(0.0)), F.lit(0.0)), "s2": F.abs(delta)})
    tot = a.groupBy("field").agg(F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
    a = a.join(tot, "field")
    share = F.when(F.col("t1") > 0, F.col("s1") / F.col("t1")).when(F.col("t2") > 0, F.col("s2") / F.col("t2")).otherwise(0.0)
    a = a.withColumn("expected_gain", F.greatest("total_gain", F.lit(0.0)) * share)
    a = a.where(~F.col("suppressed") & (F.abs("delta") >= 1e-9))
    best = a.groupBy("field", "facility").agg(F.max("expected_gain").alias("facility_gain"))
    out = a.join(best, ["field", "facility"])
    revert = F.lit(f"water cut of a connected producer rises by more than {cfg.revert_water_cut_jump:.0%}")
    return out.select(
        *INJ, "facility", "rate_from", F.col("target").alias("rate_to"), (F.get("weekly", F.lit(0)) - F.col("rate_from")).alias("first_step"),
        "weeks", F.date_add(F.lit(start).cast("date"), F.col("weeks") * 7).alias("target_date"), "expected_gain", "facility_gain", revert.alias("revert_if"),
    )


def in_order(actions: DataFrame) -> DataFrame:
    """Facilities by their best change, then changes by gain."""
    return actions.orderBy("field", F.desc("facility_gain"), "facility", F.desc("expected_gain"), "injector")


def injectivity_hint(rate: Column, injectivity: Column, p_res: Column) -> Column:
    p = p_res + rate / injectivity
    known = F.format_string("target %.0f, injection pressure about %.0f", F.rint(rate), F.rint(p))
    return F.when((injectivity > 0) & p_res.isNotNull(), known).otherwise(F.format_string("target %.0f, set choke or pump", F.rint(rate)))
