"""Money, objectives and risk statistics of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.config import BBL_PER_M3, DEFAULTS, Settings


def month_totals(fc: DataFrame, plan_rates: DataFrame, plan_keys: list[str], member: str = "member") -> DataFrame:
    """Oil, water and injection per plan, member and month.  plan_rates: plan_keys, rate summed over injectors."""
    inj = plan_rates.groupBy(*plan_keys).agg(F.sum("rate").alias("inj"))
    tot = fc.groupBy(*plan_keys, member, "h", "dt_days", "t_cum").agg(F.sum("oil").alias("oil"), F.sum("water").alias("water"))
    return tot.join(inj, plan_keys)


def price_deck(months: DataFrame, deck: list[float], price: float) -> DataFrame:
    """Price per month: the deck, its last value afterwards, or one constant price."""
    if not deck:
        return months.withColumn("price", F.lit(float(price)))
    arr = F.array(*[F.lit(float(p)) for p in deck])
    return months.withColumn("price", F.element_at(arr, F.least(F.col("h"), F.lit(len(deck))).cast("int")))


def cash(price: Column, water_cost, injection_cost, rate) -> Column:
    """Discounted cash of one month."""
    vol = F.col("dt_days") * BBL_PER_M3
    money = (price * F.col("oil") - F.lit(water_cost) * F.col("water") - F.lit(injection_cost) * F.col("inj")) * vol
    return money * F.pow(1.0 + F.lit(rate), -F.col("t_cum") / 365.25)


def npv(months: DataFrame, keys: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """months must carry ``price``."""
    c = cash(F.col("price"), cfg.water_cost, cfg.injection_cost, cfg.discount_rate)
    return months.groupBy(*keys).agg(F.sum(c).alias("npv"))


PRICE_FACTORS = (0.7, 0.85, 1.0, 1.15, 1.3)


def price_tornado(months: DataFrame, keys: list[str], plan: str, base: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Gain of a plan over the base at several price factors, one conditional aggregate per field and member."""
    m = months.withColumn("price_factor", F.explode(F.array(*[F.lit(x) for x in PRICE_FACTORS])))
    c = cash(F.col("price_factor") * cfg.oil_price, cfg.water_cost, cfg.injection_cost, cfg.discount_rate)
    sign = F.when(F.col("plan") == plan, 1.0).when(F.col("plan") == base, -1.0).otherwise(0.0)
    return m.groupBy(*keys, "price_factor").agg(F.sum(sign * c).alias("delta_npv"))


def posture_value(values: DataFrame, keys: list[str], value: str, posture: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """The number a plan is judged by: mean, mean less a share of the spread, or P10 over the members."""
    return values.groupBy(*keys).agg(posture_stat(F.col(value), posture, cfg).alias("value"))


def posture_stat(v: Column, posture: str, cfg: Settings = DEFAULTS) -> Column:
    if posture == "aggressive":
        return F.avg(v)
    if posture == "balanced":
        return F.avg(v) - cfg.balanced_k * F.stddev_pop(v)
    if posture == "robust":
        return F.percentile(v, 0.1)
    raise ValueError(f"unknown posture {posture!r}")


def effective_posture(requested: Column, confidence: Column) -> Column:
    return F.when(confidence == "LOW", "robust").otherwise(F.lower(F.coalesce(requested, F.lit("balanced"))))


def economic_tornado(months: DataFrame, plan: str, base: str, posture: str, cfg: Settings = DEFAULTS, member: str = "member") -> DataFrame:
    """One input moved at a time; the gain is the difference of the posture values.  Eight perturbations plus none."""
    p, w, i, d = cfg.oil_price, cfg.water_cost, cfg.injection_cost, cfg.discount_rate
    cases = [("base", "mid", p, w, i, d)]
    cases += [("oil_price", s, p * k, w, i, d) for s, k in (("low", 0.7), ("high", 1.3))]
    cases += [("water_handling_cost", s, p, w * k, i, d) for s, k in (("low", 1.5), ("high", 0.5))]
    cases += [("injection_cost", s, p, w, i * k, d) for s, k in (("low", 1.5), ("high", 0.5))]
    cases += [("discount_rate", "low", p, w, i, d + 0.05), ("discount_rate", "high", p, w, i, max(0.0, d - 0.05))]
    table = F.array(*[
        F.struct(F.lit(a).alias("item"), F.lit(s).alias("side"), *[F.lit(float(v)).alias(n) for n, v in zip("pwid", vals)])
        for a, s, *vals in cases
    ])
    m = months.where(F.col("plan").isin(plan, base)).withColumn("c", F.explode(table))
    vol = F.col("dt_days") * BBL_PER_M3
    money = (F.col("c.p") * F.col("oil") - F.col("c.w") * F.col("water") - F.col("c.i") * F.col("inj")) * vol
    money = money * F.pow(1.0 + F.col("c.d"), -F.col("t_cum") / 365.25)
    v = m.groupBy("field", "plan", member, F.col("c.item").alias("item"), F.col("c.side").alias("side")).agg(F.sum(money).alias("v"))
    stat = posture_value(v, ["field", "plan", "item", "side"], "v", posture, cfg)
    gain = F.sum(F.when(F.col("plan") == plan, F.col("value")).otherwise(-F.col("value")))
    out = stat.groupBy("field", "item", "side").agg(gain.alias("gain"))
    rng = v.where(F.col("item") == "base").groupBy("field", member).agg(F.sum(F.when(F.col("plan") == plan, F.col("v")).otherwise(-F.col("v"))).alias("g"))
    return out.unionByName(_range(rng))


def _range(member_gains: DataFrame) -> DataFrame:
    r = member_gains.groupBy("field").agg(F.percentile("g", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    rows = F.array(F.struct(F.lit("low").alias("side"), F.col("q")[0].alias("gain")), F.struct(F.lit("high").alias("side"), F.col("q")[1].alias("gain")))
    return r.select("field", F.lit("forecast_range").alias("item"), F.explode(rows).alias("r")).select("field", "item", "r.side", "r.gain")


def oil_tornado(totals: DataFrame, plan: str, base: str, posture: str, cfg: Settings = DEFAULTS, member: str = "member") -> DataFrame:
    """Gain in oil and its range over the members; no economics involved.  totals: field, plan, member, cum_oil."""
    v = totals.where(F.col("plan").isin(plan, base))
    stat = posture_value(v, ["field", "plan"], "cum_oil", posture, cfg)
    sign = F.when(F.col("plan") == plan, 1.0).otherwise(-1.0)
    gain = stat.groupBy("field").agg(F.sum(sign * F.col("value")).alias("gain"))
    rng = v.groupBy("field", member).agg(F.sum(sign * F.col("cum_oil")).alias("g"))
    return gain.select("field", F.lit("base").alias("item"), F.lit("mid").alias("side"), "gain").unionByName(_range(rng))


def objectives(months: DataFrame, keys: list[str], target_oil: Column | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Cumulative oil, net present value and water needed, with feasibility against an oil target."""
    c = cash(F.lit(cfg.oil_price), cfg.water_cost, cfg.injection_cost, cfg.discount_rate)
    o = months.groupBy(*keys).agg(
        F.sum(F.col("oil") * F.col("dt_days")).alias("max_cumulative_oil"), F.sum(c).alias("max_npv"),
        (-F.sum(F.col("inj") * F.col("dt_days"))).alias("min_water"),
    )
    target = F.lit(0.0) if target_oil is None else target_oil
    return o.withColumn("target_met", F.col("max_cumulative_oil") >= target)
