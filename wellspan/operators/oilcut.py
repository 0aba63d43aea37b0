"""Oil cut against allocated water, and the recent levels a forecast starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import clip, safe_div

PROD = ["field", "producer"]


def allocated_water(support: DataFrame, steps: DataFrame, offset: float = 0.0) -> DataFrame:
    """Cumulative allocated water per producer.  support: field, producer, step, support; steps adds dt_days."""
    s = steps.join(support, [*PROD, "step"], "left")
    w = Window.partitionBy(*PROD).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    vol = F.coalesce("support", F.lit(0.0)) * F.col("dt_days")
    return s.withColumn("support", F.coalesce("support", F.lit(0.0))).withColumn("cwi", offset + F.sum(vol).over(w))


def fit_window_mask(rows: DataFrame, last: int, keys: list[str] | None = None) -> DataFrame:
    """Mark the last producing steps of each producer."""
    recent = F.row_number().over(Window.partitionBy(*(keys or PROD), "on").orderBy(F.desc("step"))) <= last
    return rows.withColumn("in_fit", F.col("on") & recent)


def _offset_fits(pts: DataFrame) -> DataFrame:
    """Least squares of y on ln(offset + cwi) per (producer, offset) from five moments; slope kept in [0, 50]."""
    x = F.log(F.col("c0") + F.col("cwi"))
    p = pts.withColumn("x", F.when(F.col("c0") + F.col("cwi") > 0, x))
    m = p.groupBy(*PROD, "c0").agg(
        F.count("x").alias("n"), F.count(F.lit(1)).alias("n_all"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"),
    ).where(F.col("n") == F.col("n_all"))
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx")).otherwise(0.0)
    m = m.withColumn("beta", clip(slope, 0.0, 50.0))
    m = m.withColumn("ln_alpha", F.col("my") - F.col("beta") * F.col("mx"))
    b = F.col("beta")
    sse = F.col("n") * F.greatest(F.col("vy") + b * b * F.col("vx") - 2 * b * F.col("cxy"), F.lit(0.0))
    return m.withColumn("sse", F.round(sse, 9)).withColumn("sst", F.col("n") * F.col("vy"))


def _best_offset(fits: DataFrame) -> DataFrame:
    keep = F.struct("c0", "ln_alpha", "beta", "sse", "sst")
    return fits.groupBy(*PROD).agg(F.min_by(keep, F.struct("sse", "c0")).alias("b")).select(*PROD, "b.*")


def fit_wor_power(rows: DataFrame, keep=None) -> DataFrame:
    """Water-oil ratio as a power of cumulative water per producer: alpha, beta, offset.

    rows: field, producer, step, cwi, oil, water, in_fit.  Offsets come from a log grid and one finer pass around the
    best; with under three usable points the mean oil cut is held.
    """
    liq = F.col("oil") + F.col("water")
    fo = F.when(liq > 0, F.col("oil") / liq)
    r = rows.where("in_fit").withColumn("fo", fo)
    ok = (F.col("fo") > 1e-4) & (F.col("fo") < 1 - 1e-4) & (F.col("cwi") >= 0)
    base = r.groupBy(*PROD).agg(
        F.count_if(ok).alias("n_ok"), F.avg("fo").alias("mean_fo"), F.max(F.when(ok, F.col("cwi"))).alias("cmax")
    )
    pts = r.where(ok).withColumn("y", F.log(1.0 / F.col("fo") - 1.0)).select(*PROD, "cwi", "y")
    enough = base.where(F.col("n_ok") >= 3).withColumn("cmax", F.when(F.col("cmax") > 0, F.col("cmax")).otherwise(1.0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.exp(F.log(F.col("cmax") * 1e-3) + F.log(F.lit(50000.0)) / 23 * k))
    offs = enough.select(*PROD, F.concat(F.array(F.lit(0.0)), grid).alias("offs"))
    first = _best_offset(_offset_fits(pts.join(offs, PROD).withColumn("c0", F.explode("offs"))))
    first = (keep or (lambda d: d))(first)
    finer = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.exp(F.log(F.col("c0") / 3) + F.log(F.lit(9.0)) / 23 * k))
    fine = first.where(F.col("c0") > 0).select(*PROD, finer.alias("offs"))
    second = _offset_fits(pts.join(fine, PROD).withColumn("c0", F.explode("offs")))
    best = _best_offset(first.unionByName(second.select(*first.columns)))
    mean = clip(F.coalesce("mean_fo", F.lit(0.5)), 1e-3, 1 - 1e-3)
    out = base.join(best, PROD, "left")
    thin = F.col("n_ok") < 3
    return out.select(
        *PROD, F.when(thin, 1.0 / mean - 1.0).otherwise(F.exp(F.least("ln_alpha", F.lit(700.0)))).alias("alpha"),
        F.when(thin, 0.0).otherwise(F.col("beta")).alias("beta"), F.when(thin, 0.0).otherwise(F.col("c0")).alias("offset"),
        F.when(thin, 0.0).otherwise(1.0 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst")).otherwise(1.0)).alias("r2_log"),
    )


def eval_wor_power(alpha: Column, beta: Column, offset: Column, cwi: Column) -> Column:
    wor = alpha * F.pow(F.greatest(offset + cwi, F.lit(1e-9)), beta)
    return F.coalesce(1.0 / (1.0 + F.when(~F.isnan(wor), wor)), F.lit(0.0))


def oil_prediction(pred: Column, ratio: Column, fo: Column) -> Column:
    return pred * ratio * fo


def koval_water_cut(cum: Column, k: Column, v: Column) -> Column:
    td = F.greatest(cum, F.lit(0.0)) / F.greatest(v, F.lit(1e-9))
    kk = F.greatest(k, F.lit(1.0 + 1e-9))
    mid = (kk - F.sqrt(kk / F.when(td > 0, td).otherwise(1e-12))) / (kk - 1.0)
    return clip(F.when(td < 1.0 / kk, 0.0).when(td > kk, 1.0).otherwise(mid), 0.0, 1.0)


# Search grid for the heterogeneity factor and the volume as a multiple of the largest cumulative.
KOVAL_K = (1.1, 1.3, 1.6, 2.0, 2.5, 3.2, 4.0, 5.0, 6.5, 8.0, 10.0, 14.0, 20.0)
KOVAL_V = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0, 8.0)


def fit_koval_grid(rows: DataFrame) -> DataFrame:
    """Koval factor and volume by grid search.  rows: field, producer, cum, cut, in_fit.  Producers with under three
    points get the default factor."""
    ok = F.col("in_fit") & F.col("cut").isNotNull() & (F.col("cum") > 0)
    r = rows.where(ok).select(*PROD, "cum", clip(F.col("cut"), 0.0, 1.0).alias("cut"))
    top = r.groupBy(*PROD).agg(F.max("cum").alias("vmax"), F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k in KOVAL_K for v in KOVAL_V])
    g = r.join(top, PROD).where(F.col("n") >= 3).withColumn("c", F.explode(cells))
    model = koval_water_cut(F.col("cum"), F.col("c.k"), F.col("c.v") * F.col("vmax"))
    sse = g.groupBy(*PROD, F.col("c.k").alias("k"), F.col("c.v").alias("v"), "vmax").agg(
        F.round(F.sum(F.pow(model - F.col("cut"), 2)), 9).alias("sse")
    )
    best = sse.groupBy(*PROD).agg(
        F.min_by(F.struct("k", (F.col("v") * F.col("vmax")).alias("v_pd"), "sse"), F.struct("sse", "k", "v")).alias("b")
    ).select(*PROD, "b.*")
    thin = top.where(F.col("n") < 3).select(*PROD, F.lit(2.0).alias("k"), F.col("vmax").alias("v_pd"), F.lit(None).cast("double").alias("sse"))
    return best.unionByName(thin)


def surface_ratio(prod: DataFrame) -> DataFrame:
    """Median surface over reservoir liquid on producing steps, one where there is none."""
    r = F.when(F.col("on") & (F.col("liq") > 0), (F.col("oil") + F.col("water")) / F.col("liq"))
    return prod.groupBy(*PROD).agg(F.coalesce(F.percentile(r, 0.5), F.lit(1.0)).alias("ratio"))


def _recent(prod: DataFrame, months: int, keys: list[str] | None = None) -> DataFrame:
    return fit_window_mask(prod, months, keys).where("in_fit")


def recent_oil_cut(prod: DataFrame, months: int = 3) -> DataFrame:
    r = _recent(prod, months).groupBy(*PROD).agg(F.sum("oil").alias("o"), F.sum(F.col("oil") + F.col("water")).alias("l"))
    return r.select(*PROD, F.when(F.col("l") > 0, F.col("o") / F.col("l")).alias("oil_cut"))


def recent_level_ratio(pred: DataFrame, months: int = 3, lo: float = 0.5, hi: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """Observed over fitted liquid on the last producing steps, clipped; one where there is nothing to compare."""
    ks = keys or PROD
    r = _recent(pred, months, ks).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.avg("liq").alias("obs"), F.avg("pred").alias("fit")
    )
    ok = (F.col("n") >= 2) & (F.col("fit") > 0) & (F.col("obs") > 0)
    return r.select(*ks, F.when(ok, clip(F.col("obs") / F.col("fit"), lo, hi)).otherwise(1.0).alias("level"))


def active_producers(prod: DataFrame, lookback: int = 3) -> DataFrame:
    recent = F.col("step") >= F.col("n_steps") - lookback
    return prod.groupBy(*PROD).agg(F.coalesce(F.max(F.when(recent, F.col("on"))), F.lit(False)).alias("active"))


def idle_injectors(inj: DataFrame, lookback: int = 3) -> DataFrame:
    recent = F.col("step") >= F.col("n_steps") - lookback
    on = F.col("on") & (F.col("inj") > 0)
    return inj.groupBy("field", "injector").agg((~F.coalesce(F.max(F.when(recent, on)), F.lit(False))).alias("idle"))


def current_injection(inj: DataFrame, months: int = 1) -> DataFrame:
    recent = inj.where(F.col("step") >= F.col("n_steps") - months)
    return recent.groupBy("field", "injector").agg(F.avg("inj").alias("rate"))


def injector_efficiency(pairs: DataFrame, prod: DataFrame, inj: DataFrame, steps: int = 3) -> DataFrame:
    """Oil supported by each injector: its couplings times the producers' recent oil cut, and times its rate."""
    last = prod.where(F.col("step") >= F.col("n_steps") - steps)
    cut = last.groupBy(*PROD).agg(safe_div(F.sum("oil"), F.sum(F.col("oil") + F.col("water"))).alias("fo"))
    rate = inj.where(F.col("step") >= F.col("n_steps") - steps).groupBy("field", "injector").agg(F.avg("inj").alias("rate"))
    eff = pairs.join(cut, PROD).groupBy("field", "injector").agg(F.sum(F.col("f") * F.col("fo")).alias("efficiency"))
    return eff.join(rate, ["field", "injector"]).withColumn("oil_supported", F.col("efficiency") * F.col("rate"))
