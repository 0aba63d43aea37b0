"""Scores of fitted models and the ranking built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import clip, rank_value
from wellspan.functions.quantiles import group_quantile


def r2_of(o: Column, p: Column, mask: Column) -> Column:
    """1 - SSE / SST in one pass; NULL for fewer than two points or a flat series."""
    oo, n = F.when(mask, o), F.count(F.when(mask, o))
    var = F.var_pop(oo)
    return F.when((n >= 2) & (var > 0), 1.0 - F.sum(F.when(mask, (o - p) * (o - p))) / (var * n))


def mape_of(o: Column, p: Column, mask: Column) -> Column:
    return F.avg(F.when(mask & (o > 0), F.abs(p - o) / o)) * 100.0


def lag1_autocorr(rows: DataFrame, keys: list[str], resid: str) -> DataFrame:
    """Lag-one autocorrelation of the rows given (mask first, then lag); zero for fewer than four rows."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_e", F.col(resid) - F.avg(resid).over(w)).withColumn("_l", F.lag("_e").over(w.orderBy("step")))
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") * F.col("_l")).alias("num"), F.sum(F.col("_e") * F.col("_e")).alias("den")
    )
    return s.select(*keys, F.when((F.col("n") >= 4) & (F.col("den") > 0), F.col("num") / F.col("den")).otherwise(0.0).alias("rho1"))


def aicc(n: Column, k: Column, sse: Column) -> Column:
    base = n * F.log(sse / n) + 2 * k
    fine = (n > 0) & (sse > 0) & (n - k - 1 > 0)
    return F.when(fine, base + (2 * k * (k + 1)) / (n - k - 1)).otherwise(F.lit(float("inf")))


def verify_report(pred: DataFrame, n_train: DataFrame, model: str = "member") -> DataFrame:
    """Metrics per producer and pooled per model, as one grouping-sets aggregate.  Pooled rows have no producer.  The histories meet
    ``n_train``, one row per field, where they are: dealt by field, they would come to as many tasks as there are fields."""
    r = pred.join(F.broadcast(n_train), "field")
    train = F.col("on") & (F.col("step") < F.col("n_train"))
    blind = F.col("on") & (F.col("step") >= F.col("n_train"))
    o, p = F.col("liq"), F.col("pred")
    f, m, j = F.col("field"), F.col(model), F.col("producer")
    return r.groupingSets([[f, m, j], [f, m]], f, m, j).agg(
        r2_of(o, p, train).alias("train_r2"), r2_of(o, p, blind).alias("blind_r2"),
        mape_of(o, p, train).alias("train_mape"), mape_of(o, p, blind).alias("blind_mape"),
        F.count_if(train).alias("n_train_points"), F.count_if(blind).alias("n_blind_points"),
        F.sum(F.when(train, (p - o) * (p - o))).alias("sse_train"),
    )


def median_metrics(report: DataFrame, model: str = "member") -> DataFrame:
    """Medians over producers.  A field may hold very many producers, so the quantile is spread over bins."""
    per = report.where(F.col("producer").isNotNull())
    a = group_quantile(per, ["field", model], "blind_r2", 0.5, "blind_r2_median")
    b = group_quantile(per, ["field", model], "blind_mape", 0.5, "blind_mape_median")
    return a.join(b, ["field", model], "full")


def plausibility(pairs: DataFrame, pred: DataFrame, params: DataFrame, bounds: DataFrame, model: str = "member") -> DataFrame:
    """Range checks per model with notes; a time constant at its bound is noted but does not fail."""
    k = ["field", model]
    rng = pairs.groupBy(*k).agg(F.bool_or((F.col("f") < -1e-9) | (F.col("f") > 1 + 1e-9)).alias("out_of_range"))
    sums = pairs.groupBy(*k, "injector").agg(F.sum("f").alias("s")).groupBy(*k).agg(F.bool_or(F.col("s") > 1 + 1e-6).alias("over_one"))
    neg = pred.groupBy(*k).agg(F.bool_or(F.col("on") & (F.col("pred") < 0)).alias("negative"))
    t = params.join(bounds, "field")
    at = t.groupBy(*k).agg(
        F.count_if((F.col("tau") <= F.col("lo") * 1.001) | (F.col("tau") >= F.col("hi") * 0.999)).alias("n_at_bound")
    )
    out = rng.join(sums, k).join(neg, k).join(at, k)
    note = F.concat_ws(
        "; ", F.when(F.col("out_of_range"), "coupling outside [0, 1]"), F.when(F.col("over_one"), "injector sum above 1"),
        F.when(F.col("negative"), "negative prediction"), F.when(F.col("n_at_bound") > 0, F.concat(F.lit("tau at bound: "), F.col("n_at_bound"))),
    )
    ok = ~(F.col("out_of_range") | F.col("over_one") | F.col("negative"))
    return out.select(*k, ok.alias("plausible"), "n_at_bound", note.alias("notes"))


def fit_flags(report: DataFrame, rho: DataFrame, model: str = "member", cfg: Settings = DEFAULTS) -> DataFrame:
    """Condition rows per producer: autocorrelated residuals, poor blind fit."""
    r = report.where(F.col("producer").isNotNull()).join(rho, ["field", model, "producer"])
    poor = (F.col("blind_mape") > cfg.blind_mape_poor) & (F.col("blind_r2") < 0.5)
    codes = F.filter(
        F.array(F.when(F.col("rho1") > cfg.autocorr_warn, F.lit("RESIDUAL_AUTOCORRELATED")), F.when(poor, F.lit("BLIND_FIT_POOR"))),
        lambda c: c.isNotNull(),
    )
    return r.select("field", model, "producer", F.explode(codes).alias("code"))


def score_models(entries: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Composite score per model of a field.  entries: field, model, blind_r2, blind_mape, aicc, spread, runtime_s,
    plausible, n_params.  A field has a handful of models."""
    w = Window.partitionBy("field")
    ic = F.when(F.isnan("aicc") | (F.abs("aicc") == float("inf")), 1e12).otherwise(F.coalesce("aicc", F.lit(1e12)))

    def low_is_good(col):
        lo, hi = F.min(col).over(w), F.max(col).over(w)
        return F.when(hi - lo < 1e-12, 1.0).otherwise(1.0 - (F.col(col) - lo) / (hi - lo))

    e = entries.withColumn("_ic", ic).withColumn("_rt", F.log1p("runtime_s"))
    parts = {
        "blind_r2": clip(F.coalesce("blind_r2", F.lit(-1.0)), 0.0, 1.0),
        "mape": clip(1.0 - F.coalesce("blind_mape", F.lit(100.0)) / 50.0, 0.0, 1.0),
        "aicc": low_is_good("_ic"),
        "stability": clip(1.0 - F.col("spread") / 0.5, 0.0, 1.0),
        "plausibility": F.when(F.col("plausible"), 1.0).otherwise(0.0),
        "runtime": low_is_good("_rt"),
    }
    e = e.withColumns({f"c_{k}": v for k, v in parts.items()})
    total = F.lit(0.0)
    for name, weight in cfg.weights:
        total = total + weight * F.col(f"c_{name}")
    return e.withColumn("score", total).drop("_ic", "_rt")


def leaderboard(scored: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rank by score, then fewer parameters, then name; excluded variants follow with their reason."""
    order = Window.partitionBy("field").orderBy(F.desc("score"), "n_params", "model")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("excluded", F.lit(None).cast("string"))
    return ranked if excluded is None else ranked.unionByName(excluded, allowMissingColumns=True)


def ensemble_weights(ranked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Weights of the leading plausible models close to the winner; the winner alone when there are fewer than two."""
    w = Window.partitionBy("field")
    r = ranked.where(F.col("rank").isNotNull()).withColumn("_top", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w))
    member = (F.col("rank") <= cfg.ensemble_top_n) & (F.col("_top") - F.col("score") <= cfg.ensemble_gap) & F.col("plausible")
    r = r.withColumn("_in", member).withColumn("_n", F.count_if("_in").over(w))
    r = r.withColumn("_in", F.when(F.col("_n") > 1, F.col("_in")).otherwise(F.col("rank") == 1)).where("_in")
    s = F.greatest("score", F.lit(1e-9))
    return r.select("field", "model", F.when(F.col("_n") > 1, s / F.sum(s).over(w)).otherwise(1.0).alias("weight"))


def ensemble_prediction(pred: DataFrame, weights: DataFrame, model: str = "member") -> DataFrame:
    p = pred.join(weights.withColumnRenamed("model", model), ["field", model])
    return p.groupBy("field", "producer", "step").agg(F.sum(F.col("weight") * F.col("pred")).alias("pred"))


def confidence_badge(winner: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """HIGH, MEDIUM or LOW with reasons.  winner: field, blind_r2, spread, plausible, n_warnings."""
    r2, sp, warn, ok = F.col("blind_r2"), F.col("spread"), F.col("n_warnings"), F.col("plausible")
    high = (r2 >= cfg.high_r2) & (sp < cfg.high_spread) & (warn <= 0) & ok
    medium = ((r2 >= cfg.medium_r2) & (warn <= cfg.medium_max_warnings) & ok) | ((r2 >= cfg.high_r2) & (warn <= cfg.medium_max_warnings))
    why = F.concat_ws(
        "; ", F.when(r2 < cfg.high_r2, F.concat(F.lit("blind r2 "), F.format_string("%.2f", r2))),
        F.when(sp >= cfg.high_spread, F.concat(F.lit("spread "), F.format_string("%.2f", sp))),
        F.when(warn > 0, F.concat(F.lit("warnings "), warn)), F.when(~ok, F.lit("not plausible")),
    )
    no = F.lit(False)
    badge = F.when(F.coalesce(high, no), "HIGH").when(F.coalesce(medium, no), "MEDIUM").otherwise("LOW")
    return winner.withColumn("badge", badge).withColumn("reasons", F.when(F.col("badge") == "HIGH", "").otherwise(why))


def run_confidence(badges: DataFrame, keys: list[str]) -> DataFrame:
    """Worst badge of the last window.  badges: keys, window_id, badge."""
    last = badges.groupBy(*keys).agg(F.max("window_id").alias("window_id"))
    b = badges.join(last, [*keys, "window_id"])
    return b.groupBy(*keys).agg(F.min_by("badge", rank_value(F.col("badge"), {"LOW": 0, "MEDIUM": 1, "HIGH": 2})).alias("confidence"))


# ---------------------------------------------------------------------------------------------- spread
def pair_spread(member_pairs: DataFrame) -> DataFrame:
    """Mean, spread and percentiles of each coupling over the members (a dozen at most)."""
    q = F.percentile("f", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = member_pairs.groupBy("field", "injector", "producer").agg(F.avg("f").alias("f_mean"), F.stddev_pop("f").alias("f_std"), q.alias("q"))
    return g.select(
        "field", "injector", "producer", "f_mean", "f_std", F.col("q")[0].alias("f_p10"), F.col("q")[1].alias("f_p50"), F.col("q")[2].alias("f_p90")
    )


def parameter_spread(member_pairs: DataFrame, member_params: DataFrame) -> DataFrame:
    ps = pair_spread(member_pairs).withColumn("w", F.greatest("f_mean", F.lit(0.0)))
    f = ps.groupBy("field").agg(
        F.sum(F.col("f_std") * F.col("w")).alias("sw"), F.sum(F.col("f_mean") * F.col("w")).alias("mw"), F.sum("w").alias("w")
    )
    t = member_params.groupBy("field", "producer").agg(
        F.avg("tau").alias("m"), F.stddev_pop("tau").alias("s"), F.count(F.lit(1)).alias("n")
    ).groupBy("field").agg(F.avg(F.col("s") / F.greatest("m", F.lit(1e-9))).alias("t"), F.max("n").alias("n_members"))
    spread = F.when(F.col("w") > 0, (F.col("sw") / F.col("w")) / F.greatest(F.col("mw") / F.col("w"), F.lit(1e-9))).otherwise(0.0)
    return f.join(t, "field").select(
        "field", spread.alias("f_spread"), F.when(F.col("n_members") > 1, F.col("t")).otherwise(0.0).alias("tau_spread"), "n_members"
    )


def prediction_band(pred: DataFrame) -> DataFrame:
    q = F.percentile("pred", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    b = pred.groupBy("field", "producer", "step").agg(q.alias("q"))
    return b.select("field", "producer", "step", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def pair_confidence(member_pairs: DataFrame) -> DataFrame:
    s = pair_spread(member_pairs)
    c = F.when(F.col("f_mean") <= 1e-3, 1.0).otherwise(clip(1.0 - F.col("f_std") / F.col("f_mean"), 0.0, 1.0))
    return s.select("field", "injector", "producer", c.alias("confidence"))
