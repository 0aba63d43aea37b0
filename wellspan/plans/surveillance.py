"""Monthly follow-up: bands, rules, evaluations, alerts and data-quality changes.

Lists of wells stay one row per well, so no rule gathers a whole field into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings

# Condition codes with their severity.
CONDITIONS = {
    "OD_LOW": "warning", "CRMIP_DATA_LOW": "info", "INJ_CV_LOW": "warning", "TAU_DT_LOW": "warning", "SUM_F_HIGH": "info",
    "NO_BHP_EVENTS_HIGH": "warning", "SIMULTANEOUS_PI": "warning", "GOR_ABOVE_RS": "warning", "MULTISTART_SPREAD_HIGH": "warning",
    "FORECAST_OUT_OF_BAND_DQ_CHANGED": "warning", "CUSUM_SHIFT": "info", "CONFIDENCE_LOW": "warning", "UNMATCHED_WELL_IDS": "warning",
    "UNMAPPED_REQUIRED_COLUMN": "error", "UNPARSEABLE_DATES": "error", "PVT_CONSTANTS_ASSUMED": "info", "COMMINGLED_EQUAL_SPLIT": "warning",
    "PRESSURE_WHP_ONLY": "warning", "PRESSURE_STATIC_ONLY": "info", "NO_PRESSURE": "info", "OUTLIERS_REMOVED": "info",
    "NEGATIVE_RATES_CAPPED": "warning", "HISTORY_SHORT": "warning", "HISTORY_TOO_SHORT": "error", "POINTS_PER_PARAM_LOW": "warning",
    "DATUM_DEPTH_MISSING": "warning", "MISSING_COORDINATES": "warning", "CONVERSION_DETECTED": "info", "LONG_SHUTIN": "info",
    "TAU_AT_BOUND": "warning", "VARIANT_NOT_AVAILABLE": "info", "RESIDUAL_AUTOCORRELATED": "info", "BLIND_FIT_POOR": "warning",
    "SUM_F_CONSTRAINT_ACTIVE": "info",
}
TEMPLATES = {
    "OUTLIERS_REMOVED": "{count} spikes replaced at {well}",
    "SIMULTANEOUS_PI": "{well} produced and injected in {steps} months",
    "CONVERSION_DETECTED": "{well} changed from {from_role} to {to_role} in {when}",
    "LONG_SHUTIN": "{well} closed for {months} months from {when}",
    "UNMATCHED_WELL_IDS": "{count} wells have no rates",
}


def conditions(events: DataFrame) -> DataFrame:
    """Severity and message for condition rows; events: code, scope, context (map of strings)."""
    sev = F.create_map(*[x for kv in CONDITIONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    tpl = F.create_map(*[x for kv in TEMPLATES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    text = F.coalesce(F.try_element_at(tpl, F.col("code")), F.col("code"))
    filled = F.aggregate(F.map_entries("context"), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return events.withColumn("severity", F.element_at(sev, F.col("code"))).withColumn("message", filled)


def forecast_band_check(actual: DataFrame) -> DataFrame:
    """actual: field, producer, actual, p10, p90, dq_changed."""
    out = (F.col("actual") < F.col("p10")) | (F.col("actual") > F.col("p90"))
    return actual.withColumn("finding", F.when(~out, "within band").when(F.col("dq_changed"), "data problem").otherwise("reservoir change"))


def due_evaluations(recs: DataFrame, today: Column, done: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Evaluation months that are due and not done.  recs: rec_id, implemented_at; done: rec_id, months_after."""
    m = recs.withColumn("months_after", F.explode(F.array(*[F.lit(x) for x in cfg.evaluation_months])))
    month = F.add_months(F.trunc("implemented_at", "MM"), F.col("months_after"))
    m = m.withColumn("due", F.date_add(month, F.least(F.dayofmonth("implemented_at"), F.lit(28)) - 1))
    return m.where(today >= F.col("due")).join(done, ["rec_id", "months_after"], "left_anti")


def surveillance_rules(checked: DataFrame, new_events: DataFrame, fields: DataFrame, due: DataFrame, today: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Ordered action rows per field.

    checked: result of the band check; new_events: field, well; fields: field, last_full_run (date or NULL);
    due: field, months_after.
    """
    row = lambda df, order, trigger, well, detail: df.select(
        "field", F.lit(order).alias("rule"), F.lit(trigger).alias("trigger"), well.cast("string").alias("well"), detail.cast("string").alias("detail")
    )
    no = F.lit(None)
    finding = lambda f: checked.where(F.col("finding") == f)
    age = F.datediff(today, F.col("last_full_run"))
    late = fields.where(F.col("last_full_run").isNull() | (age >= cfg.quarterly_days))
    parts = [
        row(fields, 1, "new month of data", no, no),
        row(finding("within band"), 2, "forecast within band", F.col("producer"), no),
        row(finding("data problem"), 3, "outside band, data changed", F.col("producer"), no),
        row(finding("reservoir change"), 4, "outside band, data unchanged", F.col("producer"), no),
        row(new_events.select("field", "well").distinct(), 5, "new event", F.col("well"), no),
        row(late, 6, "quarterly", no, no),
        row(due, 7, "evaluation due", no, F.col("months_after")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_outcome(members: DataFrame, keys: list[str], months: Column, horizon: int, realised: Column) -> DataFrame:
    """Scale the horizon's oil to the evaluation period and place the realised oil in its band."""
    part = F.least(months / horizon, F.lit(1.0))
    q = F.percentile(F.col("cum_oil") * part, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    e = members.groupBy(*keys).agg(q.alias("q"), F.max(realised).alias("realised"))
    e = e.select(*keys, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "realised")
    return e.withColumn("outcome", outcome(F.col("realised"), F.col("p10"), F.col("p90")))


def outcome(realised: Column, p10: Column, p90: Column) -> Column:
    return F.when(realised > p90, "better").when(realised < p10, "worse").otherwise("within band")


def hit_rate(records: DataFrame) -> DataFrame:
    """Shares of outcomes per confidence badge."""
    share = lambda o: F.avg((F.col("outcome") == o).cast("double"))
    return records.groupBy("badge").agg(
        F.count(F.lit(1)).alias("n"), share("within band").alias("within_band"), share("better").alias("better"), share("worse").alias("worse")
    )


def recalibrate_threshold(hits: DataFrame, current: float, target: float = 0.8, step: float = 0.02) -> DataFrame:
    """Raise the HIGH floor while too few HIGH forecasts land in their band."""
    low = (F.col("n") >= 5) & (F.col("within_band") + F.col("better") < target)
    h = hits.where(F.col("badge") == "HIGH")
    return h.select("n", F.when(low, F.least(F.lit(current + step), F.lit(0.99))).otherwise(current).alias("threshold"))


def implementation_deviation(recommended: DataFrame, actual: DataFrame) -> DataFrame:
    k = ["field", "injector"]
    a = actual.select(*k, F.col("rate").alias("actual"))
    d = recommended.join(a, k, "left").withColumn("deviation", F.coalesce("actual", F.col("rate")) - F.col("rate"))
    return d.where(F.abs("deviation") > 1e-9).select(*k, F.col("rate").alias("recommended"), "actual", "deviation")


# Allowed state changes (from, action, to).
TRANSITIONS = (
    ("DRAFT", "review", "REVIEWED"), ("REVIEWED", "approve", "APPROVED"), ("REVIEWED", "reject", "REJECTED"),
    ("DRAFT", "reject", "REJECTED"), ("APPROVED", "implement", "IMPLEMENTED"), ("IMPLEMENTED", "evaluate", "EVALUATED"),
)


def lifecycle_check(history: DataFrame) -> DataFrame:
    """History rows that are not an allowed transition.  history: rec_id, seq, action, to_state; a recommendation has
    at most a handful of rows."""
    w = Window.partitionBy("rec_id").orderBy("seq")
    h = history.withColumn("from_state", F.coalesce(F.lag("to_state").over(w), F.lit("DRAFT")))
    legal = F.array(*[F.lit("|".join(x)) for x in TRANSITIONS])
    return h.where(~F.array_contains(legal, F.concat_ws("|", "from_state", "action", "to_state")))


def revert_alerts(items: DataFrame, connected: DataFrame, cut_now: DataFrame, cut_then: DataFrame, jump: float) -> DataFrame:
    """Changes whose connected producers got wetter.  The producers of one injector are bounded by its radius."""
    c = connected.join(cut_now, ["field", "producer"], "left").join(cut_then, ["field", "producer"], "left")
    rise = F.coalesce("cut_now", F.lit(0.0)) - F.coalesce("cut_then", F.lit(0.0))
    hit = c.where(rise > jump).join(items.select("field", "injector", "rate_from"), ["field", "injector"])
    return hit.groupBy("field", "injector", "rate_from").agg(F.array_sort(F.collect_list("producer")).alias("producers"))


def dq_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose value changed, appeared or went away between two reports (keys, value)."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return b.join(a, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def alerts_union(groups: list[DataFrame]) -> DataFrame:
    """Union of alerts (field, kind, message, severity, seq), the first of each (kind, message) kept."""
    out = groups[0].withColumn("_g", F.lit(0))
    for i, g in enumerate(groups[1:], start=1):
        out = out.unionByName(g.withColumn("_g", F.lit(i)))
    first = F.min_by(F.struct("field", "severity"), F.struct("_g", "seq"))
    return out.groupBy("kind", "message").agg(first.alias("r")).select("kind", "message", "r.field", "r.severity")


def dq_report(grid: DataFrame, outliers: DataFrame, types: DataFrame, unmatched: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Data quality per field.  outliers: field, entity, n_replaced; types: field, n_simultaneous; unmatched: field, well."""
    cov = grid.groupBy("field").agg(
        F.avg((F.col("days_on") > 0).cast("double")).alias("mean_coverage"), F.max("n_steps").alias("n_steps")
    )
    o = outliers.groupBy("field").agg(F.sum("n_replaced").alias("outliers_removed"))
    s = types.groupBy("field").agg(F.sum("n_simultaneous").alias("simultaneous_steps"), F.count_if(F.col("n_simultaneous") > 0).alias("_sim"))
    u = unmatched.groupBy("field").agg(F.count(F.lit(1)).alias("unmatched_ids"))
    z = lambda c: F.coalesce(c, F.lit(0))
    r = cov.join(o, "field", "left").join(s, "field", "left").join(u, "field", "left")
    short = F.col("n_steps") < cfg.min_steps
    n_warn = z("_sim") + (z("unmatched_ids") > 0).cast("int") + short.cast("int")
    light = F.when(F.col("n_steps") < cfg.min_steps_hard, "red").when(n_warn > 0, "amber").otherwise("green")
    return r.select(
        "field", "mean_coverage", "n_steps", z("outliers_removed").alias("outliers_removed"), z("simultaneous_steps").alias("simultaneous_steps"),
        z("unmatched_ids").alias("unmatched_ids"), n_warn.alias("n_warnings"), light.alias("traffic_light"),
    )


def coverage(grid: DataFrame) -> DataFrame:
    return grid.groupBy("field", "entity").agg(F.avg((F.col("days_on") > 0).cast("double")).alias("coverage"))


def backtest_origins(pred: DataFrame, first_origin: int, every: int, horizon: int, keys: list[str] | None = None) -> DataFrame:
    """Forecast beside actual from rolling origins: keys, origin, producer, h, forecast, actual.

    At an origin the model is lifted to the observed level of the last three steps before it and run ahead.  A step
    belongs to the few origins whose horizon covers it.
    """
    ks = keys or ["field"]
    w = Window.partitionBy(*ks, "producer").orderBy("step")
    past = w.rowsBetween(-3, -1)
    on = F.col("on") & (F.col("liq") > 0) & (F.col("pred") > 0)
    p = pred.withColumn("_o", F.avg(F.when(on, F.col("liq"))).over(past)).withColumn("_f", F.avg(F.when(on, F.col("pred"))).over(past))
    level = F.coalesce(F.least(F.greatest(F.col("_o") / F.col("_f"), F.lit(0.5)), F.lit(2.0)), F.lit(1.0))
    p = p.withColumn("_level", level)
    last = F.floor((F.col("step") - first_origin) / every)
    k = F.filter(F.sequence(F.greatest(last - (horizon // every) - 1, F.lit(0)), F.greatest(last, F.lit(0))), lambda i: (i * every + first_origin <= F.col("step")) & (F.col("step") < i * every + first_origin + horizon))
    at = p.where((F.col("step") >= first_origin) & F.col("on")).withColumn("origin", F.explode(F.transform(k, lambda i: (i * every + first_origin).cast("int"))))
    lv = p.select(*ks, "producer", F.col("step").alias("origin"), F.col("_level").alias("lv"))
    out = at.join(lv, [*ks, "producer", "origin"])
    return out.select(
        *ks, "origin", "producer", (F.col("step") - F.col("origin") + 1).alias("h"), (F.col("pred") * F.col("lv")).alias("forecast"), F.col("liq").alias("actual")
    )


def backtest_summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Forecast over actual by horizon month."""
    ks = keys or ["field"]
    s = rows.groupBy(*ks, "h").agg(F.sum("forecast").alias("f"), F.sum("actual").alias("a"), F.count(F.lit(1)).alias("n"))
    return s.select(*ks, "h", F.when(F.col("a") > 0, F.col("f") / F.col("a")).alias("ratio"), "n")
