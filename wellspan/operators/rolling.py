"""Rolling refits and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings


def rolling_bounds(n_steps: DataFrame, breaks: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Windows [s, e) per field: fixed length and step, never across a break.

    n_steps: field, n_steps; breaks: field, step.  The breaks of a field are bounded by its steps.
    """
    cuts = breaks.groupBy("field").agg(F.collect_set(F.col("step").cast("int")).alias("c"))
    none = F.array().cast("array<int>")
    b = n_steps.join(cuts, "field", "left").withColumn("n", F.col("n_steps").cast("int"))
    edges = F.array_sort(F.array_union(F.filter(F.coalesce("c", none), lambda x: (x > 0) & (x < F.col("n"))), F.array(F.lit(0), F.col("n"))))
    b = b.select("field", edges.alias("edges"))
    seg = b.select("field", F.posexplode("edges").alias("i", "a"), F.col("edges")).withColumn("b", F.get("edges", F.col("i") + 1))
    seg = seg.where(F.col("b") - F.col("a") >= cfg.rolling_min)
    s = seg.withColumn("s", F.explode(F.sequence(F.col("a"), F.col("b") - cfg.rolling_min, F.lit(cfg.rolling_step))))
    s = s.where((F.col("s") == F.col("a")) | (F.col("s") - cfg.rolling_step + cfg.rolling_length < F.col("b")))
    s = s.withColumn("e", F.least(F.col("s") + cfg.rolling_length, F.col("b")))
    w = Window.partitionBy("field").orderBy("s")
    return s.select("field", (F.row_number().over(w) - 1).alias("window_id"), F.col("s").alias("step_from"), F.col("e").alias("step_to"))


def rows_in_windows(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Replicate rows into every window that holds them, with the step re-based.  The windows of a field travel as one
    short array, so this is an equi-join followed by an explode and not a range join."""
    wins = bounds.groupBy("field").agg(F.collect_list(F.struct("window_id", "step_from", "step_to")).alias("wins"))
    st = F.col("step")
    r = rows.join(wins, "field").withColumn("_w", F.explode(F.filter("wins", lambda w: (w["step_from"] <= st) & (st < w["step_to"])))).drop("wins")
    return (
        r.withColumn("window_id", F.col("_w.window_id")).withColumn("step", F.col("step") - F.col("_w.step_from"))
        .withColumn("n_steps", F.col("_w.step_to") - F.col("_w.step_from")).drop("_w")
    )


def window_blend(last: DataFrame, full: DataFrame, scores: DataFrame) -> DataFrame:
    """Couplings of the latest window and the full history mixed by their blind scores.

    last, full: field, injector, producer, f; scores: field, last_r2, full_r2.  A missing pair counts as zero.
    """
    k = ["field", "injector", "producer"]
    wl, wf = F.greatest(F.coalesce("last_r2", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("full_r2", F.lit(0.0)), F.lit(0.0))
    s = scores.select("field", F.when(wl + wf > 0, wl / (wl + wf)).otherwise(0.5).alias("w_last"))
    both = last.withColumnRenamed("f", "fl").join(full.withColumnRenamed("f", "ff"), k, "full").join(s, "field")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(*k, "w_last", (F.col("w_last") * z("fl") + (1 - F.col("w_last")) * z("ff")).alias("f"))


def cusum(series: DataFrame, keys: list[str], value: str, order: str, scale: Column, k: float = 0.5) -> DataFrame:
    """Two-sided cumulative sum against the first value, as running sum minus running minimum.

    ``up_t = P_t - min_{s <= t} P_s`` with ``P`` the running sum of ``x - k`` from zero.  Series are short, one value
    per refit.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(value).over(cum)
    s = series.withColumn("_x", (F.col(value) - first) / F.greatest(scale, F.lit(1e-12)))
    lead_in = F.row_number().over(w) == 1
    s = s.withColumns({"_a": F.when(lead_in, 0.0).otherwise(F.col("_x") - k), "_d": F.when(lead_in, 0.0).otherwise(-F.col("_x") - k)})
    s = s.withColumns({"_pa": F.sum("_a").over(cum), "_pd": F.sum("_d").over(cum)})
    out = s.withColumns({"up": F.col("_pa") - F.min("_pa").over(cum), "down": F.col("_pd") - F.min("_pd").over(cum)})
    return out.drop("_x", "_a", "_d", "_pa", "_pd")


def detect_shifts(
    series: DataFrame, keys: list[str], value: str, spread: DataFrame, floor_ref: float, words: tuple[str, str],
    connected_only: bool, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Series whose cumulative sum stays over the limit for the last windows and whose level moved by a quarter.

    series: keys, window_id, mid_date, value; spread: field, spread (median over windows, floored).
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("window_id")
    s = series.join(spread, "field").withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= cfg.shift_persist + 1)
    s = s.withColumn("_ref", F.greatest(F.first(value).over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(floor_ref)))
    s = s.withColumn("_v", F.col(value) / F.col("_ref"))
    s = cusum(s, keys, "_v", "window_id", F.col("spread"))
    s = s.withColumn("_back", F.row_number().over(w.orderBy(F.desc("window_id"))))
    up, dn = F.col("up") > cfg.shift_multiple, F.col("down") > cfg.shift_multiple
    tail = F.col("_back") <= cfg.shift_persist
    a = s.groupBy(*keys).agg(
        F.max(value).alias("vmax"), F.avg(F.when(F.col(value) > 0.02, 1.0).otherwise(0.0)).alias("connected"),
        F.max(F.when(F.col("_back") == 1, F.col("_v"))).alias("last"),
        F.count_if(tail & up).alias("u"), F.count_if(tail & dn).alias("d"),
        F.min(F.when(up, F.col("mid_date"))).alias("up_since"), F.min(F.when(dn, F.col("mid_date"))).alias("down_since"),
    )
    if connected_only:
        a = a.where((F.col("vmax") >= 0.05) & (F.col("connected") >= 0.5))
    mag = F.col("last") - 1.0
    rose = (F.col("u") == cfg.shift_persist) & (mag >= 0.25)
    fell = (F.col("d") == cfg.shift_persist) & (mag <= -0.25)
    return a.where(rose | fell).select(
        *keys, F.when(rose, words[0]).otherwise(words[1]).alias("direction"),
        F.when(rose, F.col("up_since")).otherwise(F.col("down_since")).alias("since"), mag.alias("magnitude"),
    )
