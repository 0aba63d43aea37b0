"""Flowing pressure on the grid, by kind of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.units import KPA_PER_M_FROM_PSI_FT, mixture_gradient, water_cut
from wellspan.operators.clean import hampel
from wellspan.operators.grid import ENTITY

# Words that identify a source, in order of priority.
SOURCE_WORDS = {
    "static": ("STATIC", "SBHP", "SURVEY", "SHUT-IN", "SHUTIN", "PBU"),
    "esp": ("ESP", "PIP", "INTAKE", "PUMP"),
    "gauge": ("GAUGE", "DHG", "PDG", "DOWNHOLE", "PERMANENT"),
    "whp": ("WHP", "THP", "WELLHEAD"),
}
# Preference among the sources of a field.
SOURCE_ORDER = ("gauge", "esp", "whp", "static", "none")


def classify_source(src: Column, has_bhp: Column, has_whp: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(src, F.lit(""))))
    hit = lambda kind: s.rlike("|".join(SOURCE_WORDS[kind]))
    return (
        F.when(hit("static"), "static").when(hit("esp"), "esp").when(hit("gauge"), "gauge")
        .when(hit("whp") | (has_whp & ~has_bhp), "whp").when(has_bhp, "gauge").otherwise("none")
    )


def well_pressure_source(pressure: DataFrame) -> DataFrame:
    """Most frequent source label per well (smallest label on a tie), classified.  Labels are counted first, so a
    well with very many readings is reduced map-side."""
    per = pressure.groupBy("field", "well", "src").agg(
        F.count(F.lit(1)).alias("n"), F.count("bhp").alias("n_bhp"), F.count("whp").alias("n_whp")
    )
    label = F.when(F.col("src").isNotNull(), F.struct(-F.col("n"), F.col("src")))
    w = per.groupBy("field", "well").agg(
        F.min_by("src", label).alias("src"), F.sum("n_bhp").alias("n_bhp"), F.sum("n_whp").alias("n_whp")
    )
    return w.select(
        "field", "well", "src", classify_source(F.col("src"), F.col("n_bhp") > 0, F.col("n_whp") > 0).alias("source")
    )


def field_pressure_source(producers: DataFrame, sources: DataFrame) -> DataFrame:
    """First present source kind per field over its producers."""
    p = producers.join(sources.select("field", "well", "source"), ["field", "well"], "left")
    order = F.create_map(*[x for i, s in enumerate(SOURCE_ORDER) for x in (F.lit(s), F.lit(i))])
    src = F.coalesce("source", F.lit("none"))
    return p.groupBy("field").agg(F.min_by(src, F.element_at(order, src)).alias("pressure_source"))


def monthly_pressure(pressure: DataFrame) -> DataFrame:
    """Mean per well and calendar month."""
    return pressure.groupBy("field", "well", F.trunc("date", "MM").alias("date")).agg(
        F.avg("bhp").alias("bhp"), F.avg("whp").alias("whp")
    )


def pressure_on_grid(grid: DataFrame, pressure: DataFrame) -> DataFrame:
    """Monthly pressure of the producers, matched where the grid date is the month start."""
    p = grid.where(F.col("role") == "P")
    return p.join(monthly_pressure(pressure), ["field", "well", "date"], "left")


def with_whp_gate(on_grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Mark producers whose wellhead pressure varies enough to stand in for flowing pressure."""
    w = Window.partitionBy(*ENTITY)
    s = on_grid.withColumns({
        "n": F.count("whp").over(w), "mean_whp": F.avg("whp").over(w), "std_whp": F.stddev_pop("whp").over(w),
    })
    ok = (F.col("n") > 3) & (F.col("mean_whp") > 0) & (F.col("std_whp") / F.col("mean_whp") >= cfg.whp_variation_min)
    return s.withColumn("usable", F.coalesce(ok, F.lit(False)))


def whp_gate(on_grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The gate as one row per producer."""
    s = with_whp_gate(on_grid, cfg)
    return s.groupBy(*ENTITY).agg(*[F.max(c).alias(c) for c in ("n", "mean_whp", "std_whp", "usable")])


def esp_clean(on_grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Spike-free intake pressure on the valid points."""
    valid = F.col("bhp").isNotNull() & (F.col("bhp") > 0)
    return hampel(on_grid, "bhp", valid, cfg.esp_hampel_window, cfg.hampel_k, 0.0, "bhp_clean")


def intake_depth(pressure: DataFrame) -> DataFrame:
    """Depth of the earliest reading that has one."""
    d = pressure.where(F.col("depth").isNotNull())
    return d.groupBy("field", "well").agg(F.min_by("depth", F.struct("date", "depth")).alias("intake"))


def depth_correction(
    series: DataFrame, value: str, coords: DataFrame, pressure: DataFrame, datum: float | None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Shift ESP intake pressure to mid-perforation, then every source to the datum.  Gradients are given per foot in
    psi and converted to the column units."""
    s = series.join(coords.select("field", "well", "tvd"), ["field", "well"], "left").join(
        intake_depth(pressure), ["field", "well"], "left"
    )
    cut = water_cut(F.col("oil"), F.col("water"))
    grad = mixture_gradient(cut, cfg.gradient_water_psi_ft, cfg.gradient_oil_psi_ft) * KPA_PER_M_FROM_PSI_FT
    shift = F.when(F.col("source") == "esp", F.coalesce(grad * (F.col("tvd") - F.col("intake")), F.lit(0.0))).otherwise(0.0)
    out = F.col(value) + shift
    if datum is not None:
        g = cfg.datum_gradient_psi_ft * KPA_PER_M_FROM_PSI_FT
        out = out + F.coalesce(g * (F.lit(datum) - F.col("tvd")), F.lit(0.0))
    return s.withColumn("p_datum", out)


def fill_pressure(df: DataFrame, value: str, out: str) -> DataFrame:
    """Carry the last value forward; before the first one take the first.  Both passes grow from one end."""
    w = Window.partitionBy(*ENTITY).orderBy("step")
    ahead = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col("step"))).over(Window.partitionBy(*ENTITY))
    return df.withColumn(out, F.coalesce(ahead, first))


def prepare_pressure(
    grid: DataFrame, pressure: DataFrame, coords: DataFrame, datum: float | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Flowing pressure per producer and step; producers without any get zero when the field has some, else NULL."""
    src = well_pressure_source(pressure).select("field", "well", "source")
    g = pressure_on_grid(grid, pressure).join(src, ["field", "well"], "left")
    g = g.withColumn("source", F.coalesce("source", F.lit("none")))
    g = esp_clean(with_whp_gate(g, cfg), cfg)
    p = (
        F.when(F.col("source") == "esp", F.col("bhp_clean")).when(F.col("source") == "gauge", F.col("bhp"))
        .when((F.col("source") == "whp") & F.col("usable"), F.col("whp"))
    )
    g = depth_correction(g.withColumn("p", p), "p", coords, pressure, datum, cfg)
    g = g.withColumn("p_datum", F.when(F.col("source") == "whp", F.col("p")).otherwise(F.col("p_datum")))
    g = fill_pressure(g, "p_datum", "pwf")
    has = g.groupBy("field").agg(F.bool_or(F.col("pwf").isNotNull()).alias("any_dynamic"))
    g = g.join(has, "field")
    return g.withColumn("pwf", F.coalesce("pwf", F.when(F.col("any_dynamic"), F.lit(0.0)))).drop("any_dynamic", "p")


def dpdt(df: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy(*ENTITY).orderBy("step")
    slope = (F.col(value) - F.lag(value).over(w)) / F.col("dt_days")
    return df.withColumn("dpdt", F.when(F.col("step") == 0, 0.0).otherwise(slope))


def static_surveys(pressure: DataFrame) -> DataFrame:
    """Static readings averaged over the field per month."""
    static = classify_source(F.col("src"), F.lit(True), F.lit(True)) == "static"
    s = pressure.where(static & F.col("bhp").isNotNull())
    return s.groupBy("field", F.trunc("date", "MM").alias("date")).agg(F.avg("bhp").alias("p_static"))
