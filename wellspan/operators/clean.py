"""Cleaning on the dense grid: caps and isolated-spike replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.numeric import sorted_median
from wellspan.operators.grid import ENTITY


def cap_negatives(grid: DataFrame) -> DataFrame:
    """Negative rates become zero; liquid follows only from the reservoir step, as recorded."""
    floor = lambda c: F.greatest(F.col(c), F.lit(0.0))
    return grid.withColumns({"oil": floor("oil"), "water": floor("water"), "inj": floor("inj")})


def negative_report(grid: DataFrame) -> DataFrame:
    """Rows with a negative rate per entity; a producer row counts once."""
    neg = F.when(F.col("role") == "P", (F.col("oil") < 0) | (F.col("water") < 0)).otherwise(F.col("inj") < 0)
    return grid.groupBy("field", "entity").agg(F.count_if(neg).alias("n_negative"))


def hampel(grid: DataFrame, value: str, usable: Column, window: int, k: float, min_rel: float, out: str) -> DataFrame:
    """Replace an isolated spike by the local median.

    The window is positional on the dense grid and reads usable points only.  A spike must also stand off from every
    usable direct neighbour, so a lasting change of level stays.
    """
    half = max(1, window // 2)
    w = Window.partitionBy(*ENTITY).orderBy("step")
    x = F.when(usable, F.col(value))
    med, mad = F.col("_med"), F.col("_mad")
    g = (
        grid.withColumn("_x", x)
        .withColumn("_seg", F.collect_list("_x").over(w.rowsBetween(-half, half)))
        .withColumn("_prev", F.lag("_x").over(w))
        .withColumn("_next", F.lead("_x").over(w))
        .withColumn("_med", sorted_median(F.col("_seg")))
        .withColumn("_mad", 1.4826 * sorted_median(F.transform("_seg", lambda v: F.abs(v - F.col("_med")))))
    )
    off = lambda nb: F.coalesce(F.abs(F.col("_x") - nb) > k * mad, F.lit(True))
    spike = (
        F.col("_x").isNotNull() & (F.size("_seg") >= 3) & (mad > 0) & (F.abs(F.col("_x") - med) > k * mad)
        & (F.abs(F.col("_x") - med) >= min_rel * F.abs(med))
        & (F.col("_prev").isNotNull() | F.col("_next").isNotNull()) & off(F.col("_prev")) & off(F.col("_next"))
    )
    spike = F.coalesce(spike, F.lit(False))
    return g.withColumn(out, F.when(spike, med).otherwise(F.col(value))).withColumn("is_spike", spike).drop(
        "_x", "_seg", "_prev", "_next", "_med", "_mad"
    )


def clean_grid(grid: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Capped and spike-free grid.  Oil and water move with the liquid, so water cut is kept; raw columns stay.
    Injection is an input and never smoothed."""
    g = grid.withColumns({f"{c}_raw": F.col(c) for c in ("oil", "water", "liq", "inj")})
    usable = (F.col("role") == "P") & (F.col("days_on") > 0) & (F.col("liq") > 0)
    g = hampel(cap_negatives(g), "liq", usable, cfg.hampel_window, cfg.hampel_k, cfg.hampel_min_rel_dev, "liq_clean")
    scale = F.when(F.col("liq") > 0, F.col("liq_clean") / F.col("liq")).otherwise(1.0)
    g = g.withColumns({"oil": F.col("oil") * scale, "water": F.col("water") * scale})
    return g.withColumn("liq", F.col("liq_clean")).drop("liq_clean")


def outlier_report(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("field", "entity").agg(F.count_if("is_spike").alias("n_replaced"))
