"""Tidy result tables and display units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.units import factor
from wellspan.operators.gates import n_blind

# Display unit per kind and unit system.
DISPLAY = {
    "field": {"rate": "bbl/d", "volume": "bbl", "pressure": "psi"},
    "metric": {"rate": "m3/d", "volume": "m3", "pressure": "kPa"},
}
INTERNAL = {"rate": "m3/d", "volume": "m3", "pressure": "kPa"}


def display(col: Column, kind: str, system: str = "field") -> Column:
    return col * factor(INTERNAL[kind], DISPLAY[system][kind])


def wells(coverage: DataFrame, entities: DataFrame, types: DataFrame, sectors: DataFrame, sources: DataFrame) -> DataFrame:
    e = entities.join(coverage, ["field", "entity"]).join(types.select("field", "well", "type"), ["field", "well"], "left")
    e = e.join(sectors.select("field", "entity", "sector"), ["field", "entity"], "left").join(sources.select("field", "well", "source"), ["field", "well"], "left")
    return e.select("field", "entity", "type", "sector", "x", "y", F.col("coverage").alias("coverage_fraction"), F.coalesce("source", F.lit("")).alias("pressure_source"))


def connectivity(pairs: DataFrame, confidence: DataFrame) -> DataFrame:
    return pairs.join(confidence, ["field", "injector", "producer"], "left").select(
        "field", "injector", "producer", F.col("f").alias("f_ij"), F.col("confidence").alias("pair_confidence"), F.col("d").alias("distance_m")
    )


def tau(params: DataFrame, report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Time constants beside the scores of each model that ``keys`` name."""
    return params.join(report, ["field", "producer"], "left").select(
        "field", *(keys or []), "producer", F.col("tau").alias("tau_days"), "blind_r2", F.col("blind_mape").alias("blind_mape_pct")
    )


def history_match(cleaned: DataFrame, pred: DataFrame, system: str = "field", cfg: Settings = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Measured, cleaned and modelled rates by date, for each model that ``keys`` name."""
    c = cleaned.where(F.col("role") == "P").select("field", F.col("entity").alias("producer"), "step", "date", "n_steps", "liq_raw", "liq", "oil", "water")
    r = c.join(pred.select("field", *(keys or []), "producer", "step", "pred"), ["field", "producer", "step"], "left")
    d = lambda c: display(F.col(c), "rate", system)
    return r.select(
        "field", *(keys or []), "producer", "date", d("liq_raw").alias("raw_liquid"), d("liq").alias("cleaned_liquid"), d("pred").alias("model_liquid"),
        d("oil").alias("oil"), d("water").alias("water"), (F.col("step") >= F.col("n_steps") - n_blind(F.col("n_steps"), cfg)).alias("blind"),
    )


def forecast_field(fan: DataFrame, cal: DataFrame, plan: str, base: str, system: str = "field") -> DataFrame:
    """Plan and base bands side by side."""
    pick = lambda p, q: F.max(F.when(F.col("plan") == p, display(F.col(q), "rate", system)))
    cols = [pick(p, q).alias(f"{name}_{q}") for name, p in (("plan", plan), ("base", base)) for q in ("p10", "p50", "p90")]
    return fan.where(F.col("plan").isin(plan, base)).groupBy("field", "h").agg(*cols).join(cal.select("field", "h", "date"), ["field", "h"]).drop("h")


def rates(recommended: DataFrame, implemented: DataFrame, system: str = "field") -> DataFrame:
    k = ["field", "injector"]
    i = implemented.select(*k, display(F.col("rate"), "rate", system).alias("implemented"))
    return recommended.select(*k, display(F.col("rate"), "rate", system).alias("recommended")).join(i, k, "left")


def run_table(facts: dict[str, Column], df: DataFrame) -> DataFrame:
    """Item / value rows describing a run."""
    rows = F.array(*[F.struct(F.lit(k).alias("item"), v.cast("string").alias("value")) for k, v in facts.items()])
    return df.select("field", F.explode(rows).alias("r")).select("field", "r.item", "r.value")


def dt_tau_table(profile: DataFrame, tau_est: Column) -> DataFrame:
    """Step length against time constant and the history needed for a reliable fit."""
    return profile.select(
        "field", "dt_days", tau_est.alias("tau_days"), (tau_est / F.col("dt_days")).alias("tau_over_dt"), "od",
        F.ceil(6.0 * (F.col("n_inj") + 1)).alias("history_needed"),
    )
