"""Result sinks: CSV, JSON and appended injection targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns of a written target.
TARGET_COLUMNS = (
    "well", "target_rate", "rate_unit", "step_this_week", "target_date", "effective_date", "recommendation_id", "run_id",
    "data_hash", "config_hash", "confidence", "approved_by", "written_by", "written_at", "note",
)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, which every sink can hold."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t == "double"})


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        finite(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def model_json(params: DataFrame, pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One record per producer: its parameters, metrics and couplings.  A producer's couplings are bounded by its
    radius; a whole field is many records, never one."""
    f = pairs.groupBy("field", "producer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("injector", "f")))).alias("f_ij"))
    return params.join(f, ["field", "producer"], "left").join(metrics, ["field", "producer"], "left")


def export_json(df: DataFrame, folder: str) -> None:
    finite(df).write.mode("overwrite").json(folder)


def approvers(history: DataFrame) -> DataFrame:
    """Actor of the latest approval per recommendation."""
    a = history.where(F.col("action") == "approve")
    return a.groupBy("recommendation_id").agg(F.max_by("actor", F.struct("at", "actor")).alias("approved_by"))


def target_rows(rates: DataFrame, history: DataFrame, written_by: str, rate_unit: str) -> DataFrame:
    """Rows to write: one per well with its approver; absent columns are NULL."""
    r = rates.join(approvers(history), "recommendation_id", "left")
    r = r.withColumns({
        "target_rate": F.round("target_rate", 3), "rate_unit": F.lit(rate_unit), "written_by": F.lit(written_by),
        "approved_by": F.coalesce("approved_by", F.lit("")),
    })
    for c in TARGET_COLUMNS:
        if c not in r.columns:
            r = r.withColumn(c, F.current_timestamp().cast("string") if c == "written_at" else F.lit(None).cast("string"))
    return r.select(*TARGET_COLUMNS)


def writeback_append_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).csv(folder)
