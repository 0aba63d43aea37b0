"""From source columns to the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wellspan.functions.text import normalise_id, parse_date
from wellspan.functions.units import INTERNAL, factor, kind_of, month_volume_to_day_rate

# Canonical columns, with the required ones marked.
CANONICAL = {
    "rates": {
        "well": ("string", True), "date": ("date", True), "q_oil": ("double", False), "q_water": ("double", False),
        "q_gas": ("double", False), "q_inj": ("double", False), "days_on": ("double", False), "type": ("string", False),
    },
    "pressure": {
        "well": ("string", True), "date": ("date", True), "bhp": ("double", False), "whp": ("double", False),
        "src": ("string", False), "depth": ("double", False),
    },
    "coords": {"well": ("string", True), "x": ("double", True), "y": ("double", True), "tvd": ("double", False)},
    "category": {
        "well": ("string", True), "field": ("string", False), "reservoir": ("string", False), "block": ("string", False),
        "alloc_factor": ("double", False),
    },
    "events": {"well": ("string", True), "date": ("date", True), "type": ("string", True), "note": ("string", False)},
}
RATE_COLUMNS = ("q_oil", "q_water", "q_gas", "q_inj", "days_on")


@dataclass(frozen=True)
class Mapping:
    """Source column, unit and date layout per canonical column."""

    columns: dict[str, str]
    units: dict[str, str] = dc_field(default_factory=dict)
    date_layout: str | None = None


def conform(df: DataFrame, dataset: str, mapping: Mapping, keep: tuple[str, ...] = ("field",)) -> DataFrame:
    """Rename, parse, cast and convert in one projection.  A row without a readable date is dropped."""
    spec = CANONICAL[dataset]
    named = {c: src for c, src in mapping.columns.items() if c in spec and src in df.columns}
    cols, date = [], None
    if "date" in named:
        df = df.withColumn("_date", parse_date(F.col(named["date"]), mapping.date_layout)).where(F.col("_date").isNotNull())
        date = F.col("_date")
    for name, src in named.items():
        kind = spec[name][0]
        if name == "date":
            col = date
        elif name == "well":
            col = normalise_id(F.col(src))
        elif kind == "double":
            col = convert(F.col(src).try_cast("double"), mapping.units.get(name), date)
        else:
            col = F.col(src).cast("string")
        cols.append(col.alias(name))
    extra = [F.col(c) for c in keep if c in df.columns and c not in named]
    out = df.select(*extra, *cols)
    return fill_missing_columns(out) if dataset == "rates" else out


def convert(value, tag: str | None, date=None):
    if not tag:
        return value
    if tag.endswith("/month"):
        value, tag = month_volume_to_day_rate(value, date), tag.replace("/month", "/d")
    return value * factor(tag, INTERNAL[kind_of(tag)])


def require_columns(spark: SparkSession, dataset: str, mapping: Mapping) -> DataFrame:
    """Condition rows for required columns the mapping leaves open."""
    missing = [c for c, (_, req) in CANONICAL[dataset].items() if req and c not in mapping.columns]
    if dataset == "rates" and not {"q_oil", "q_water", "q_inj"} & set(mapping.columns):
        missing.append("q_oil / q_water / q_inj")
    rows = [("UNMAPPED_REQUIRED_COLUMN", f"dataset:{dataset}", {"dataset": dataset, "field": c}) for c in missing]
    return spark.createDataFrame(rows, "code string, scope string, context map<string,string>")


def fill_missing_columns(df: DataFrame) -> DataFrame:
    """Absent rate columns as NULL doubles."""
    absent = {c: F.lit(None).cast("double") for c in RATE_COLUMNS if c not in df.columns}
    return df.withColumns(absent) if absent else df


def bad_dates(df: DataFrame, raw: str, by: list[str], layout: str | None = None) -> DataFrame:
    """Unreadable dates per group: count and the three smallest examples.  Values are counted before they are
    gathered, and only three survive, so a group with very many bad rows stays small."""
    bad = df.where(F.col(raw).isNotNull() & parse_date(F.col(raw), layout).isNull())
    per_value = bad.groupBy(*by, raw).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(raw))
    top = per_value.withColumn("rank", rank).where(F.col("rank") <= 3)
    examples = top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(raw)), ", ").alias("examples"))
    total = per_value.groupBy(*by).agg(F.sum("n").alias("n_bad"))
    return total.join(examples, by)


def apply_aliases(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace a normalised well id by its alias target; aliases: alias, target."""
    a = aliases.select(normalise_id(F.col("alias")).alias("well"), "target").dropDuplicates(["well"])
    return df.join(a, "well", "left").withColumn("well", F.coalesce("target", "well")).drop("target")


def unmatched_ids(rates: DataFrame, other: DataFrame) -> DataFrame:
    """Well ids of another table that have no rates; reported, never dropped."""
    return other.select("well").distinct().join(rates.select("well").distinct(), "well", "left_anti")


def unmatched_summary(rates: DataFrame, other: DataFrame, name: str) -> DataFrame:
    miss = unmatched_ids(rates, other)
    five = miss.orderBy("well").limit(5).agg(F.array_join(F.array_sort(F.collect_list("well")), ", ").alias("examples"))
    return miss.agg(F.count(F.lit(1)).alias("n_missing")).select(
        F.lit(name).alias("dataset"), "n_missing", five.scalar().alias("examples")
    )
