"""Filters and listings over wells and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan.operators.roles import WELL, well_types


def category_filter(rates: DataFrame, category: DataFrame, **chosen: str | None) -> DataFrame:
    """Rates of the wells whose category row matches every given level (field, reservoir, block)."""
    c = category
    for level, value in chosen.items():
        if value is not None:
            c = c.where(F.col(level) == value)
    return rates.join(c.select(*WELL), WELL, "left_semi")


def well_subset(rates: DataFrame, wells: list[str]) -> DataFrame:
    return rates.where(F.col("well").isin(*wells))


def well_listing(rates: DataFrame, coords: DataFrame, pressure: DataFrame) -> DataFrame:
    located = coords.select(*WELL).distinct().withColumn("has_coords", F.lit(True))
    gauged = pressure.select(*WELL).distinct().withColumn("has_pressure", F.lit(True))
    no = F.lit(False)
    return well_types(rates).join(located, WELL, "left").join(gauged, WELL, "left").select(
        *WELL, "type", "first", "last", "n_active", "n_simultaneous",
        F.coalesce("has_coords", no).alias("has_coords"), F.coalesce("has_pressure", no).alias("has_pressure"),
    )


def category_tree(category: DataFrame) -> DataFrame:
    """Sorted blocks per field and reservoir."""
    return category.where(F.col("field").isNotNull()).groupBy("field", "reservoir").agg(
        F.array_sort(F.collect_set("block")).alias("blocks")
    )
