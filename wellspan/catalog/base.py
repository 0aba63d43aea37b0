"""Shared chains from the bound tables to the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan.operators import clean, grid, roles
from wellspan.sources.bindings import Tables


def entity_rates(t: Tables) -> DataFrame:
    return roles.split_roles(t.rates())


def raw_grid(t: Tables) -> DataFrame:
    return grid.build_grid(entity_rates(t))


def cleaned(t: Tables) -> DataFrame:
    return clean.clean_grid(raw_grid(t))


def entities(t: Tables) -> DataFrame:
    return entity_rates(t).select("field", "well", "entity", "role").distinct()


def located(t: Tables) -> DataFrame:
    """Entities with coordinates."""
    return entities(t).join(t.coords().select("field", "well", "x", "y"), ["field", "well"])
