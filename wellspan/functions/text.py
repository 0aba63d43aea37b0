"""Identifier and date text handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date layouts in the order they are tried, each with the shape of text it can fit.
DATE_LAYOUTS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d-MMM-yy", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"),
    ("MMM-yy", r"^[A-Za-z]{3}-\d{2}$"),
    ("yyyyMM", r"^\d{6}$"),
    ("yyyy-M", r"^\d{4}-\d{1,2}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
)


def normalise_id(col: Column) -> Column:
    """Upper case, single spaces, no blanks around separators."""
    s = F.upper(F.regexp_replace(F.trim(F.regexp_replace(col.cast("string"), r"\s", " ")), r"\s+", " "))
    return F.regexp_replace(s, r"\s*([-_/])\s*", "$1")


def _full_year(s: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    return F.regexp_replace(F.regexp_replace(s, r"-(69|[7-9]\d)$", "-19$1"), r"-(\d\d)$", "-20$1")


def _try(s: Column, layout: str) -> Column:
    if "yy" in layout and "yyyy" not in layout:
        s, layout = _full_year(s), layout.replace("yy", "yyyy")
    return F.try_to_timestamp(s, F.lit(layout)).cast("date")


def parse_date(col: Column, layout: str | None = None) -> Column:
    """First layout that fits, else NULL.  Only layouts whose shape matches are parsed: a failed parse raises and
    catches an exception inside the engine, which is far dearer than a pattern test."""
    s = F.trim(col.cast("string"))
    if layout:
        return _try(s, layout)
    return F.coalesce(*[F.when(s.rlike(shape), _try(s, fmt)) for fmt, shape in DATE_LAYOUTS])


def base_well(entity: Column) -> Column:
    """Well name behind a role or reservoir suffix."""
    return F.regexp_extract(entity, r"^([^@#]*)", 1)
