"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Canonical table schemas.
SCHEMAS = {
    "rates": "field string, well string, date date, q_oil double, q_water double, q_gas double, q_inj double, days_on double",
    "pressure": "field string, well string, date date, bhp double, whp double, src string, depth double",
    "coords": "field string, well string, x double, y double, tvd double",
    "category": "well string, field string, reservoir string, block string, alloc_factor double",
    "events": "field string, well string, date date, type string, note string",
}
BAD_ROW = "bad_row"


def read_csv(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """CSV with a header: columns are taken by name, in any order; a column that the file lacks is null, others are left out.

    Values that do not fit their type become null instead of stopping the job; with ``keep_bad`` such a row keeps its text in
    ``bad_row``.  A row with too few or too many values counts as bad as well.  Part files that disagree on the header stop the read.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [f"_{k}" for k in range(len(header))]
    texts = ", ".join([*(f"`{c.replace('`', '``')}` string" for c in header), f"{BAD_ROW} string"])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    rows = reader.option("columnNameOfCorruptRecord", BAD_ROW).schema(texts).csv(path).toDF(*names, BAD_ROW)
    wanted = StructType.fromDDL(schema)
    at = {c.strip(): n for n, c in reversed([*zip(names, header)])}
    text = {f.name: F.col(at[f.name]) if f.name in at else F.lit(None).cast("string") for f in wanted}
    value = {f.name: text[f.name].try_cast(f.dataType) for f in wanted}
    out = [value[f.name].alias(f.name) for f in wanted]
    if not keep_bad:
        return rows.select(*out)
    unfit = F.lit(False)
    for f in wanted:
        unfit = unfit | (text[f.name].isNotNull() & value[f.name].isNull())
    line = F.concat_ws(",", *[F.coalesce(n, F.lit("")) for n in names])
    return rows.select(*out, F.coalesce(BAD_ROW, F.when(unfit, line)).alias(BAD_ROW))


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Tables of a folder, one path per name; unnamed means all canonical tables."""
    out = {}
    for name in names or list(SCHEMAS):
        path = f"{folder.rstrip('/')}/{name}.{fmt}"
        out[name] = spark.read.parquet(path) if fmt == "parquet" else read_csv(spark, path, SCHEMAS[name])
    return out
