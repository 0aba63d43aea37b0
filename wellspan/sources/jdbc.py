"""Reads from and appends to relational databases.

The drivers are the user's; nothing here starts a database.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}$")
# Supported kinds and their drivers.
DRIVERS = {
    "sqlite": "org.sqlite.JDBC",
    "postgresql": "org.postgresql.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
}


@dataclass(frozen=True)
class Connection:
    kind: str
    url: str
    user: str | None = None
    password: str | None = None
    options: dict[str, str] = dc_field(default_factory=dict)

    def as_options(self) -> dict[str, str]:
        if self.kind not in DRIVERS:
            raise ValueError(f"unsupported database {self.kind!r}")
        out = {"url": self.url, "driver": DRIVERS[self.kind], **self.options}
        if self.user is not None:
            out["user"] = self.user
        if self.password is not None:
            out["password"] = self.password
        return out


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def check_query(sql: str) -> str:
    """One read-only statement: SELECT or WITH, no separator."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with)\b", text) or ";" in text:
        raise ValueError("only a single SELECT or WITH query is allowed")
    return text


@dataclass(frozen=True)
class Split:
    """Column and range by which a table is read in parallel."""

    column: str
    lower: str
    upper: str
    parts: int

    def as_options(self) -> dict[str, str]:
        return {
            "partitionColumn": check_identifier(self.column), "lowerBound": str(self.lower), "upperBound": str(self.upper),
            "numPartitions": str(self.parts),
        }


def read_table(spark: SparkSession, conn: Connection, table: str, split: Split | None = None, limit: int | None = None) -> DataFrame:
    """A table; filters and columns used later are pushed to the database.  ``split`` reads it with many tasks."""
    opts = {**conn.as_options(), "dbtable": check_identifier(table), "fetchsize": conn.options.get("fetchsize", "10000")}
    if split is not None:
        opts.update(split.as_options())
    df = spark.read.format("jdbc").options(**opts).load()
    return df if limit is None else df.limit(limit)


def read_query(spark: SparkSession, conn: Connection, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**conn.as_options(), query=check_query(sql)).load()


def read_subset(spark: SparkSession, conn: Connection, tables: list[str], splits: dict[str, Split] | None = None) -> dict[str, DataFrame]:
    return {name: read_table(spark, conn, name, (splits or {}).get(name)) for name in tables}


def append_table(df: DataFrame, conn: Connection, table: str) -> None:
    """Append rows; the table is created by the first write."""
    df.write.format("jdbc").options(**conn.as_options(), dbtable=check_identifier(table)).mode("append").save()
