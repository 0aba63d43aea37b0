"""Helpers that several operators share: shared tables, let-bindings, row numbers, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wellspan.session import ensure_checkpoint_dir

#: Characters between words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folder, below the checkpoint folder, of the tables that are being written.
_TABLES: ContextVar[str] = ContextVar("tables", default="tables")


def keep_table(df: DataFrame) -> DataFrame:
    """Write to a new folder below the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, and the planner then knows the size, so a side is broadcast only after
    Spark has compared that size with its threshold.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{_TABLES.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_result(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a kept table. Tables that were kept on the way are removed once the result is written, so that what follows
    does not hold their disk; nothing else may read them."""
    ensure_checkpoint_dir(spark)
    own = f"{_TABLES.get()}/{uuid.uuid4().hex}"
    mark = _TABLES.set(own)
    try:
        made = build()
    finally:
        _TABLES.reset(mark)
    kept = keep_table(made)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{own}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return kept


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def row_numbers(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Number rows from 0 in the given order without one task seeing them all, and count them.

    Rows are dealt by range and kept as a table, so that both readings below see the same parts. Each part is numbered
    by itself and moved by the rows before it. Rows that tie on every column of ``order`` are numbered in any order.
    """
    dealt = keep_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = keep_table(sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")))  # one row per part
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = dealt.withColumn("_own", own).join(offsets.select("_part", "_before"), "_part")
    return out.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_part"), total
