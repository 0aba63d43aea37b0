"""Session helpers: a tuned builder for local runs and a reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "wellspan") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("WELLSPAN_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WELLSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wellspan-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's state on the shared checkpoint folder, so a lost executor costs one step."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
