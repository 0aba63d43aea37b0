"""Streaming forms of the monthly follow-up.

All take a streaming DataFrame with an event time and return one; ``run_once`` drives what is there to completion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_rates(stream: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("well", "ts"), delay: str = "31 days") -> DataFrame:
    """New rows with the repeats inside the watermark dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_monthly_agg(stream: DataFrame, ts: str, key: str, value: str, every: str = "30 days", delay: str = "2 days") -> DataFrame:
    """Tumbling sums per well, given out once a window is closed by the watermark."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, every), key)
    return w.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(
        key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "n"
    )


def stream_band_alerts(stream: DataFrame, band: DataFrame, key: str, value: str) -> DataFrame:
    """Rows outside the forecast band of their well.  band: key, p10, p90."""
    out = stream.join(band, key, "left")
    return out.where((F.col(value) < F.col("p10")) | (F.col(value) > F.col("p90")))


def stream_activity_sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """On-stream spells closed by a gap."""
    s = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key)
    return s.agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


CUSUM_OUT = "key string, ts timestamp, value double, up double, down double"
CUSUM_STATE = "ref double, up double, down double, last timestamp"


def stream_cusum(stream: DataFrame, key: str, ts: str, value: str, scale: float, k: float = 0.5) -> DataFrame:
    """Two-sided cumulative sum with its state (reference, up, down, last time) kept per well.

    Feed it one value per well and period (``stream_monthly_agg`` gives that), so a busy well sends no more rows than
    a quiet one.  Rows not newer than the state are late and left out.
    """

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ref, up, down, last = state.get if state.exists else (None, 0.0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t, v in zip(rows["ts"], rows["value"]):
            if last is not None and t <= pd.Timestamp(last):
                continue
            if ref is None:
                ref = float(v)
            else:
                x = (float(v) - ref) / max(scale, 1e-12)
                up, down = max(0.0, up + x - k), max(0.0, down - x - k)
            last = t.to_pydatetime()
            out.append((group[0], t, float(v), up, down))
        if ref is not None:
            state.update((ref, up, down, last))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "value", "up", "down"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


def dq_diff_sink(root: str, report: Callable[[DataFrame], DataFrame], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: the batch's report against the last one, changes appended under the batch number.

    Reports and changes are written to a folder per batch, so a repeated batch replaces its own output.
    """
    from wellspan.plans.surveillance import dq_diff

    def write(batch: DataFrame, epoch: int) -> None:
        now = report(batch)
        now.write.mode("overwrite").parquet(f"{root}/report/epoch={epoch}")
        spark = batch.sparkSession
        after = spark.read.parquet(f"{root}/report/epoch={epoch}")
        before = spark.read.parquet(f"{root}/report/epoch={epoch - 1}") if epoch > 0 else after.limit(0)
        dq_diff(before, after, keys).write.mode("overwrite").parquet(f"{root}/changes/epoch={epoch}")

    return write


def run_once(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived and return what was written."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
