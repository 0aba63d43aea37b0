"""Exact quantiles per group that never put one group into one task.

Spark's ``percentile`` holds every distinct value of a group in one task.  That is right for groups bounded by
the length of a history, but not for a whole field, which may hold a third of all rows.  Here a group is spread
over value bins: the bins are counted with map-side combine, the bins holding the wanted ranks are found from
the counts, and only those bins are ordered.  The result is exact whatever the bins look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BINS = 2048


def _binned(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    span = distinct.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    pos = F.when(
        F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    ).otherwise(0)
    return distinct.join(span, keys).withColumn("_b", F.least(pos, F.lit(bins - 1)).cast("int"))


def ordered_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict, bins: int = BINS) -> DataFrame:
    """Values at given zero-based ranks.  ``ranks`` maps an output name to a function of the group size column."""
    keys = list(keys)
    binned = _binned(df, keys, value, bins)
    hist = binned.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    by_bin = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_bc").over(by_bin), F.lit(0)))
    hist = hist.withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
    wanted = F.array(*[fn(F.col("_n")).cast("bigint") for fn in ranks.values()])
    start, stop = F.col("_before"), F.col("_before") + F.col("_bc")
    hist = hist.withColumn("_wanted", wanted).where(F.exists("_wanted", lambda r: (r >= start) & (r < stop)))
    hits = binned.join(hist.select(*keys, "_b", "_before", "_n", "_wanted"), [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_s", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    at = [
        F.max(F.when((F.col("_wanted")[i] >= F.col("_s")) & (F.col("_wanted")[i] < F.col("_s") + F.col("_c")), F.col("_v")))
        .alias(name)
        for i, name in enumerate(ranks)
    ]
    return hits.groupBy(*keys).agg(*at, F.max("_n").alias("n"))


def group_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Linearly interpolated quantile per group."""
    pos = lambda n: (n - 1) * F.lit(float(q))
    two = ordered_values(df, keys, value, {"_a": lambda n: F.floor(pos(n)), "_z": lambda n: F.ceil(pos(n))})
    p = pos(F.col("n"))
    return two.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * (p - F.floor(p))).alias(out))
