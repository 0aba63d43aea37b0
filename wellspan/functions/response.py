"""First-order response of a producer to injection, as window sums.

The recursion ``x_n = x_{n-1} e_n + (1 - e_n) S_n`` with ``e_n = exp(-dt_n / tau)`` has the closed form
``x_n = exp(-u_n) * sum_{k <= n} (1 - e_k) S_k exp(u_k)``, ``u`` being the running sum of ``dt / tau``.  Closed steps
neither add to the sum nor advance ``u``, which freezes the state.  The exponent is kept in blocks of ``BLOCK`` time
constants, so no history is long enough to overflow; what lies two blocks back has decayed below 1e-130.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 300.0


def exp_filter(
    df: DataFrame, keys: list[str], source: Column, tau: Column, out: str, open_: Column | None = None,
    order: str = "step", dt: str = "dt_days", initial: Column | None = None,
) -> DataFrame:
    """Add the filtered series per key.  The first row is the starting state (``initial`` or zero)."""
    by_step = Window.partitionBy(*keys).orderBy(order)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    moves = F.row_number().over(by_step) > 1
    if open_ is not None:
        moves = moves & open_
    df = df.withColumn("_m", F.when(moves, 1.0).otherwise(0.0))
    df = df.withColumn("_u", F.sum(F.col("_m") * F.col(dt) / tau).over(upto(by_step)))
    df = df.withColumn("_b", F.floor(F.col("_u") / BLOCK))
    df = df.withColumn("_o", F.col("_u") - BLOCK * F.col("_b"))
    df = df.withColumn(
        "_s", F.when(F.col("_m") > 0, (1.0 - F.exp(-F.col(dt) / tau)) * source * F.exp("_o")).otherwise(0.0)
    )
    in_block = Window.partitionBy(*keys, "_b").orderBy(order)
    block_before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    df = df.withColumn("_c", F.sum("_s").over(upto(in_block)))
    df = df.withColumn("_p", F.coalesce(F.sum("_s").over(block_before), F.lit(0.0)))
    x = F.exp(-F.col("_o")) * F.col("_c") + F.exp(-F.col("_o") - BLOCK) * F.col("_p")
    if initial is not None:
        x = x + initial * F.exp(-F.col("_u"))
    return df.withColumn(out, x).drop("_m", "_u", "_b", "_o", "_s", "_c", "_p")


def primary_decline(gain: Column, q0: Column, t: Column, t_start: Column, tau_p: Column) -> Column:
    return gain * q0 * F.exp(-(t - t_start) / tau_p)


def tau_grid(lo: Column, hi: Column, points: int) -> Column:
    """Log-spaced grid as an array."""
    step = (F.log(hi) - F.log(lo)) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.exp(F.log(lo) + step * k))
