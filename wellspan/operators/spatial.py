"""Nearest neighbours and radius pairs on the plane by equi-joins on cells.

Neither builds the all-pairs table of a field.  A point looks only into the cells around it, and both answers are
exact: a cell level is chosen per point so that the searched block is guaranteed to hold the nearest neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = 12


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _around(reach: int) -> Column:
    return F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    )


def _frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """Square around all points of a field: one row per field."""
    both = a.select("field", "x", "y").unionByName(b.select("field", "x", "y"))
    f = both.groupBy("field").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    return f.select("field", "x0", "y0", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)).alias("span"))


def _cells(points: DataFrame) -> DataFrame:
    size = F.col("span") / F.pow(F.lit(2.0), F.col("level"))
    return points.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / size)).withColumn(
        "cy", F.floor((F.col("y") - F.col("y0")) / size)
    )


def nearest(a: DataFrame, b: DataFrame, levels: int = LEVELS, ties: bool = False) -> DataFrame:
    """Nearest point of ``b`` for each point of ``a`` within the field: (field, id, other, d).

    With ``ties`` every point at the smallest distance is returned, else the one with the smallest id.
    Level 0 is the whole field, whose 3 x 3 block holds everything, so every point finds a level.
    Finest level whose 3 x 3 block around the point holds some ``b``: the nearest is then closer than
    2 * sqrt(2) cells, so the 7 x 7 block at that level contains it.
    """
    box = _frame(a, b)
    spots = b.groupBy("field", "x", "y").agg(F.min("id").alias("other")).join(box, "field")
    all_levels = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    spots = _cells(spots.withColumn("level", all_levels))
    key = ["field", "level", "cx", "cy"]
    occupied = spots.select(*key).distinct()
    pts = _cells(a.select("field", "id", "x", "y").join(box, "field").withColumn("level", all_levels))
    look = pts.withColumn("o", F.explode(_around(1)))
    look = look.withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j"))
    best = look.join(occupied, key, "left_semi").groupBy("field", "id").agg(F.max("level").alias("level"))
    mine = pts.join(best, ["field", "id", "level"]).withColumn("o", F.explode(_around(3)))
    mine = mine.select(
        "field", "id", "level", F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"),
    )
    cand = mine.join(spots.select(*key, "other", F.col("x").alias("bx"), F.col("y").alias("by")), key)
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    cand = cand.withColumn("d", d)
    if not ties:
        hit = F.min(F.struct("d", "other")).alias("h")
        return cand.groupBy("field", "id").agg(hit).select("field", "id", "h.other", "h.d")
    spot = cand.select("field", "id", "d", F.struct("bx", "by").alias("s"))
    best_spots = spot.groupBy("field", "id", "d").agg(F.collect_set("s").alias("spots")).groupBy("field", "id").agg(
        F.min_by(F.struct("d", "spots"), F.col("d")).alias("h")
    )
    at = best_spots.select("field", "id", "h.d", F.explode("h.spots").alias("s"))
    at = at.select("field", "id", "d", F.col("s.bx").alias("x"), F.col("s.by").alias("y"))
    return at.join(b.select("field", "x", "y", F.col("id").alias("other")), ["field", "x", "y"]).select(
        "field", "id", "other", "d"
    )


def pairs_within(a: DataFrame, b: DataFrame, radius: DataFrame) -> DataFrame:
    """All pairs not farther apart than the field's radius (``radius``: field, r): (field, a_id, b_id, d)."""
    r = radius.where(F.col("r").isNotNull()).select("field", "r", F.greatest("r", F.lit(1e-9)).alias("cell"))
    at = lambda df: df.join(r, "field").withColumn("cx", F.floor(F.col("x") / F.col("cell"))).withColumn(
        "cy", F.floor(F.col("y") / F.col("cell"))
    )
    left = at(a).withColumn("o", F.explode(_around(1)))
    left = left.select(
        "field", "r", F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"),
    )
    right = at(b).select("field", "cx", "cy", F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = left.join(right, ["field", "cx", "cy"]).withColumn("d", d)
    return near.where(F.col("d") <= F.col("r")).select("field", "a_id", "b_id", "d")
