"""Canonical well tables derived from the given business tables.

Suppliers act as wells, regions as fields and nations as blocks; shipped quantities are monthly volumes, orders
are pressure readings and the event log gives well events.  Every table carries ``field`` in its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROLE_CHANGE = "1998-06-16"


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- dimensions -----------------------------------------------------------------------------------------
    def wells(self) -> DataFrame:
        n, r = self.read("nation"), self.read("region")
        places = n.join(r, n.n_regionkey == r.r_regionkey).select(
            "n_nationkey", F.col("r_name").alias("field"), F.col("n_name").alias("block"), "n_regionkey"
        )
        s = self.read("supplier").select("s_suppkey", "s_nationkey")
        return s.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("k"), F.concat(F.lit("S-"), F.col("s_suppkey")).alias("well"), "field", "block",
            F.col("n_regionkey").alias("region_no"),
        )

    def n_wells(self):
        """Number of wells as a scalar subquery."""
        return self.read("supplier").agg(F.count(F.lit(1))).scalar()

    # -- canonical tables -----------------------------------------------------------------------------------
    def rates(self) -> DataFrame:
        """Monthly rates per well.  Days on stream are counted as bits of a day mask, so the heavy first
        aggregation keeps its map-side combine and needs one shuffle instead of a distinct expansion."""
        ship, k, q = F.to_date("l_shipdate"), F.col("l_suppkey"), F.col("l_quantity")
        producing = (k % 3 == 1) | ((k % 3 == 2) & (ship < F.lit(ROLE_CHANGE).cast("date")))
        oil = F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)
        water = F.when(F.col("l_returnflag") != "R", q).otherwise(0.0)
        month = self.read("lineitem").groupBy("l_suppkey", F.trunc(ship, "MM").alias("date")).agg(
            F.sum(F.when(producing, oil)).alias("q_oil"),
            F.sum(F.when(producing, water)).alias("q_water"),
            F.sum(F.when(~producing, q)).alias("q_inj"),
            F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(ship) - 1))).cast("double")
            .alias("days_on"),
        )
        return month.join(self.wells(), F.col("l_suppkey") == F.col("k")).select(
            "field", "well", "date", "q_oil", "q_water", F.lit(None).cast("double").alias("q_gas"), "q_inj", "days_on"
        )

    def category(self) -> DataFrame:
        """Wells with k % 10 = 7 are listed under two reservoirs; every second one of them has factors."""
        k = F.col("k")
        copies = F.when(k % 10 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        w = self.wells().withColumn("c", F.explode(copies))
        return w.select(
            "well", "field",
            F.when((k % 10 == 7) & (F.col("c") == 1), "B").otherwise("A").alias("reservoir"),
            "block",
            F.when(k % 20 == 7, F.when(F.col("c") == 1, 0.25).otherwise(0.75)).alias("alloc_factor"),
        )

    def coords(self) -> DataFrame:
        k = F.col("k")
        return self.wells().select(
            "field", "well",
            ((k * 7919) % 10007).cast("double").alias("x"),
            ((k * 104729) % 10009).cast("double").alias("y"),
            (2000 + k % 50).cast("double").alias("tvd"),
        )

    def pressure(self) -> DataFrame:
        src = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "ESP").when(F.col("o_orderpriority") == "2-HIGH", "gauge")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "WHP").when(F.col("o_orderpriority") == "5-LOW", "static survey")
        )
        p = self.read("orders").select(
            (F.col("o_orderkey") % self.n_wells()).alias("wk"), F.to_date("o_orderdate").alias("date"),
            (8000 + F.col("o_totalprice") / 100).alias("bhp"), (1000 + F.col("o_totalprice") / 500).alias("whp"),
            src.alias("src"), F.lit(1900.0).alias("depth"),
        )
        return p.join(self.wells(), F.col("wk") == F.col("k")).select(
            "field", "well", "date", "bhp", "whp", "src", "depth"
        )

    def events(self) -> DataFrame:
        e = self.read("events").select(
            F.col("event_id").alias("seq"), (F.col("user_id") % self.n_wells()).alias("wk"),
            F.add_months(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 83).cast("int")).alias("date"),
            F.when(F.col("event_id") % 500 == 0, "WORKOVER").when(F.col("event_type") == "click", "CHOKE")
            .when(F.col("event_type") == "view", "ESP_FREQ").when(F.col("event_type") == "error", "PUMP")
            .otherwise("OTHER").alias("type"),
            F.col("event_type").alias("note"),
        )
        return e.join(self.wells(), F.col("wk") == F.col("k")).select("field", "well", "date", "type", "note", "seq")
