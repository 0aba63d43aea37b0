"""Histories and plans travel with a pair in one row."""

import re

from pyspark.sql import functions as F

from wellspan.operators import fit, verify
from wellspan.plans import forecast, scenarios

PAIRS = [("A", "i1", "p1", 0, 0.5), ("A", "i1", "p2", 0, 0.25), ("A", "i2", "p2", 0, 0.5), ("A", "i1", "p1", 1, 0.4)]


def pairs_of(spark):
    return spark.createDataFrame(PAIRS, "field string, injector string, producer string, member int, f double")


def rows_dealt_folded(df):
    """No exchange lies above the unfolding of the arrays."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda word: min((k for k, line in enumerate(lines) if word in line), default=len(lines))
    return at("Generate") < at("Exchange")


def test_history_of_a_pair_is_dealt_in_one_row(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rates = [("A", "i1", 0, 10.0), ("A", "i1", 1, 20.0), ("A", "i2", 0, 4.0), ("A", "i2", 0, 6.0), ("A", "i2", 1, None)]
        inj = spark.createDataFrame(rates, "field string, injector string, step int, inj double")
        g = spark.createDataFrame([("A", 0, "i1", 1, 2.0)], "field string, member int, injector string, step int, g double")
        out = fit.allocated_source(pairs_of(spark), inj, ["field", "member"], g)
        assert rows_dealt_folded(out)
        got = {(r["member"], r["producer"], r["step"]): r["support"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(0, "p1", 0): 5.0, (0, "p1", 1): 20.0, (0, "p2", 0): 7.5, (0, "p2", 1): 10.0, (1, "p1", 0): 4.0, (1, "p1", 1): 8.0}


def test_closed_producer_passes_its_share_on(spark):
    on = spark.createDataFrame([("A", "p1", 0, True), ("A", "p2", 0, True), ("A", "p1", 1, True), ("A", "p2", 1, False)], "field string, producer string, step int, on boolean")
    out = fit.shutin_redistribution(pairs_of(spark), on, ["field", "member"]).collect()
    got = {(r["member"], r["injector"], r["step"]): round(r["g"], 9) for r in out}
    assert got == {(0, "i1", 0): 1.0, (0, "i1", 1): 1.5, (0, "i2", 0): 1.0, (0, "i2", 1): 1.0, (1, "i1", 0): 1.0, (1, "i1", 1): 1.0}


def test_plans_of_a_pair_are_dealt_in_one_row(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark.createDataFrame([("A", "x", "i1", 8.0), ("A", "x", "i2", 2.0), ("A", "y", "i1", 4.0)], "field string, plan string, injector string, rate double")
        g = pairs_of(spark).select("field", "member", "injector").distinct().withColumn("g", F.lit(2.0))
        known = spark.createDataFrame([("A", 0, "p1"), ("A", 0, "p3")], "field string, member int, producer string")
        out = forecast.plan_sources(plan, pairs_of(spark), g, ["field", "plan"], producers=known)
        assert rows_dealt_folded(out)
        got = {(r["plan"], r["member"], r["producer"]): (r["source"], r["support"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {("x", 0, "p1"): (8.0, 4.0), ("x", 0, "p2"): (6.0, 3.0), ("x", 1, "p1"): (6.4, 3.2), ("y", 0, "p1"): (4.0, 2.0), ("y", 0, "p2"): (2.0, 1.0), ("y", 1, "p1"): (3.2, 1.6)}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == want | {("x", 0, "p3"): (0.0, 0.0), ("y", 0, "p3"): (0.0, 0.0)}


def by_field_alone(df):
    """Some exchange deals rows by field only, so to as many tasks as there are fields."""
    return re.search(r"hashpartitioning\(field#\d+, \d+\)", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_histories_are_scored_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [("A", 0, "p1", k, True, float(k), float(k) + (k >= 4)) for k in range(8)]
        pred = spark.createDataFrame(rows, "field string, member int, producer string, step int, on boolean, liq double, pred double")
        out = verify.verify_report(pred, spark.createDataFrame([("A", 4)], "field string, n_train int"))
        assert not by_field_alone(out)
        got = {r["producer"]: (r["train_r2"], r["n_train_points"], r["n_blind_points"], r["sse_train"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"p1": (1.0, 4, 4, 0.0), None: (1.0, 4, 4, 0.0)}


def test_cases_are_simulated_in_as_many_tasks_as_a_shuffle_has(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        pairs = pairs_of(spark)
        g = pairs.select("field", "member", "injector").distinct().withColumn("g", F.lit(2.0))
        base = pairs.select("field", "member", "producer").distinct().withColumns({"source": F.lit(10.0), "support": F.lit(5.0)})
        number = {c: F.lit(v) for c, v in {"x0": 10.0, "tau": 30.0, "gain_p": 0.0, "tau_p": 30.0, "q0": 0.0, "age": 0.0, "cwi0": 0.0, "ratio": 1.0, "level": 1.0, "anchor": 0.5}.items()}
        none = {c: F.lit(None).cast("double") for c in ("alpha", "beta", "offset")}
        state = base.select("field", "member", "producer").withColumns(number | none | {"active": F.lit(True)})
        cal = spark.createDataFrame([("A", 1, 30.0, 30.0), ("A", 2, 30.0, 60.0)], "field string, h int, dt_days double, t_cum double").withColumn("date", F.lit("2000-01-01").cast("date"))
        changes = spark.createDataFrame([("A", "c", "i1", 4.0)], "field string, case string, injector string, delta double")
        current = changes.select("field", "injector", F.col("delta").alias("rate"))
        out = scenarios.changed_oil(changes, current, pairs, g, base, state, cal)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and not re.search(r"SortMergeJoin \[field#\d+\]", plan)  # months come to the rows
        got = {r["member"]: r["d_oil"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    gain = sum(1 - 2.718281828459045**-k for k in (1, 2)) * 30 * 0.5  # of a source that rises by one
    assert {m: round(x / gain, 9) for m, x in got.items()} == {0: 4 * 2 * 0.75, 1: 4 * 2 * 0.4}
