"""Small literal cases for the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wellspan.functions.text import normalise_id, parse_date
from wellspan.operators import clean, events, gates, grid, roles, rolling
from wellspan.plans import actions, surveillance
from wellspan.sources import jdbc

D = dt.date


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()[0]


def test_normalise_id(spark):
    assert one(spark, "P - 2", normalise_id) == "P-2"
    assert one(spark, "  ab\t 3 / x ", normalise_id) == "AB 3/X"


@pytest.mark.parametrize(
    "text,want",
    [("2001-03-04", D(2001, 3, 4)), ("04/03/2001", D(2001, 3, 4)), ("12/31/2001", D(2001, 12, 31)), ("Jan-75", D(1975, 1, 1)), ("jan-68", D(2068, 1, 1)),
     ("5-FEB-99", D(1999, 2, 5)), ("199902", D(1999, 2, 1)), ("1999-2", D(1999, 2, 1)), ("1.2.1999", D(1999, 2, 1)), ("2001-03-04 10:00:00", D(2001, 3, 4)), ("junk", None), ("", None)],
)
def test_parse_date(spark, text, want):
    assert one(spark, text, parse_date) == want


def test_blind_split(spark):
    rows = spark.createDataFrame([("a", i) for i in range(120)] + [("b", i) for i in range(20)] + [("c", i) for i in range(3)], "field string, step int")
    got = {r["field"]: (r["n_train"], r["n_blind"]) for r in gates.blind_split(rows).collect()}
    assert got == {"a": (96, 24), "b": (14, 6), "c": (2, 1)}


def windows(spark, n, cuts):
    dates = spark.createDataFrame([("f", [D(2000, 1, 1)] * n)], "field string, dates array<date>")
    br = spark.createDataFrame([("f", c, n, f"r{c}") for c in cuts], "field string, step int, n_steps int, reason string")
    return [(r["step_from"], r["step_to"], r["reason"]) for r in events.history_windows(br, dates).orderBy("window_id").collect()]


def test_history_windows(spark):
    assert windows(spark, 96, [48]) == [(0, 48, "full history"), (48, 96, "after r48")]
    assert windows(spark, 96, [48, 90]) == [(0, 48, "full history"), (48, 96, "after r48")]
    assert windows(spark, 96, [10]) == [(0, 96, "after r10")]
    assert windows(spark, 30, []) == [(0, 30, "full history")]


def test_rolling_bounds(spark):
    n = spark.createDataFrame([("f", 60)], "field string, n_steps int")
    b = spark.createDataFrame([("g", 1)], "field string, step int")
    got = [(r["step_from"], r["step_to"]) for r in rolling.rolling_bounds(n, b).orderBy("step_from").collect()]
    assert got == [(0, 36), (6, 42), (12, 48), (18, 54), (24, 60)]


def entity_rates(spark, rates):
    rows = [("f", "w", D(2000 + m // 12, m % 12 + 1, 1), float(q), 0.0, None, 0.0, 30.0) for m, q in enumerate(rates)]
    df = spark.createDataFrame(rows, "field string, well string, date date, q_oil double, q_water double, q_gas double, q_inj double, days_on double")
    return roles.split_roles(df)


def test_hampel_replaces_a_single_spike_and_keeps_a_step(spark):
    spiky = [100 + (i % 3) for i in range(20)]
    spiky[9] = 400
    g = clean.clean_grid(grid.build_grid(entity_rates(spark, spiky)))
    hit = [r["step"] for r in g.where("is_spike").collect()]
    assert hit == [9]
    level = [100 + (i % 3) for i in range(10)] + [300 + (i % 3) for i in range(10)]
    assert clean.clean_grid(grid.build_grid(entity_rates(spark, level))).where("is_spike").isEmpty()


def test_densify_fills_gaps(spark):
    a = [("f", "a", D(2000, m, 1), 5.0, 1.0, None, None, 30.0) for m in (1, 2, 5)]
    b = [("f", "b", D(2000, 3, 1), None, None, None, 7.0, None)]
    df = spark.createDataFrame(a + b, "field string, well string, date date, q_oil double, q_water double, q_gas double, q_inj double, days_on double")
    rows = grid.build_grid(roles.split_roles(df)).orderBy("entity", "step").collect()
    assert [(r["entity"], r["step"], r["oil"], r["inj_s"], r["days_on"]) for r in rows] == [
        ("a", 0, 5.0, 0.0, 30.0), ("a", 1, 5.0, 0.0, 30.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, 5.0, 0.0, 30.0),
        ("b", 0, 0.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("b", 2, 0.0, 7.0, 29.0), ("b", 3, 0.0, 0.0, 0.0),
    ]


def test_commingled_split(spark):
    r = spark.createDataFrame([("f", "w", D(2000, 1, 1), 100.0, 0.0, 0.0, 0.0, 30.0)], "field string, well string, date date, q_oil double, q_water double, q_gas double, q_inj double, days_on double")
    c = spark.createDataFrame([("f", "w", "A", 0.75), ("f", "w", "B", 0.25)], "field string, well string, reservoir string, alloc_factor double")
    assert {x["well"]: x["q_oil"] for x in roles.split_commingled(r, c).collect()} == {"w#A": 75.0, "w#B": 25.0}


def test_due_evaluations(spark):
    recs = spark.createDataFrame([(1, D(2024, 1, 31))], "rec_id int, implemented_at date")
    none = spark.createDataFrame([], "rec_id int, months_after int")
    got = lambda today, done: sorted(r["months_after"] for r in surveillance.due_evaluations(recs, F.lit(today).cast("date"), done).collect())
    assert got("2024-04-28", none) == [3] and got("2024-04-27", none) == []
    assert got("2024-08-01", spark.createDataFrame([(1, 3)], "rec_id int, months_after int")) == [6]


def test_hit_rate_moves_the_threshold(spark):
    rows = [("HIGH", "within band")] * 2 + [("HIGH", "better")] + [("HIGH", "worse")] * 3
    hits = surveillance.hit_rate(spark.createDataFrame(rows, "badge string, outcome string"))
    assert surveillance.recalibrate_threshold(hits, 0.85).first()["threshold"] == pytest.approx(0.87)


def test_ramp_reaches_the_target(spark):
    m = spark.createDataFrame([("f", "a", 100.0, 150.0, "HIGH"), ("f", "b", 100.0, 102.0, "HIGH"), ("f", "c", 0.0, 50.0, "LOW")], "field string, injector string, rate_from double, rate_to double, confidence string")
    got = {r["injector"]: r for r in actions.ramp(m).collect()}
    assert got["a"]["weekly"][0] == pytest.approx(115.0) and got["a"]["weekly"][-1] == 150.0
    assert got["b"]["suppressed"] and got["b"]["weekly"] == []
    assert got["c"]["weekly"][-1] == pytest.approx(50.0)


def test_jdbc_guards():
    assert jdbc.check_query(" select 1 ; ") == "select 1"
    for bad in ("delete from t", "select 1; drop table t", "with x as (select 1) select 1; select 2"):
        with pytest.raises(ValueError):
            jdbc.check_query(bad)
    with pytest.raises(ValueError):
        jdbc.check_identifier("t; drop")
    opts = jdbc.Connection("postgresql", "jdbc:postgresql://h/db", "u", "p").as_options()
    assert opts["driver"] == "org.postgresql.Driver" and opts["user"] == "u"
    assert jdbc.Split("id", "0", "9", 4).as_options()["numPartitions"] == "4"


def test_plan_search_ends_without_gain(spark, monkeypatch):
    from wellspan.plans import scenarios

    b = spark.createDataFrame([(f, i, 0.0, 10.0, 12.0) for f in ("A", "B") for i in ("1", "2", "3")], "field string, injector string, lo double, hi double, total_water double")
    current = b.select("field", "injector", F.lit(4.0).alias("rate"))
    marginal = b.select("field", "injector", F.lit(1.0).alias("marginal"))
    aim = F.when(F.col("field") == "A", F.when(F.col("injector") == "1", 7.3).otherwise(2.35)).otherwise(4.0)
    value = lambda plans, *_: plans.groupBy("field", "plan").agg((-F.sum(F.pow(F.col("rate") - aim, 2))).alias("cum_oil")).withColumn("member", F.lit(0))
    monkeypatch.setattr(scenarios, "evaluate_plans", value)
    rounds, pick = [], scenarios.pick_plan

    def seen(*args):
        out = pick(*args).cache()
        rounds.append({r["field"]: r["value"] for r in out.collect()})
        return out

    monkeypatch.setattr(scenarios, "pick_plan", seen)
    best = {r["field"]: r["value"] for r in scenarios.plan_search(b, current, marginal, None, None, None, None, keep=lambda d: d.localCheckpoint()).collect()}
    last = {}
    for k, now in enumerate(rounds):
        gained = {f for f in now if f not in last or now[f] > last[f]}
        assert bool(gained) == (k < len(rounds) - 1) and (k + 1 == len(rounds) or set(rounds[k + 1]) == gained)
        last |= now
    assert best == last and len(rounds) > 3
