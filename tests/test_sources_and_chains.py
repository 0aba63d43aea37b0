"""Columns by name, components of long chains, ramps of any length and fields without water."""

import random

from pyspark.sql import functions as F

from wellspan.operators import sectors
from wellspan.plans import actions, scenarios
from wellspan.sources import readers


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("well,extra,q_oil,field\nW1,x,1.5,F1\nW2,x,oops,F2\nW3,x\n")
    got = {r["well"]: r for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "field string, well string, date date, q_oil double", keep_bad=True).collect()}
    assert (got["W1"]["field"], got["W1"]["q_oil"], got["W1"]["date"], got["W1"]["bad_row"]) == ("F1", 1.5, None, None)
    assert got["W2"]["q_oil"] is None and got["W2"]["bad_row"] == "W2,x,oops,F2" and got["W3"]["bad_row"] is not None
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "field string, well string").columns == ["field", "well"]


def test_components_of_a_shuffled_chain(spark):
    names = [f"{k:03d}" for k in range(120)]
    random.Random(4).shuffle(names)
    ring = [("F", names[k], names[(k + d) % 120]) for k in range(120) for d in (0, 1)]
    edges = spark.createDataFrame([*ring, ("F", "900", "900"), ("G", "1", "1")], "field string, injector string, producer string")
    got = sectors.connected_components(edges).groupBy("field", "sector").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("F", "S1", 240), ("F", "S2", 2), ("G", "S1", 2)}


def test_pairs_at_one_place(spark):
    rows = [("F", f"{role}{k}", role, float(k), 0.0) for k in range(3) for role in "IP"]
    wells = spark.createDataFrame(rows, "field string, entity string, role string, x double, y double")
    assert {(r["injector"], r["producer"]) for r in sectors.pair_distances(wells, 2.5).collect()} == {(f"I{k}", f"P{k}") for k in range(3)}


def test_ramp_reaches_its_target(spark):
    moves = [("F", f"I{k}", a, b, c) for k, (a, b, c) in enumerate([(0.0, 5e9, "LOW"), (1e12, 0.0, "LOW"), (3.0, 900.0, "HIGH"), (900.0, 3.0, "HIGH"), (50.0, 50.1, "LOW"), (0.0, 0.0, "LOW")])]
    out = actions.ramp(spark.createDataFrame(moves, "field string, injector string, rate_from double, rate_to double, confidence string")).collect()
    for r in out:
        last = r["weekly"][-1] if r["weekly"] else r["rate_from"]
        assert abs(last - r["target"]) < 1e-9 and r["weeks"] == len(r["weekly"])
    assert max(r["weeks"] for r in out) > 520


def test_idle_field_beside_a_healthy_one(spark):
    bounds = spark.createDataFrame([("A", "I1", 0.0, 0.0, 0.0), ("B", "I1", 0.0, 10.0, 12.0), ("B", "I2", 0.0, 10.0, 12.0)], "field string, injector string, lo double, hi double, total_water double")
    got = scenarios.draw_candidates(bounds, 2, 1).groupBy("field", "plan").agg(F.sum("rate").alias("w")).collect()
    assert sorted((r["field"], round(r["w"], 6)) for r in got) == [("A", 0.0), ("A", 0.0), ("B", 12.0), ("B", 12.0)]
