"""Closed forms against plain recursions and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspan.functions.quantiles import group_quantile, ordered_values
from wellspan.functions.response import exp_filter
from wellspan.operators import fit, rolling, sectors, spatial


@pytest.mark.parametrize("tau", [20.0, 90.0, 0.05])
def test_exp_filter_equals_recursion(spark, tau):
    rng = random.Random(3)
    rows = [("a", n, 30.0, rng.random() * 100, n % 7 != 3) for n in range(150)]
    df = spark.createDataFrame(rows, "k string, step int, dt_days double, s double, on boolean")
    got = {r["step"]: r["x"] for r in exp_filter(df, ["k"], F.col("s"), F.lit(tau), "x", F.col("on"), initial=F.lit(5.0)).collect()}
    x = 5.0
    for _, n, dt, s, on in rows:
        if n > 0 and on:
            e = math.exp(-dt / tau)
            x = x * e + (1 - e) * s
        assert got[n] == pytest.approx(x, rel=1e-9, abs=1e-9)


def test_cusum_equals_recursion(spark):
    rng = random.Random(5)
    vals = [rng.gauss(1, 0.4) for _ in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, i int, v double")
    got = {r["i"]: (r["up"], r["down"]) for r in rolling.cusum(df, ["k"], "v", "i", F.lit(0.3)).collect()}
    up = dn = 0.0
    for i, v in enumerate(vals):
        if i:
            x = (v - vals[0]) / 0.3
            up, dn = max(0.0, up + x - 0.5), max(0.0, dn - x - 0.5)
        assert got[i] == pytest.approx((up, dn), abs=1e-9)


def test_group_quantile_is_exact(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.lognormal(0, 3, 501), "b": np.repeat([1.0, 2.0, 2.0, 7.0], 25), "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    for q in (0.1, 0.5, 0.93):
        got = {r["k"]: r["q"] for r in group_quantile(df, ["k"], "v", q, "q").collect()}
        for k, vs in data.items():
            assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12)
    low = {r["k"]: r["lo"] for r in ordered_values(df, ["k"], "v", {"lo": lambda n: F.lit(0)}).collect()}
    assert low["a"] == data["a"].min()


def test_nearest_and_radius_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [("f", f"a{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.random((60, 2)), 5 + 0.001 * rng.random((20, 2)), [[90.0, 3.0]]]))]
    b = [("f", f"b{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.random((50, 2)) * 2, [[40.0, 40.0], [40.0, 40.0]]]))]
    schema = "field string, id string, x double, y double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {r["id"]: (r["other"], r["d"]) for r in spatial.nearest(da, db).collect()}
    for _, i, x, y in a:
        d, o = min((math.hypot(x - p[2], y - p[3]), p[1]) for p in b)
        assert got[i][0] == o and got[i][1] == pytest.approx(d)
    near = {(r["a_id"], r["b_id"]) for r in spatial.pairs_within(da, db, spark.createDataFrame([("f", 0.3)], "field string, r double")).collect()}
    assert near == {(p[1], q[1]) for p in a for q in b if math.hypot(p[2] - q[2], p[3] - q[3]) <= 0.3}


def test_components_follow_long_chains(spark):
    chain = [("f", f"i{k:02d}", f"p{k:02d}", 1.0) for k in range(20)] + [("f", f"i{k + 1:02d}", f"p{k:02d}", 1.0) for k in range(19)]
    other = [("f", "z1", "z2", 1.0)]
    edges = spark.createDataFrame(chain + other, "field string, injector string, producer string, d double")
    got = {r["entity"]: r["sector"] for r in sectors.connected_components(edges).collect()}
    assert {got[f"i{k:02d}"] for k in range(20)} == {"S1"} and got["z1"] == got["z2"] == "S2"


def test_box_least_squares_meets_optimality():
    rng = np.random.default_rng(7)
    c = rng.random((30, 40, 5))
    y = np.einsum("bnk,k->bn", c, np.array([0.0, 0.3, 1.4, 0.5, -0.4])) + 0.01 * rng.standard_normal((30, 40))
    g, r = np.einsum("bni,bnj->bij", c, c), np.einsum("bni,bn->bi", c, y)
    f = fit.box_least_squares(g, r, 1.0)
    grad = np.einsum("bij,bj->bi", g, f) - r
    assert np.all(grad[f <= 0] >= -1e-6) and np.all(grad[f >= 1] <= 1e-6)
    inner = (f > 1e-9) & (f < 1 - 1e-9)
    assert np.max(np.abs(grad[inner])) < 1e-5


def test_fit_recovers_known_parameters(spark):
    rng = random.Random(11)
    n, truth = 90, {"p1": (75.0, {"i1": 0.5, "i2": 0.2}), "p2": (140.0, {"i1": 0.1, "i2": 0.6})}
    inj = {i: [rng.uniform(50, 400) for _ in range(n)] for i in ("i1", "i2")}
    prod = []
    for p, (tau, f) in truth.items():
        x = 0.0
        for s in range(n):
            if s:
                e = math.exp(-30 / tau)
                x = x * e + (1 - e) * sum(f[i] * inj[i][s] for i in f)
            prod.append(("f", p, s, 30.0 * s, 30.0, True, 100 * math.exp(-30.0 * s / tau) + x, 1.0))
    dp = spark.createDataFrame(prod, "field string, producer string, step int, t_days double, dt_days double, on boolean, liq double, w double")
    di = spark.createDataFrame([("f", i, s, v) for i, vs in inj.items() for s, v in enumerate(vs)], "field string, injector string, step int, inj double")
    mask = spark.createDataFrame([("f", i, p) for i in inj for p in truth], "field string, injector string, producer string")
    nt = spark.createDataFrame([("f", 72)], "field string, n_train int")
    best = fit.fit_producer_grid(dp, di, mask, nt).cache()
    for r in best.collect():
        tau, f = truth[r["producer"]]
        assert r["tau"] == pytest.approx(tau, rel=0.03)
        for i, v in zip(r["injectors"], r["f"]):
            assert v == pytest.approx(f[i], abs=0.02)


def test_injector_sum_bound_holds(spark):
    g = [("f", p, 90.0, ["i1", "i2"], [4.0, 1.0, 1.0, 3.0], [4.5, 2.0], 9.0) for p in ("p1", "p2", "p3")]
    grams = spark.createDataFrame(g, "field string, producer string, tau double, injectors array<string>, gram array<double>, rhs array<double>, yy double")
    from wellspan.session import cut_lineage

    out = fit.injector_sum_bound(grams, rounds=8, keep=cut_lineage).groupBy("injector").agg(F.sum("f").alias("s")).collect()
    assert all(r["s"] <= 1.0 + 1e-9 for r in out) and max(r["s"] for r in out) > 0.9
