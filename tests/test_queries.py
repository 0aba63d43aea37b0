"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "conform", "parse_dates", "unit_convert", "well_listing", "pvt_lookup", "resolved_role", "split_roles", "densify", "hampel", "long_shutins",
    "fit_weights", "fill_pressure", "support_ratio", "predict_history", "fit_wor_power", "forecast_oil_water", "economic_tornado",
    "scenario_shut_in", "stream_cusum", "run_lookup", "hit_rate",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = lambda v: v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    want, got = rows(list(rel.columns), rel.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(rel.columns) and len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-5) if all(isinstance(x, (int, float)) for x in a) else [x if not isinstance(x, float) else round(x, 3) for x in a] == [
            x if not isinstance(x, float) else round(x, 3) for x in b
        ]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
