"""Queries: sources, sinks and streams.  Files go to a fresh folder beside the session's checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wellspan.catalog import planning as pl, stages
from wellspan.catalog.registry import query
from wellspan.catalog.scores import r, report
from wellspan.functions.numeric import rd
from wellspan.session import ensure_checkpoint_dir
from wellspan.sources import exports, readers, snapshots
from wellspan.streaming import monitor


def scratch(t, name: str) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("scan_parquet", """select l_returnflag, count(*) n, sum(l_quantity) qty from lineitem where l_shipdate>=timestamp '1998-01-01' group by 1""")
def _(t):
    li = t.read("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("scan_csv", "select field, well, date, q_oil, q_water, q_gas, q_inj, days_on from b_rates")
def _(t):
    path = scratch(t, "csv")
    t.rates().write.option("header", True).csv(f"{path}/rates.csv")
    return readers.read_tables(t.spark, path, ["rates"], "csv")["rates"]


@query("scan_subset", """select 'coords' tbl, count(*) n from b_coords union all select 'category', count(*) from b_category""")
def _(t):
    path = scratch(t, "subset")
    for name, df in (("coords", t.coords()), ("category", t.category()), ("rates", t.rates())):
        df.write.parquet(f"{path}/{name}.parquet")
    got = readers.read_tables(t.spark, path, ["coords", "category"])
    n = lambda k: got[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tbl"), "n")
    return n("coords").unionByName(n("category"))


@query("content_hash")
def _(t):
    """The digest of the tables, and of the same rows in another order and partitioning."""
    tables = {"rates": t.rates(), "coords": t.coords()}
    mixed = {k: v.repartition(7).sortWithinPartitions("well") for k, v in tables.items()}
    a, b = snapshots.content_hash(tables), snapshots.content_hash(mixed)
    return a.withColumn("same", F.col("data_hash") == b.scalar())


@query("snapshot_write", "select 'rates' tbl, count(*) n from b_rates union all select 'coords', count(*) from b_coords")
def _(t):
    root = scratch(t, "snap")
    tables = {"rates": t.rates(), "coords": t.coords()}
    h = snapshots.snapshot_write(tables, root, "p1")
    snapshots.snapshot_write(tables, root, "p1")
    n = lambda k: snapshots.snapshot_read(t.spark, root, h, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tbl"), "n")
    return n("rates").unionByName(n("coords"))


@query("snapshot_read", "select field, well, x, y, tvd from b_coords")
def _(t):
    root = scratch(t, "snap")
    h = snapshots.snapshot_write({"coords": t.coords()}, root, "p1")
    return snapshots.snapshot_read(t.spark, root, h, "coords").select("field", "well", "x", "y", "tvd")


@query("snapshot_list", "select 'p1' project_id, 1::bigint n from (select count(*) c from b_coords) where c>0")
def _(t):
    root = scratch(t, "snap")
    snapshots.snapshot_write({"coords": t.coords()}, root, "p1")
    snapshots.snapshot_write({"coords": t.coords().where(F.col("x") > 5)}, root, "p2")
    return snapshots.snapshot_list(t.spark, root, "p1").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


def runs(t):
    return t.read("orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("data_hash"), F.col("o_orderpriority").alias("config_hash"),
        F.col("o_orderstatus").alias("version"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "failed").otherwise("done").alias("status"), (F.col("o_orderkey") % 4).alias("project_id"),
    )


_RUNS = """select data_hash, config_hash, version, run_id from (select o_custkey%50 data_hash, o_orderpriority config_hash, o_orderstatus version, o_orderkey run_id,
 row_number() over (partition by o_custkey%50, o_orderpriority, o_orderstatus order by o_orderdate desc, o_orderkey desc) k from orders where o_orderkey%10<>0) where k=1"""


@query("run_lookup", _RUNS)
def _(t):
    return snapshots.run_lookup(runs(t), ["data_hash", "config_hash", "version"]).select("data_hash", "config_hash", "version", "run_id")


@query("run_register", _RUNS)
def _(t):
    path = scratch(t, "runs")
    early = F.col("run_id") % 2 == 0
    snapshots.run_register(runs(t).where(early), path)
    snapshots.run_register(runs(t).where(~early), path)
    back = t.spark.read.parquet(path)
    return snapshots.run_lookup(back, ["data_hash", "config_hash", "version"]).select("data_hash", "config_hash", "version", "run_id")


@query("audit_query", """select seq, object_id, actor, "action" from (select event_id seq, event_id%20 object_id, user_id actor, event_type "action" from events) where object_id=7 order by seq desc""")
def _(t):
    log = t.read("events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 20).alias("object_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    return snapshots.audit_query(log, object_id=7)


@query("export_csv", "select field, injector, round(rate,4) rate from b_cur")
def _(t):
    path = scratch(t, "export")
    exports.export_csv({"rates": pl.current(t)}, path)
    back = readers.read_csv(t.spark, f"{path}/rates.csv", "field string, injector string, rate double")
    return back.select("field", "injector", r("rate", 4))


@query("export_json", """select field, member, producer, tau, round(blind_r2,4) blind_r2, coalesce(n,0) n_injectors, round(coalesce(s,0),5) sum_f from b_prod left join (select field, producer, count(*) n, sum(f) s from b_pair group by 1,2) using (field, producer)
 left join (select field, member, producer, blind_r2 from b_vr where producer is not null) using (field, producer)""")
def _(t):
    path = scratch(t, "json")
    m = report(t).where(F.col("producer").isNotNull()).select("field", "member", "producer", "blind_r2")
    exports.export_json(exports.model_json(stages.params(t), stages.pairs(t), m), path)
    back = t.spark.read.schema("field string, member int, producer string, tau double, blind_r2 double, f_ij map<string,double>").json(path)
    vals = F.coalesce(F.map_values("f_ij"), F.array().cast("array<double>"))
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return back.select("field", "member", "producer", "tau", r("blind_r2", 4), F.size(vals).cast("bigint").alias("n_injectors"), rd(total, 5).alias("sum_f"))


@query("writeback_append", """select well, target_rate, rate_unit, recommendation_id, approved_by from (select injector well, round(rate,3) target_rate, 'm3/d' rate_unit, regionkey::varchar recommendation_id from b_plan
 join (select r_name field, r_regionkey regionkey from region) using (field) where "plan"='tilt') join (select (event_id%5)::varchar recommendation_id, max_by(user_id::varchar, ts) approved_by from events where event_type='view' group by 1) using (recommendation_id)""")
def _(t):
    path = scratch(t, "targets")
    reg = t.read("region").select(F.col("r_name").alias("field"), F.col("r_regionkey").cast("string").alias("recommendation_id"))
    rates = pl.plans(t).where(F.col("plan") == "tilt").join(reg, "field").select(F.col("injector").alias("well"), F.col("rate").alias("target_rate"), "recommendation_id")
    hist = t.read("events").select(
        (F.col("event_id") % 5).cast("string").alias("recommendation_id"), F.when(F.col("event_type") == "view", "approve").otherwise("other").alias("action"),
        F.col("user_id").cast("string").alias("actor"), F.col("ts").alias("at"),
    )
    rows = exports.target_rows(rates, hist, "engine", "m3/d")
    exports.writeback_append_csv(rows.where(F.col("recommendation_id") < "2"), path)
    exports.writeback_append_csv(rows.where(F.col("recommendation_id") >= "2"), path)
    schema = ", ".join(f"{c} {'double' if c == 'target_rate' else 'string'}" for c in exports.TARGET_COLUMNS)
    return readers.read_csv(t.spark, path, schema).select("well", "target_rate", "rate_unit", "recommendation_id", "approved_by")


# ------------------------------------------------------------------ streams
def daily_files(t) -> str:
    """The event log cut into four stretches of time, written one after another as it would arrive."""
    path = scratch(t, "stream-in")
    e = t.read("events").select(F.col("user_id").alias("well"), F.col("ts").cast("timestamp").alias("ts"), "value")
    day = F.dayofmonth("ts")
    for lo, hi in ((1, 8), (9, 16), (17, 24), (25, 31)):
        e.where(day.between(lo, hi)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(t):
    return monitor.stream_parquet(t.spark, daily_files(t), "well bigint, ts timestamp, value double", 1)


def run(t, df):
    return monitor.run_once(df, scratch(t, "stream-out"), scratch(t, "stream-state"))


@query("stream_rates", "select user_id well, count(*) n, round(sum(value),2) total from (select distinct user_id, ts, first_value(value) over (partition by user_id, ts) value from events) group by 1")
def _(t):
    out = run(t, monitor.stream_rates(stream(t)))
    return out.groupBy("well").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 2).alias("total"))


@query("stream_monthly_agg", """select user_id well, strftime(b,'%Y-%m-%d %H:%M:%S') "start", count(*) n, round(sum(value),2) total from (select *, time_bucket(interval 7 days, ts, timestamp '1970-01-01') b from events)
 where b + interval 7 days <= (select max(ts) from events) - interval 1 day group by user_id, b""")
def _(t):
    out = run(t, monitor.stream_monthly_agg(stream(t), "ts", "well", "value", "7 days", "1 day"))
    return out.select("well", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", rd("total", 2).alias("total"))


@query("stream_band_alerts", """select user_id well, strftime(ts,'%Y-%m-%d %H:%M:%S') "at", round(value,2) value from events join (select user_id, quantile_cont(value,0.1) p10, quantile_cont(value,0.9) p90 from events group by 1) using (user_id) where value<p10 or value>p90""")
def _(t):
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    band = t.read("events").groupBy(F.col("user_id").alias("well")).agg(q.alias("q")).select("well", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))
    out = run(t, monitor.stream_band_alerts(stream(t), band, "well", "value").select("well", "ts", "value"))
    return out.select("well", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), rd("value", 2).alias("value"))


@query("stream_dq_diff")
def _(t):
    root = scratch(t, "dq")
    rep = lambda b: b.groupBy("well").agg(F.count(F.lit(1)).alias("value"))
    monitor.run_batches(stream(t), monitor.dq_diff_sink(root, rep, ["well"]), scratch(t, "dq-state"))
    return t.spark.read.parquet(f"{root}/changes")


_DAILY = "select user_id well, cast(ts as date) d, avg(value) value from events group by 1,2"


@query("stream_cusum", f"""select well, d, round(pa-min(pa) over o,4) up, round(pd-min(pd) over o,4) down from (select *, sum(a) over o pa, sum(b) over o pd from (
 select *, case when rn=1 then 0 else (value-f)/5-0.5 end a, case when rn=1 then 0 else -(value-f)/5-0.5 end b from (select *, first_value(value) over o f, row_number() over o rn from ({_DAILY}) window o as (partition by well order by d)))
 window o as (partition by well order by d)) window o as (partition by well order by d)""")
def _(t):
    """Daily means per well arrive day by day and update the running sums."""
    path = scratch(t, "daily")
    day = t.read("events").groupBy(F.col("user_id").alias("well"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("value"))
    part = F.when(F.col("d") < F.lit("2024-01-11").cast("date"), 0).when(F.col("d") < F.lit("2024-01-21").cast("date"), 1).otherwise(2)
    for i in range(3):
        day.where(part == i).coalesce(1).write.mode("append").parquet(path)
    s = monitor.stream_parquet(t.spark, path, "well bigint, d date, value double", 1).withColumn("ts", F.col("d").cast("timestamp"))
    out = run(t, monitor.stream_cusum(s, "well", "ts", "value", 5.0))
    return out.select(F.col("key").cast("bigint").alias("well"), F.to_date("ts").alias("d"), rd("up", 4).alias("up"), rd("down", 4).alias("down"))


@query("stream_activity_sessions", """select well, strftime(min(ts),'%Y-%m-%d %H:%M:%S') "start", strftime(max(ts)+interval 12 hours,'%Y-%m-%d %H:%M:%S') "end", count(*) n from (
 select *, sum(nw) over (partition by well order by ts) s from (select user_id well, ts, case when ts-lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end nw from events))
 group by well, s having max(ts)+interval 12 hours <= (select max(ts) from events) - interval 1 day""")
def _(t):
    out = run(t, monitor.stream_activity_sessions(stream(t), "ts", "well", "12 hours", "1 day"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("well", text("start"), text("end"), "n")
