"""Queries: actions, surveillance and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog import planning as pl, stages
from wellspan.catalog.ctes import CTES
from wellspan.catalog.field_facts import one_field, profile
from wellspan.catalog.registry import query
from wellspan.catalog.scores import alloc, badges, entries, inj, prod, r, report, wor
from wellspan.functions.numeric import rd
from wellspan.operators import clean, fit, pressure, roles, sectors, verify
from wellspan.plans import actions, forecast, reports, scenarios, surveillance as sv
from wellspan.session import cut_lineage

_NUM = "cast(regexp_extract({c},'[0-9]+') as int)"


def num(c):
    return F.regexp_extract(c, "[0-9]+", 0).cast("int")


# ------------------------------------------------------------------ actions
CTES["b_moves"] = f"""select field, injector, b.rate rate_from, t.rate rate_to, case when {_NUM.format(c='injector')}%2=0 then 'HIGH' else 'LOW' end confidence, concat('F-',{_NUM.format(c='injector')}%4) facility
 from (select * from b_plan where "plan"='base') b join (select * from b_plan where "plan"='tilt') t using (field, injector)"""
CTES["b_ramp"] = """select *, case when suppressed then rate_from else rate_to end target, case when confidence='HIGH' then 0.15e0 else 0.08e0 end frac from (
 select *, abs(rate_to-rate_from)<0.05*greatest(rate_from,1e-9) or abs(rate_to-rate_from)<10/6.289810770432105e0 suppressed from b_moves)"""
_WEEKS = """with recursive wk as (select field, injector, 0 wn, rate_from rate, target, frac from b_ramp union all
 select field, injector, wn+1, rate+least(greatest(target-rate,-cap),cap), target, frac from (select *, frac*greatest(rate,0.05*greatest(target,1e-9)) cap from wk where abs(target-rate)>=1e-9)) """


def ramped(t):
    def build():
        p = pl.plans(t)
        a = p.where(F.col("plan") == "base").select("field", "injector", F.col("rate").alias("rate_from"))
        b = p.where(F.col("plan") == "tilt").select("field", "injector", F.col("rate").alias("rate_to"))
        m = a.join(b, ["field", "injector"]).withColumn("confidence", F.when(num("injector") % 2 == 0, "HIGH").otherwise("LOW"))
        return actions.ramp(m.withColumn("facility", F.concat(F.lit("F-"), num("injector") % 4)))

    return stages.stage(t, "ramped", build)


@query("ramp_weekly", _WEEKS + 'select field, injector, wn "week", round(rate,5) rate from wk where wn>0 /*recursive*/')
def _(t):
    return actions.weekly_rows(ramped(t)).select("field", "injector", "week", r("rate", 5))


def action_rows(t):
    gains = pl.totals(t).where(F.col("plan").isin("base", "tilt")).groupBy("field").agg(
        F.sum(F.when(F.col("plan") == "tilt", F.col("cum_oil")).otherwise(-F.col("cum_oil"))).alias("g"), F.count_distinct("member").alias("n")
    ).select("field", (F.col("g") / F.col("n")).alias("total_gain"))
    return actions.action_list(ramped(t), gains, pl.marginal(t), "2002-01-01")


@query("action_list", _WEEKS + """, nw as (select field, injector, max(wn) nwk, max(rate) filter (wn=1) w1 from wk group by 1,2),
 g as (select field, greatest(sum(case "plan" when 'tilt' then cum_oil else -cum_oil end)/count(distinct member),0) tg from b_tot where "plan" in ('base','tilt') group by 1),
 a as (select r.*, nwk, w1, tg, abs(target-rate_from)*greatest(coalesce(delta/hh,0),0) s1, abs(target-rate_from) s2 from b_ramp r join nw using (field, injector) join g using (field)
  left join b_vmarg m on m.field=r.field and m."case"=r.injector left join b_h h on h.field=r.field),
 s as (select *, tg*case when sum(s1) over (partition by field)>0 then s1/sum(s1) over (partition by field) when sum(s2) over (partition by field)>0 then s2/sum(s2) over (partition by field) else 0 end gain from a)
 select field, injector, facility, round(rate_from,5) rate_from, round(target,5) rate_to, round(w1-rate_from,5) first_step, nwk as "weeks", cast(date '2002-01-01'+nwk*7 as date) target_date, round(gain,2) expected_gain
 from s where not suppressed and s2>=1e-9 /*recursive*/""")
def _(t):
    a = actions.in_order(action_rows(t))
    return a.select("field", "injector", "facility", r("rate_from", 5), r("rate_to", 5), r("first_step", 5), "weeks", "target_date", r("expected_gain", 2))


@query("injectivity_hint", f"""select field, injector, case when ii>0 then printf('target %.0f, injection pressure about %.0f', round_even(rate_to,0), round_even(9000+rate_to/ii,0)) else printf('target %.0f, set choke or pump', round_even(rate_to,0)) end hint from (
 select *, ({_NUM.format(c='injector')}%3)*0.5 ii from b_moves)""")
def _(t):
    m = ramped(t).withColumn("ii", (num("injector") % 3) * 0.5)
    return m.select("field", "injector", actions.injectivity_hint(F.col("rate_to"), F.col("ii"), F.lit(9000.0)).alias("hint"))


# ------------------------------------------------------------------ surveillance
CTES["b_check"] = f"""select *, case when actual>=p10 and actual<=p90 then 'within band' when dq then 'data problem' else 'reservoir change' end finding from (
 select field, producer, max(liq) actual, quantile_cont(pred,0.1) p10, quantile_cont(pred,0.9) p90, {_NUM.format(c='producer')}%2=0 dq from b_pred where step=n_steps-1 group by 1,2)"""


def checked(t):
    last = stages.predictions(t).where(F.col("step") == F.col("n_steps") - 1)
    band = verify.prediction_band(last).select("field", "producer", "p10", "p90")
    act = last.groupBy("field", "producer").agg(F.max("liq").alias("actual"))
    a = act.join(band, ["field", "producer"]).withColumn("dq_changed", num("producer") % 2 == 0)
    return sv.forecast_band_check(a)


@query("forecast_band_check", "select field, producer, round(actual,4) actual, round(p10,4) p10, round(p90,4) p90, finding from b_check")
def _(t):
    return checked(t).select("field", "producer", r("actual", 4), r("p10", 4), r("p90", 4), "finding")


CTES["b_recs"] = "select o_orderkey rec_id, cast(o_orderdate as date) implemented_at, o_orderpriority pr, o_totalprice price from orders"
CTES["b_due"] = """select rec_id, implemented_at, months_after, due from (select *, cast(date_trunc('month', implemented_at)+to_months(months_after) as date)+least(day(implemented_at),28)::int-1 due
 from b_recs, (select unnest([3,6]) months_after)) where date '1998-08-01'>=due and not (rec_id%3=0 and months_after=3)"""


def recs(t):
    return t.read("orders").select(
        F.col("o_orderkey").alias("rec_id"), F.to_date("o_orderdate").alias("implemented_at"), F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("price")
    )


def due(t):
    done = recs(t).where(F.col("rec_id") % 3 == 0).select("rec_id", F.lit(3).alias("months_after"))
    return sv.due_evaluations(recs(t), F.lit("1998-08-01").cast("date"), done)


@query("due_evaluations", "select rec_id, months_after, due from b_due")
def _(t):
    return due(t).select("rec_id", "months_after", "due")


@query("surveillance_rules", """select field, 1 rule, 'new month of data' "trigger", cast(null as varchar) well, cast(null as varchar) detail from b_last union all
 select field, case finding when 'within band' then 2 when 'data problem' then 3 else 4 end, case finding when 'within band' then 'forecast within band' when 'data problem' then 'outside band, data changed' else 'outside band, data unchanged' end, producer, null from b_check union all
 select distinct field, 5, 'new event', well, null from b_events where date>=date '2001-06-01' union all select field, 6, 'quarterly', null, null from b_last where field<'E' union all
 select field, 7, 'evaluation due', null, m::varchar from b_last, (select unnest([3,6]) m) where field>'B'""")
def _(t):
    new = t.events().where(F.col("date") >= F.lit("2001-06-01").cast("date"))
    fields = stages.n_train(t).select("field", F.when(F.col("field") >= "E", F.lit("2001-11-01").cast("date")).alias("last_full_run"))
    d = stages.n_train(t).where(F.col("field") > "B").select("field", F.explode(F.array(F.lit(3), F.lit(6))).alias("months_after"))
    return sv.surveillance_rules(checked(t), new, fields, d, F.lit("2001-12-01").cast("date"))


@query("evaluate_outcome", """select field, "plan", round(p10,2) p10, round(p50,2) p50, round(p90,2) p90, round(re,2) realised, case when re>p90 then 'better' when re<p10 then 'worse' else 'within band' end outcome from (
 select field, "plan", quantile_cont(cum_oil*0.25,0.1) p10, quantile_cont(cum_oil*0.25,0.5) p50, quantile_cont(cum_oil*0.25,0.9) p90, max(case when member=2 then cum_oil*0.25*(0.8+0.1*length("plan")-0.2) end) re from b_tot group by 1,2)""")
def _(t):
    real = F.when(F.col("member") == 2, F.col("cum_oil") * 0.25 * (0.8 + 0.1 * F.length("plan") - 0.2))
    e = sv.evaluate_outcome(pl.totals(t), ["field", "plan"], F.lit(6.0), 24, real)
    return e.select("field", "plan", r("p10", 2), r("p50", 2), r("p90", 2), r("realised", 2), "outcome")


CTES["b_records"] = """select rec_id, case when pr in ('1-URGENT','2-HIGH') then 'HIGH' when pr='5-LOW' then 'LOW' else 'MEDIUM' end badge, case when price>350000 then 'better' when price<120000 then 'worse' else 'within band' end outcome from b_recs"""
CTES["b_hits"] = """select badge, count(*) n, avg((outcome='within band')::int) within_band, avg((outcome='better')::int) better, avg((outcome='worse')::int) worse from b_records group by 1"""


def hits(t):
    badge = F.when(F.col("pr").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("pr") == "5-LOW", "LOW").otherwise("MEDIUM")
    return sv.hit_rate(recs(t).select("rec_id", badge.alias("badge"), sv.outcome(F.col("price"), F.lit(120000.0), F.lit(350000.0)).alias("outcome")))


@query("hit_rate", "select badge, n, round(within_band,6) within_band, round(better,6) better, round(worse,6) worse from b_hits")
def _(t):
    return hits(t).select("badge", "n", r("within_band"), r("better"), r("worse"))


@query("recalibrate_threshold", "select n, round(case when n>=5 and within_band+better<0.8 then least(0.85e0+0.02e0,0.99e0) else 0.85e0 end,4) threshold from b_hits where badge='HIGH'")
def _(t):
    return sv.recalibrate_threshold(hits(t), 0.85).select("n", r("threshold", 4))


@query("implementation_deviation", """select field, injector, round(rate_to,5) recommended, round(rate_from,5) actual, round(rate_from-rate_to,5) deviation from b_moves where abs(rate_from-rate_to)>1e-9""")
def _(t):
    p = pl.plans(t)
    d = sv.implementation_deviation(p.where(F.col("plan") == "tilt").drop("plan"), p.where(F.col("plan") == "base").drop("plan"))
    return d.select("field", "injector", r("recommended", 5), r("actual", 5), r("deviation", 5))


CTES["b_life"] = """select *, coalesce(lag(to_state) over (partition by rec_id order by seq),'DRAFT') from_state from (select event_id//4 rec_id, event_id seq,
 case event_type when 'click' then 'review' when 'view' then 'approve' when 'error' then 'reject' else 'implement' end "action",
 case event_type when 'click' then 'REVIEWED' when 'view' then 'APPROVED' when 'error' then 'REJECTED' else 'IMPLEMENTED' end to_state from events)"""


@query("lifecycle_check", """select rec_id, seq, from_state, "action", to_state from b_life where (from_state, "action", to_state) not in (('DRAFT','review','REVIEWED'),('REVIEWED','approve','APPROVED'),
 ('REVIEWED','reject','REJECTED'),('DRAFT','reject','REJECTED'),('APPROVED','implement','IMPLEMENTED'),('IMPLEMENTED','evaluate','EVALUATED'))""")
def _(t):
    et = F.col("event_type")
    pick = lambda a, b, c, d: F.when(et == "click", a).when(et == "view", b).when(et == "error", c).otherwise(d)
    h = t.read("events").select(
        F.floor(F.col("event_id") / 4).alias("rec_id"), F.col("event_id").alias("seq"), pick("review", "approve", "reject", "implement").alias("action"),
        pick("REVIEWED", "APPROVED", "REJECTED", "IMPLEMENTED").alias("to_state"),
    )
    return sv.lifecycle_check(h).select("rec_id", "seq", "from_state", "action", "to_state")


CTES["b_cuts"] = """select field, producer, coalesce(sum(water) filter (step>=n_steps-3)/nullif(sum(oil+water) filter (step>=n_steps-3),0),0) cut_now,
 coalesce(sum(water) filter (step between n_steps-12 and n_steps-10)/nullif(sum(oil+water) filter (step between n_steps-12 and n_steps-10),0),0) cut_then from b_p group by 1,2"""
CTES["b_revert"] = """select field, injector, rate_from, array_to_string(list_sort(list(producer)),', ') producers from b_pair join b_cuts using (field, producer) join b_moves using (field, injector) where cut_now-cut_then>0.05 group by 1,2,3"""


def reverts(t):
    n, s = F.col("n_steps"), F.col("step")
    cut = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(cond, F.col("water"))), F.sum(F.when(cond, F.col("oil") + F.col("water")))), F.lit(0.0))
    c = prod(t).groupBy("field", "producer").agg(cut(s >= n - 3).alias("cut_now"), cut((s >= n - 12) & (s <= n - 10)).alias("cut_then"))
    conn = stages.pairs(t).select("field", "injector", "producer")
    return sv.revert_alerts(ramped(t), conn, c.select("field", "producer", "cut_now"), c.select("field", "producer", "cut_then"), 0.05)


@query("revert_alerts", "select field, injector, round(rate_from,5) rate_from, producers from b_revert")
def _(t):
    return reverts(t).select("field", "injector", r("rate_from", 5), F.array_join("producers", ", ").alias("producers"))


@query("dq_diff", """select field, entity, round(b,6) "before", round(a,6) "after" from (select field, entity, avg((days_on>0)::int) b from b_grid where step<n_steps-6 group by 1,2 union all select distinct field, 'closed', 1.0 from b_grid)
 full join (select field, entity, avg((days_on>0)::int) a from b_grid group by 1,2 union all select distinct field, 'opened', 1.0 from b_grid) using (field, entity) where b is distinct from a""")
def _(t):
    g = stages.grid(t)
    c = lambda d: sv.coverage(d).withColumnRenamed("coverage", "value")
    extra = lambda name: g.select("field").distinct().select("field", F.lit(name).alias("entity"), F.lit(1.0).alias("value"))
    earlier = c(g.where(F.col("step") < F.col("n_steps") - 6)).select("field", "entity", "value").unionByName(extra("closed"))
    later = c(g).select("field", "entity", "value").unionByName(extra("opened"))
    out = sv.dq_diff(earlier, later, ["field", "entity"])
    return out.select("field", "entity", r("before"), r("after"))


@query("alerts_union", """select kind, message, field, severity from (select *, row_number() over (partition by kind, message order by g, seq) k from (
 select field, 'condition' kind, concat(type,' at ',well) message, 'info' severity, seq, 0 g from b_events union all
 select field, 'data_quality', concat('recent data for ',producer,' look inconsistent'), 'warning', 0, 1 from b_check where finding='data problem' union all
 select field, 'revert', concat('water cut rose after the change at ',injector), 'warning', 0, 2 from b_revert)) where k=1""")
def _(t):
    z = F.lit(0).cast("bigint")
    ev = t.events().select("field", F.lit("condition").alias("kind"), F.concat("type", F.lit(" at "), "well").alias("message"), F.lit("info").alias("severity"), "seq")
    dq = checked(t).where(F.col("finding") == "data problem").select(
        "field", F.lit("data_quality").alias("kind"), F.concat(F.lit("recent data for "), "producer", F.lit(" look inconsistent")).alias("message"), F.lit("warning").alias("severity"), z.alias("seq"))
    rv = reverts(t).select("field", F.lit("revert").alias("kind"), F.concat(F.lit("water cut rose after the change at "), "injector").alias("message"), F.lit("warning").alias("severity"), z.alias("seq"))
    return sv.alerts_union([ev, dq, rv])


@query("conditions", """select 'OUTLIERS_REMOVED' code, 'well:'||entity scope, 'info' severity, concat(n,' spikes replaced at ',entity) message from (select entity, count(*) n from b_clean where is_spike group by field, entity)
 union all select 'SIMULTANEOUS_PI', 'well:'||well, 'warning', concat(well,' produced and injected in ',n_simultaneous,' months') from b_types where n_simultaneous>0
 union all select 'CONVERSION_DETECTED', 'well:'||well, 'info', concat(well,' changed from ',case from_role when 'P' then 'producer' else 'injector' end,' to ',case to_role when 'P' then 'producer' else 'injector' end,' in ',strftime(date,'%Y-%m')) from b_conv""")
def _(t):
    return found_conditions(t).select("code", "scope", "severity", "message")


def found_conditions(t):
    def ctx(**kv):
        return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]).alias("context")

    scope = lambda c: F.concat(F.lit("well:"), c).alias("scope")
    o = clean.outlier_report(clean.clean_grid(stages.grid(t))).where(F.col("n_replaced") > 0)
    o = o.select(F.lit("OUTLIERS_REMOVED").alias("code"), scope("entity"), ctx(well=F.col("entity"), count=F.col("n_replaced")))
    s = roles.well_types(t.rates()).where(F.col("n_simultaneous") > 0)
    s = s.select(F.lit("SIMULTANEOUS_PI").alias("code"), scope("well"), ctx(well=F.col("well"), steps=F.col("n_simultaneous")))
    name = lambda c: F.when(F.col(c) == "P", "producer").otherwise("injector")
    c = roles.conversions(t.rates())
    c = c.select(F.lit("CONVERSION_DETECTED").alias("code"), scope("well"), ctx(well=F.col("well"), from_role=name("from_role"), to_role=name("to_role"), when=F.date_format("date", "yyyy-MM")))
    return sv.conditions(o.unionByName(s).unionByName(c))


CTES["b_dq"] = """select field, round(c.cov,6) mean_coverage, n_steps, coalesce(o.n,0)::bigint outliers_removed, s.n::bigint simultaneous_steps, coalesce(u.n,0) unmatched_ids, s.k+(coalesce(u.n,0)>0)::int+(n_steps<36)::int n_warnings,
 case when n_steps<8 then 'red' when s.k+(coalesce(u.n,0)>0)::int+(n_steps<36)::int>0 then 'amber' else 'green' end traffic_light from (select field, avg((days_on>0)::int) cov, max(n_steps) n_steps from b_grid group by 1) c
 left join (select field, count(*) filter (is_spike) n from b_clean group by 1) o using (field) left join (select field, sum(n_simultaneous) n, count(*) filter (n_simultaneous>0) k from b_types group by 1) s using (field)
 left join (select field, count(*) n from (select distinct field, well from (select field, well from b_pressure union all select field, concat('X-', well) from b_pressure where src='ESP') where well not in (select well from b_rates)) group by 1) u using (field)"""


def dq(t):
    types = roles.well_types(t.rates())
    known, gauges = t.rates().select("field", "well").distinct(), t.pressure()
    unknown = gauges.where(F.col("src") == "ESP").select("field", F.concat(F.lit("X-"), "well").alias("well"))
    miss = gauges.select("field", "well").unionByName(unknown).distinct().join(known, ["field", "well"], "left_anti")
    g = stages.grid(t)
    return sv.dq_report(g, clean.outlier_report(clean.clean_grid(g)), types, miss)


@query("dq_report", "select * from b_dq")
def _(t):
    return dq(t).withColumn("mean_coverage", rd("mean_coverage"))


CTES["b_bt"] = """select o.field, o.member, o.step origin, p.producer, p.step-o.step+1 h, p.pred*coalesce(least(greatest(o.lo/o.lf,0.5),2),1) forecast, p.liq actual from (select *, avg(case when gd then liq end) over w lo, avg(case when gd then pred end) over w lf
 from (select *, "on" and liq>0 and pred>0 gd from b_pred) window w as (partition by field, member, producer order by step rows between 3 preceding and 1 preceding)) o
 join (select * from b_pred where "on") p on p.field=o.field and p.member=o.member and p.producer=o.producer and p.step>=o.step and p.step<o.step+6 where o.step>=24 and (o.step-24)%3=0"""


@query("backtest_origins", "select field, member, h, round(sum(forecast)/sum(actual),4) ratio, count(*) n from b_bt group by 1,2,3")
def _(t):
    ks = ["field", "member"]
    rows = sv.backtest_origins(stages.predictions(t), 24, 3, 6, ks)
    return sv.backtest_summary(rows, ks).select(*ks, "h", r("ratio", 4), "n")


# ------------------------------------------------------------------ reports
_BPD = "6.289810770432105e0"


@query("display_units", f"""select field, producer, step, round(liq*{_BPD},4) rate_bbl_d, round(liq*dt_days*{_BPD},3) volume_bbl, round(9000*0.14503773773020923e0,4) pressure_psi from b_p""")
def _(t):
    d = reports.display
    return prod(t).select(
        "field", "producer", "step", rd(d(F.col("liq"), "rate"), 4).alias("rate_bbl_d"), rd(d(F.col("liq") * F.col("dt_days"), "volume"), 3).alias("volume_bbl"),
        rd(d(F.lit(9000.0), "pressure"), 4).alias("pressure_psi"),
    )


@query("dt_tau_table", """select field, round(dt_days,6) dt_days, 120e0 tau_days, round(120/dt_days,6) tau_over_dt, round(od,6) od, ceil(6.0*(n_inj+1))::bigint history_needed from b_profile""")
def _(t):
    d = reports.dt_tau_table(profile(t), F.lit(120.0))
    return d.select("field", r("dt_days"), "tau_days", r("tau_over_dt"), r("od"), "history_needed")


@query("report_wells", """select e.field, e.entity, t.type, x, y, round(cov,6) coverage_fraction, coalesce(s.source,'') pressure_source from b_loc e join (select field, entity, avg((days_on>0)::int) cov from b_grid group by 1,2) c using (field, entity)
 join b_types t on t.field=e.field and t.well=e.well left join b_src s on s.field=e.field and s.well=e.well""")
def _(t):
    one = one_field(t)
    sec = sectors.connected_components(sectors.sector_edges(one)).join(one.select("entity", F.col("block").alias("_f")), "entity").select(F.col("_f").alias("field"), "entity", "sector")
    w = reports.wells(sv.coverage(stages.grid(t)), stages.entities(t), roles.well_types(t.rates()), sec, pressure.well_pressure_source(t.pressure()))
    return w.drop("sector").withColumn("coverage_fraction", rd("coverage_fraction"))


@query("report_connectivity", """select p.field, p.injector, p.producer, round(f,6) f_ij, round(case when f_mean<=1e-3 then 1 else least(greatest(1-f_std/f_mean,0),1) end,6) pair_confidence, round(d,5) distance_m
 from b_pair p join b_ps using (field, injector, producer)""")
def _(t):
    c = reports.connectivity(stages.pairs(t), verify.pair_confidence(stages.member_pairs(t)))
    return c.select("field", "injector", "producer", r("f_ij"), r("pair_confidence"), r("distance_m", 5))


@query("report_tau", "select field, member, producer, tau tau_days, round(blind_r2,4) blind_r2, round(blind_mape,3) blind_mape_pct from b_prod left join (select * from b_vr where producer is not null) using (field, producer)")
def _(t):
    rep = report(t).where(F.col("producer").isNotNull()).select("field", "member", "producer", "blind_r2", "blind_mape")
    return reports.tau(stages.params(t), rep, ["member"]).select("field", "member", "producer", "tau_days", r("blind_r2", 4), r("blind_mape_pct", 3))


@query("report_history_match", f"""select c.field, p.member, c.entity producer, c.date, round(liq_raw*{_BPD},3) raw_liquid, round(c.liq*{_BPD},3) cleaned_liquid, round(pred*{_BPD},3) model_liquid, round(c.oil*{_BPD},3) oil, round(c.water*{_BPD},3) water, c.step>=n_train blind
 from b_clean c join b_split using (field) join b_pred p on p.field=c.field and p.producer=c.entity and p.step=c.step where c.role='P'""")
def _(t):
    h = reports.history_match(clean.clean_grid(stages.grid(t)), stages.predictions(t), keys=["member"])
    return h.select("field", "member", "producer", "date", *[r(c, 3) for c in ("raw_liquid", "cleaned_liquid", "model_liquid", "oil", "water")], "blind")


_FF = ", ".join(f"round(max(case when \"plan\"='{p}' then {q} end)*{_BPD},3) {n}_{q}" for n, p in (("plan", "tilt"), ("base", "base")) for q in ("p10", "p50", "p90"))


@query("report_forecast_field", f"""select field, date, {_FF} from (select field, "plan", h, quantile_cont(o,0.1) p10, quantile_cont(o,0.5) p50, quantile_cont(o,0.9) p90 from (
 select field, "plan", member, h, sum(oil) o from b_fc group by 1,2,3,4) group by 1,2,3) join b_cal using (field, h) group by 1,2""")
def _(t):
    f = reports.forecast_field(forecast.field_fan(pl.fc(t), ["field", "plan"]), pl.calendar(t), "tilt", "base")
    return f.select("field", "date", *[r(f"{n}_{q}", 3) for n in ("plan", "base") for q in ("p10", "p50", "p90")])


@query("report_rates", f"""select field, injector, round(rate_to*{_BPD},4) recommended, round(rate_from*{_BPD},4) implemented from b_moves""")
def _(t):
    p = pl.plans(t)
    x = reports.rates(p.where(F.col("plan") == "tilt"), p.where(F.col("plan") == "base"))
    return x.select("field", "injector", r("recommended", 4), r("implemented", 4))


@query("report_run", """select field, item, value from (select field, 'n_steps' item, max(n_steps)::varchar value from b_grid group by 1 union all select field, 'n_entities', count(distinct entity)::varchar from b_grid group by 1
 union all select field, 'rate_unit', 'bbl/d' from b_last)""")
def _(t):
    g = stages.grid(t).groupBy("field").agg(F.max("n_steps").alias("n"), F.count_if(F.col("step") == 0).alias("e"))
    return reports.run_table({"n_steps": F.col("n"), "n_entities": F.col("e"), "rate_unit": F.lit("bbl/d")}, g)


@query("report_workflow", """select rec_id, seq, "action", from_state, to_state from b_life""")
def _(t):
    et = F.col("event_type")
    pick = lambda a, b, c, d: F.when(et == "click", a).when(et == "view", b).when(et == "error", c).otherwise(d)
    from pyspark.sql import Window

    h = t.read("events").select(
        F.floor(F.col("event_id") / 4).alias("rec_id"), F.col("event_id").alias("seq"), pick("review", "approve", "reject", "implement").alias("action"),
        pick("REVIEWED", "APPROVED", "REJECTED", "IMPLEMENTED").alias("to_state"),
    )
    return h.withColumn("from_state", F.coalesce(F.lag("to_state").over(Window.partitionBy("rec_id").orderBy("seq")), F.lit("DRAFT")))
