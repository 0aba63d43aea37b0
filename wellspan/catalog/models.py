"""Queries: response filter, fits and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog import stages
from wellspan.catalog.ctes import CTES
from wellspan.catalog.registry import query
from wellspan.functions.numeric import rd
from wellspan.functions.response import exp_filter, primary_decline
from wellspan.operators import fit, sectors
from wellspan.session import cut_lineage

CTES["b_xf"] = "select *, cast(substr(well,3) as int) k from b_grid where role='I'"
CTES["b_prod"] = """select field, entity producer, cast(60+30*(cast(substr(well,3) as int)%5) as double) tau from b_entities where role='P'"""
CTES["b_m"] = "select unnest(range(0,5))::int member"
CTES["b_mpair"] = "select field, injector, producer, member, d, f*(0.9+0.05*member) f from b_pair, b_m"
CTES["b_mprod"] = "select field, producer, member, tau*(0.8+0.1*member) tau from b_prod, b_m"
CTES["b_pstart"] = """select field, producer, start, case when start=0 then first_rate else med end q0, t_start from (
 select field, entity producer, min(start) start, max(liq) filter (step=start) first_rate, quantile_cont(liq,0.5) filter (step between start and start+2) med,
 max(t_days) filter (step=start) t_start from (select *, min(case when days_on>0 then step end) over (partition by field, entity) start from b_grid where role='P') group by 1,2)"""
CTES["b_redis"] = """select field, member, injector, step, least(case when os>1e-12 then tot/greatest(os,1e-12) else 1 end, 3.0) g from (
 select p.field, p.member, p.injector, g.step, sum(case when g.days_on>0 then f else 0 end) os, sum(f) tot from b_mpair p join b_grid g on g.field=p.field and g.entity=p.producer group by 1,2,3,4)"""
CTES["b_msrc"] = """select p.field, p.member, p.producer, i.step, sum(p.f*i.inj*coalesce(r.g,1)) s from b_mpair p join b_grid i on i.field=p.field and i.entity=p.injector
 left join b_redis r on r.field=p.field and r.member=p.member and r.injector=p.injector and r.step=i.step group by 1,2,3,4"""
CTES["b_pred"] = """select field, producer, member, step, date, t_days, dt_days, n_steps, live "on", liq, oil, water,
 case when step>=start and live then exp(-u)*cs+q0*exp(-(t_days-t_start)/tau) else 0 end pred, case when step>=start then exp(-u)*cs else 0 end state from (
 select *, sum(mv*(1-exp(-dt_days/tau))*s*exp(u)) over (partition by field, member, producer order by step) cs from (
 select *, sum(mv*dt_days/tau) over (partition by field, member, producer order by step) u from (
 select g.field, g.entity producer, m.member, g.step, g.date, g.t_days, g.dt_days, g.n_steps, g.days_on>0 live, g.liq, g.oil, g.water, m.tau, st.start, st.q0, st.t_start,
 coalesce(x.s,0) s, case when g.step>st.start and g.days_on>0 then 1e0 else 0e0 end mv
 from b_grid g join b_mprod m on m.field=g.field and m.producer=g.entity join b_pstart st on st.field=g.field and st.producer=g.entity
 left join b_msrc x on x.field=g.field and x.producer=g.entity and x.member=m.member and x.step=g.step)))"""


@query("exp_filter", """select field, entity, step, round(exp(-u)*sum(mv*(1-exp(-dt_days/90.0))*inj*exp(u)) over (partition by field, entity order by step),6) x from (
 select *, sum(mv*dt_days/90.0) over (partition by field, entity order by step) u from (
 select *, case when step>0 and days_on>0 then 1e0 else 0e0 end mv from b_grid where role='I'))""")
def _(t):
    g = stages.grid(t).where(F.col("role") == "I")
    out = exp_filter(g, ["field", "well", "entity"], F.col("inj"), F.lit(90.0), "x", F.col("days_on") > 0)
    return out.select("field", "entity", "step", rd("x").alias("x"))


@query("producer_start", "select field, producer, start, round(q0,6) q0 from b_pstart")
def _(t):
    return fit.producer_start(fit.producer_rows(stages.grid(t))).select("field", "producer", "start", rd("q0").alias("q0"))


@query("primary_decline", """select g.field, g.entity producer, g.step, round(0.9*q0*exp(-(t_days-t_start)/(2*tau)),6) primary_rate from b_grid g
 join b_pstart s on s.field=g.field and s.producer=g.entity join b_prod p on p.field=g.field and p.producer=g.entity where g.step>=s.start""")
def _(t):
    p = fit.producer_rows(stages.grid(t))
    p = p.join(fit.producer_start(p), fit.PROD).join(stages.params(t), fit.PROD).where(F.col("step") >= F.col("start"))
    q = primary_decline(F.lit(0.9), F.col("q0"), F.col("t_days"), F.col("t_start"), 2 * F.col("tau"))
    return p.select("field", "producer", "step", rd(q).alias("primary_rate"))


@query("shutin_redistribution", "select field, injector, step, round(g,6) g from b_redis where member=2")
def _(t):
    g = fit.shutin_redistribution(stages.pairs(t), fit.producer_rows(stages.grid(t)), ["field"])
    return g.select("field", "injector", "step", rd("g").alias("g"))


CTES["b_tank0"] = """select field, step, t_days, dt_days, inj, liq raw, 60.0+30*r_regionkey tau0, avg(liq) over (partition by field) mraw from b_field join region on r_name=field"""
CTES["b_tank"] = """select field, step, t_days, dt_days, inj, 200*exp(-t_days/tau0)+0.6*exp(-t_days/tau0)*sum(case when step=0 then 0 else (1-exp(-dt_days/tau0))*inj*exp(t_days/tau0) end)
 over (partition by field order by step)+0.02*(raw-mraw) q from b_tank0"""
CTES["b_tbound"] = """select field, lo, least(3650e0, 60*m) hi from (select field, min(dt_days) filter (step>0) lo, avg(dt_days) filter (step>0) m from b_tank group by 1)"""


def _pass(src: str) -> str:
    return f"""select field, tau, f, yy-2*f*cy+f*f*cc sse from (select *, least(greatest(cy/cc,0),1) f from (
 select field, tau, sum(c*y) cy, sum(c*c) cc, sum(y*y) yy from (
 select t.field, t.step, s.tau, t.q-q0.q*exp(-t_days/s.tau) y, exp(-t_days/s.tau)*sum(case when t.step=0 then 0 else (1-exp(-dt_days/s.tau))*inj*exp(t_days/s.tau) end)
 over (partition by t.field, s.tau order by t.step) c from b_tank t join {src} s using (field) join (select field, q from b_tank where step=0) q0 on q0.field=t.field)
 join b_split sp using (field) where step<sp.n_train group by 1,2))"""


CTES["b_tg1"] = "select field, exp(ln(lo)+(ln(hi)-ln(lo))/15*k) tau from b_tbound, (select unnest(range(0,16)) k)"
CTES["b_tp1"] = _pass("b_tg1")
CTES["b_tb1"] = "select field, tau from b_tp1 qualify row_number() over (partition by field order by sse, tau)=1"
CTES["b_tg2"] = """select field, exp(ln(tau/r)+(ln(tau*r)-ln(tau/r))/15*k) tau from (select b.field, tau, exp((ln(hi)-ln(lo))/15) r from b_tb1 b join b_tbound using (field)),
 (select unnest(range(0,16)) k)"""
CTES["b_tp2"] = _pass("b_tg2")
CTES["b_tankfit"] = """select field, tau, f, sse from (select * from b_tp1 union all select * from b_tp2) qualify row_number() over (partition by field order by sse, tau)=1"""


@query("fit_field_tank", "select field, round(tau,4) tau, round(f,5) f, round(sse,2) sse from b_tankfit")
def _(t):
    return fit.fit_field_tank(stages.tank_rows(t), keep=cut_lineage).select("field", rd("tau", 4).alias("tau"), rd("f", 5).alias("f"), rd("sse", 2).alias("sse"))


@query("tank_allocation", """select field, producer, round(v/sum(v) over (partition by field),6) share, round(f*v/sum(v) over (partition by field),6) f_per_injector, n_injectors from (
 select g.field, g.entity producer, greatest(sum(liq),0) v from b_grid g join b_split s using (field) where role='P' and step<n_train group by 1,2)
 join b_tankfit using (field) join (select field, count(*) n_injectors from b_entities where role='I' group by 1) using (field)""")
def _(t):
    g = stages.grid(t)
    tank = fit.fit_field_tank(stages.tank_rows(t), keep=cut_lineage).join(stages.n_train(t), "field").select("field", "f", "n_train")
    a = fit.tank_allocation(fit.producer_rows(g), tank, stages.entities(t).where(F.col("role") == "I"))
    return a.select("field", "producer", rd("share").alias("share"), rd("f_per_injector").alias("f_per_injector"), "n_injectors")


@query("predict_history", """select field, producer, step, round(pred,5) pred, round(state,5) state from b_pred where member=2""")
def _(t):
    p = fit.predict_history(stages.grid(t), stages.pairs(t), stages.params(t))
    return p.select("field", "producer", "step", rd("pred", 5).alias("pred"), rd("state", 5).alias("state"))


def mask(t):
    return stages.pairs(t).select("field", "injector", "producer")


def solved(t):
    """Every grid solution of every producer for the known response."""
    inj = fit.injector_rows(stages.grid(t))
    grams = fit.producer_grams(stages.response(t), inj, mask(t), stages.n_train(t))
    return stages.stage(t, "solved", lambda: fit.solve_grams(grams))


def fitted(t):
    inj = fit.injector_rows(stages.grid(t))
    return stages.stage(
        t, "fitted", lambda: fit.fit_producer_grid(stages.response(t), inj, mask(t), stages.n_train(t), keep=cut_lineage)
    )


@query("fit_producer_grid")
def _(t):
    best = fitted(t).join(stages.params(t).select(*fit.PROD, F.col("tau").alias("true_tau")), fit.PROD)
    return best.select("field", "producer", "tau", "true_tau", F.size("injectors").alias("n_injectors"), "sse")


@query("fit_couplings")
def _(t):
    f = fit.couplings(fitted(t))
    truth = stages.pairs(t).select("field", "injector", "producer", F.col("f").alias("true_f"))
    return f.join(truth, ["field", "injector", "producer"])


@query("candidate_members")
def _(t):
    return fit.candidate_members(solved(t)).select("field", "producer", "member", "tau", "sse")


@query("quick_sum_f")
def _(t):
    return fit.quick_sums(fit.couplings(fitted(t)))


@query("injector_sum_bound")
def _(t):
    inj = fit.injector_rows(stages.grid(t)).withColumn("inj", F.col("inj") * 0.6)
    best = fitted(t).select(*fit.PROD, F.array("tau").alias("taus"))
    grams = cut_lineage(fit.producer_grams(stages.response(t), inj, mask(t), stages.n_train(t), taus=best))
    return fit.injector_sum_bound(grams, keep=cut_lineage)


CTES["b_influx"] = """select field, step, greatest(exp(-u)*(50+sum(case when step=0 then 0 else (1-exp(-dt_days*0.0005))*(-0.00025*(inj-liq)/0.0005)*exp(u) end) over (partition by field order by step)),0) we from (
 select *, t_days*0.0005 u from b_field)"""


@query("aquifer_influx", "select field, step, round(we,5) we from b_influx")
def _(t):
    from wellspan.operators.grid import field_collapse

    bal = field_collapse(stages.grid(t)).withColumn("imbalance", F.col("inj") - F.col("liq"))
    out = fit.aquifer_influx(bal, ["field"], F.lit(50.0), F.lit(5e-4), F.lit(2.5e-4))
    return out.select("field", "step", rd("we", 5).alias("we"))


@query("fit_aquifer_grid")
def _(t):
    from wellspan.operators.grid import field_collapse

    g = stages.grid(t)
    near = cut_lineage(sectors.distance_mask(stages.entities(t), 1.5).select("field", "injector", "producer"))
    return fit.fit_aquifer_grid(
        stages.response(t), fit.injector_rows(g), near, stages.n_train(t), cut_lineage(field_collapse(g).select("field", "step", "dt_days", "inj", "liq")), keep=cut_lineage,
    )
