"""Queries: forecast, economics, plans and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog import stages
from wellspan.catalog.ctes import CTES
from wellspan.catalog.registry import query
from wellspan.catalog.scores import alloc, inj, prod, r, wor
from wellspan.functions.numeric import rd
from wellspan.operators import fit, oilcut, sectors
from wellspan.plans import economics, forecast, scenarios
from wellspan.session import cut_lineage

CTES["b_last"] = "select field, max(date) last_date, max(t_days) t_last from b_axis group by 1"
CTES["b_cal"] = """select field, h, cast(m+to_months(h) as date) date, cast(date_diff('day', case when h=1 then last_date else cast(m+to_months(h-1) as date) end, cast(m+to_months(h) as date)) as double) dt_days,
 cast(date_diff('day', last_date, cast(m+to_months(h) as date)) as double) t_cum from (select *, date_trunc('month',last_date) m from b_last), (select unnest(range(1,25))::int h)"""
CTES["b_cur"] = "select field, entity injector, avg(inj) rate from b_grid where role='I' and step>=n_steps-1 group by 1,2"
CTES["b_active"] = "select field, producer, coalesce(bool_or(live) filter (step>=n_steps-3),false) active from b_p group by 1,2"
CTES["b_gend"] = """select field, member, injector, least(case when os>1e-12 then tot/greatest(os,1e-12) else 1 end,3.0) g from (select field, member, injector, sum(f) tot,
 sum(case when active then f else 0 end) os from b_mpair join b_active using (field, producer) group by 1,2,3)"""
CTES["b_anchor"] = """select field, producer, case when sum(oil+water)>0 then sum(oil)/sum(oil+water) end anchor from (
 select *, row_number() over (partition by field, producer order by step desc) k from b_p where live) where k<=3 group by 1,2"""
CTES["b_state"] = """select p.field, p.member, p.producer, p.state x0, m.tau, s.q0, l.t_last-s.t_start age, coalesce(c.cwi0,0) cwi0, ratio, active, alpha, beta, "offset", anchor from b_pred p
 join b_mprod m using (field, producer, member) join b_pstart s using (field, producer) join b_last l using (field) join b_ratio using (field, producer) join b_active using (field, producer)
 left join b_wor using (field, producer) left join b_anchor using (field, producer) left join (select field, member, producer, sum(f*v) cwi0 from b_mpair join
 (select field, entity injector, sum(inj*dt_days) v from b_grid where role='I' group by 1,2) using (field, injector) group by 1,2,3) c using (field, member, producer) where p.step=p.n_steps-1"""
CTES["b_plan"] = """select field, 'base' "plan", injector, rate from b_cur union all select field, 'equal', injector, avg(rate) over (partition by field) from b_cur
 union all select field, 'tilt', injector, rate*(0.5+cast(regexp_extract(injector,'[0-9]+') as int)%4/3.0) from b_cur"""
CTES["b_fsrc"] = """select field, "plan", member, producer, coalesce(source,0) source, coalesce(support,0) support from (select distinct field, "plan" from b_plan) join b_mprod using (field) left join (
 select field, "plan", member, producer, sum(f*rate*g) source, sum(f*rate) support from b_plan join b_mpair using (field, injector) join b_gend using (field, member, injector) group by 1,2,3,4) using (field, "plan", member, producer)"""
_SIM = """select {k}, h, date, dt_days, t_cum, cwi, liq, liq*ratio*cut oil, greatest(liq*ratio-liq*ratio*cut,0) water from (select *, case when alpha is null then coalesce(anchor,0.5)
 when anchor is null then fo when fe>1e-3 and fe<0.999 then least(greatest(fo*anchor/fe,0),1) else anchor end cut from (select *, b_fo(alpha,beta,"offset",cwi) fo, b_fo(alpha,beta,"offset",cwi0) fe from (
 select *, cwi0+support*t_cum cwi, (case when active then 1 else 0 end)*greatest(q0*exp(-(age+t_cum)/tau)+case when active then x0*exp(-t_cum/tau)+source*(1-exp(-t_cum/tau)) else x0 end,0) liq
 from {src} join b_state using (field, member, producer) join b_cal using (field))))"""
CTES["b_fc"] = _SIM.format(k='field, "plan", member, producer', src="b_fsrc")
CTES["b_mt"] = """select field, "plan", member, h, dt_days, t_cum, sum(oil) oil, sum(water) water, max(inj) inj from b_fc join (select field, "plan", sum(rate) inj from b_plan group by 1,2) using (field, "plan") group by 1,2,3,4,5,6"""
CTES["b_tot"] = """select field, "plan", member, sum(oil*dt_days) cum_oil, sum(water*dt_days) cum_water from b_fc group by 1,2,3"""


def calendar(t):
    last = stages.grid(t).groupBy("field").agg(F.max("date").alias("last_date"))
    return stages.stage(t, "cal", lambda: forecast.calendar(last, 24))


def current(t):
    return stages.stage(t, "current", lambda: oilcut.current_injection(inj(t), 1))


def g_end(t):
    return stages.stage(t, "g_end", lambda: forecast.redistribution_at_end(stages.member_pairs(t), oilcut.active_producers(prod(t)), ["field", "member"]))


def state(t):
    def build():
        p = stages.predictions(t)
        x0 = p.where(F.col("step") == F.col("n_steps") - 1).select("field", "member", "producer", F.col("state").alias("x0"), F.col("t_days").alias("t_last"))
        vol = inj(t).groupBy("field", "injector").agg(F.sum(F.col("inj") * F.col("dt_days")).alias("v"))
        cwi0 = stages.member_pairs(t).join(vol, ["field", "injector"]).groupBy("field", "member", "producer").agg(F.sum(F.col("f") * F.col("v")).alias("cwi0"))
        s = x0.join(stages.member_params(t), ["field", "member", "producer"]).join(fit.producer_start(prod(t)), fit.PROD)
        s = s.join(oilcut.surface_ratio(prod(t)), fit.PROD).join(oilcut.active_producers(prod(t)), fit.PROD)
        s = s.join(wor(t), fit.PROD, "left").join(oilcut.recent_oil_cut(prod(t)).withColumnRenamed("oil_cut", "anchor"), fit.PROD, "left")
        s = s.join(cwi0, ["field", "member", "producer"], "left")
        return s.select(
            "field", "member", "producer", "x0", "tau", "gain_p", "tau_p", "q0", (F.col("t_last") - F.col("t_start")).alias("age"),
            F.coalesce("cwi0", F.lit(0.0)).alias("cwi0"), "ratio", F.lit(1.0).alias("level"), "active", "alpha", "beta", "offset", "anchor",
        )

    return stages.stage(t, "state", build)


def plans(t):
    def build():
        c = current(t)
        named = lambda d, n: d.select("field", F.lit(n).alias("plan"), "injector", "rate")
        k = F.regexp_extract("injector", "[0-9]+", 0).cast("int")
        tilt = c.withColumn("rate", F.col("rate") * (0.5 + (k % 4) / 3.0))
        return named(c, "base").unionByName(named(scenarios.equal_split(c), "equal")).unionByName(named(tilt, "tilt"))

    return stages.stage(t, "plans", build)


def sources(t):
    return stages.stage(t, "sources", lambda: forecast.plan_sources(plans(t), stages.member_pairs(t), g_end(t), ["field", "plan"], producers=state(t)))


def fc(t):
    return stages.stage(t, "forecast", lambda: forecast.simulate(forecast.dealt(sources(t)), state(t), calendar(t), ["field", "plan"]))


def months(t):
    return stages.stage(t, "months", lambda: economics.month_totals(fc(t), plans(t), ["field", "plan"]))


def totals(t):
    return stages.stage(t, "totals", lambda: forecast.forecast_totals(fc(t), ["field", "plan", "member"]))


# ------------------------------------------------------------------ forecast
@query("forecast_calendar", "select * from b_cal")
def _(t):
    return calendar(t)


@query("expand_plan", """select field, injector, h, round(rate*(1+0.1*block),6) rate from b_cur, (select unnest(range(0,5))::int block), (select unnest(range(1,25))::int h)
 where h-1>=floor(24*block/5.0) and h-1<floor(24*(block+1)/5.0)""")
def _(t):
    b = current(t).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("rate", F.col("rate") * (1 + 0.1 * F.col("block")))
    return forecast.expand_plan(b, 5, 24).select("field", "injector", "h", r("rate"))


@query("forecast_liquid", """select field, "plan", member, producer, h, round(liq,4) liq from b_fc""")
def _(t):
    return fc(t).select("field", "plan", "member", "producer", "h", r("liq", 4))


@query("forecast_oil_water", """select field, "plan", member, producer, h, round(oil,4) oil, round(water,4) water, round(cwi,2) cwi from b_fc""")
def _(t):
    return fc(t).select("field", "plan", "member", "producer", "h", r("oil", 4), r("water", 4), r("cwi", 2))


@query("forecast_liquid_monthly", """select field, "plan", member, producer, h, round(liq,4) liq from b_fc""")
def _(t):
    """The same plans given month by month, through the response filter instead of the closed form."""
    h = plans(t).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(24))))
    src = forecast.plan_sources(h, stages.member_pairs(t), g_end(t), ["field", "plan"], producers=state(t))
    return forecast.simulate(src, state(t), calendar(t), ["field", "plan"]).select("field", "plan", "member", "producer", "h", r("liq", 4))


@query("forecast_totals", """select field, "plan", member, round(cum_oil,2) cum_oil, round(cum_water,2) cum_water, round(cum_water/(cum_oil+cum_water),6) water_cut from b_tot""")
def _(t):
    return totals(t).select("field", "plan", "member", r("cum_oil", 2), r("cum_water", 2), r("water_cut"))


_Q3 = "round(quantile_cont({v},0.1),3) p10, round(quantile_cont({v},0.5),3) p50, round(quantile_cont({v},0.9),3) p90"


@query("forecast_fan", f"""select field, "plan", h, {_Q3.format(v='o')} from (select field, "plan", member, h, sum(oil) o from b_fc group by 1,2,3,4) group by 1,2,3""")
def _(t):
    return forecast.field_fan(fc(t), ["field", "plan"]).select("field", "plan", "h", r("p10", 3), r("p50", 3), r("p90", 3))


@query("forecast_fan_producer", f"""select field, "plan", producer, h, {_Q3.format(v='oil')} from b_fc group by 1,2,3,4""")
def _(t):
    return forecast.producer_fan(fc(t), ["field", "plan"]).select("field", "plan", "producer", "h", r("p10", 3), r("p50", 3), r("p90", 3))


@query("forecast_fan_cumulative", f"""select field, "plan", {_Q3.format(v='cum_oil').replace(',3)', ',2)')} from b_tot group by 1,2""")
def _(t):
    return forecast.cumulative_fan(fc(t), ["field", "plan"]).select("field", "plan", r("p10", 2), r("p50", 2), r("p90", 2))


@query("rolling_blend_params", "select field, injector, producer, member, round(0.3*p.f*1.2+0.7*m.f,6) f from b_mpair m join b_pair p using (field, injector, producer)")
def _(t):
    last = stages.pairs(t).select("field", "injector", "producer", (F.col("f") * 1.2).alias("f"))
    w = stages.n_train(t).select("field", F.lit(0.3).alias("w_last"))
    return forecast.rolling_blend_params(stages.member_pairs(t), last, w).select("field", "injector", "producer", "member", r("f"))


# ------------------------------------------------------------------ economics
_B = "6.289810770432105e0"
CTES["b_npv"] = f"""select field, "plan", member, sum((70*oil-1.5*water-0.8*inj)*dt_days*{_B}*pow(1.1,-t_cum/365.25)) npv from b_mt group by 1,2,3"""


@query("npv", """select field, "plan", member, round(npv,0) npv from b_npv""")
def _(t):
    m = economics.price_deck(months(t), [], 70.0)
    return economics.npv(m, ["field", "plan", "member"]).select("field", "plan", "member", r("npv", 0))


@query("price_deck", f"""select field, "plan", member, round(sum((case h when 1 then 60 when 2 then 65 else 72 end*oil-1.5*water-0.8*inj)*dt_days*{_B}*pow(1.1,-t_cum/365.25)),0) npv from b_mt group by 1,2,3""")
def _(t):
    m = economics.price_deck(months(t), [60.0, 65.0, 72.0], 70.0)
    return economics.npv(m, ["field", "plan", "member"]).select("field", "plan", "member", r("npv", 0))


@query("price_tornado", f"""select field, member, k price_factor, round(sum(case "plan" when 'tilt' then 1 when 'base' then -1 else 0 end*(70*k*oil-1.5*water-0.8*inj)*dt_days*{_B}*pow(1.1,-t_cum/365.25)),0) delta_npv
 from b_mt, (select unnest([0.7e0,0.85e0,1e0,1.15e0,1.3e0]) k) group by 1,2,3""")
def _(t):
    return economics.price_tornado(months(t), ["field", "member"], "tilt", "base").select("field", "member", "price_factor", r("delta_npv", 0))


CTES["b_tcase"] = """select * from (values ('base','mid',70e0,1.5e0,0.8e0,0.1e0),('oil_price','low',70*0.7e0,1.5e0,0.8e0,0.1e0),('oil_price','high',70*1.3e0,1.5e0,0.8e0,0.1e0),
 ('water_handling_cost','low',70e0,1.5e0*1.5e0,0.8e0,0.1e0),('water_handling_cost','high',70e0,1.5e0*0.5e0,0.8e0,0.1e0),('injection_cost','low',70e0,1.5e0,0.8e0*1.5e0,0.1e0),
 ('injection_cost','high',70e0,1.5e0,0.8e0*0.5e0,0.1e0),('discount_rate','low',70e0,1.5e0,0.8e0,0.15e0),('discount_rate','high',70e0,1.5e0,0.8e0,0.05e0)) v(item, side, p, w, i, d)"""
CTES["b_tv"] = f"""select field, "plan", member, item, side, sum((p*oil-w*water-i*inj)*dt_days*{_B}*pow(1+d,-t_cum/365.25)) v from b_mt, b_tcase where "plan" in ('base','tilt') group by 1,2,3,4,5"""
_RANGE = """select field, 'forecast_range' item, 'low' side, {r}(quantile_cont(g,0.1)) gain from {s} group by 1 union all select field, 'forecast_range', 'high', {r}(quantile_cont(g,0.9)) from {s} group by 1"""
CTES["b_tg"] = """select field, member, sum(case "plan" when 'tilt' then v else -v end) g from b_tv where item='base' group by 1,2"""


@query("economic_tornado", """select field, item, side, round(sum(case "plan" when 'tilt' then s else -s end),0) gain from (select field, "plan", item, side, avg(v)-0.5*stddev_pop(v) s from b_tv group by 1,2,3,4) group by 1,2,3
 union all """ + _RANGE.format(r="round", s="b_tg"))
def _(t):
    return economics.economic_tornado(months(t), "tilt", "base", "balanced").select("field", "item", "side", r("gain", 0))


CTES["b_og"] = """select field, member, sum(case "plan" when 'tilt' then cum_oil else -cum_oil end) g from b_tot where "plan" in ('base','tilt') group by 1,2"""


@query("oil_tornado", """select field, 'base' item, 'mid' side, round(sum(case "plan" when 'tilt' then s else -s end),0) gain from (select field, "plan", quantile_cont(cum_oil,0.1) s from b_tot where "plan" in ('base','tilt') group by 1,2)
 group by 1 union all """ + _RANGE.format(r="round", s="b_og"))
def _(t):
    return economics.oil_tornado(totals(t), "tilt", "base", "robust").select("field", "item", "side", r("gain", 0))


@query("objectives", """select m.field, m."plan", m.member, round(sum(oil*dt_days),2) max_cumulative_oil, round(max(npv),0) max_npv, round(-sum(inj*dt_days),2) min_water, sum(oil*dt_days)>=20000 target_met
 from b_mt m join b_npv n using (field, "plan", member) group by 1,2,3""")
def _(t):
    o = economics.objectives(months(t), ["field", "plan", "member"], F.lit(20000.0))
    return o.select("field", "plan", "member", r("max_cumulative_oil", 2), r("max_npv", 0), r("min_water", 2), "target_met")


@query("posture_value", """select field, "plan", round(avg(cum_oil),2) aggressive, round(avg(cum_oil)-0.5*stddev_pop(cum_oil),2) balanced, round(quantile_cont(cum_oil,0.1),2) robust from b_tot group by 1,2""")
def _(t):
    f = lambda p: economics.posture_stat(F.col("cum_oil"), p)
    return totals(t).groupBy("field", "plan").agg(*[rd(f(p), 2).alias(p) for p in ("aggressive", "balanced", "robust")])


@query("effective_posture", """select field, badge, case when badge='LOW' then 'robust' else 'balanced' end posture from (select field, badge from b_badge)""")
def _(t):
    from wellspan.catalog.scores import badges

    return badges(t).select("field", "badge", economics.effective_posture(F.lit(None).cast("string"), F.col("badge")).alias("posture"))


# ------------------------------------------------------------------ plans
CTES["b_bounds"] = """select field, injector, rate, idle, 0e0 lo, case when idle then 0 else 2*coalesce(ma,mall) end hi, tw total_water from b_cur join b_idle using (field, injector) join (
 select field, avg(rate) filter (not idle) ma, avg(rate) mall, sum(rate) tw from b_cur join b_idle using (field, injector) group by 1) using (field)"""


def bounds(t):
    return stages.stage(t, "plan_bounds", lambda: scenarios.plan_bounds(current(t), oilcut.idle_injectors(inj(t))))


@query("plan_bounds", "select field, injector, round(rate,6) rate, idle, lo, round(hi,6) hi, round(total_water,6) total_water from b_bounds")
def _(t):
    return bounds(t).select("field", "injector", r("rate"), "idle", "lo", r("hi"), r("total_water"))


CTES["b_facts"] = """select field, "plan", max(wc) max_water_cut, max(l) max_liquid, max(inj)*sum(dt_days)/nullif(sum(lr),0) vrr from (select field, "plan", h, dt_days, max(case when oil+water>0 then water/(oil+water) else 0 end) wc, max(oil+water) l,
 sum(liq*dt_days) lr from b_fc where member=0 group by 1,2,3,4) join (select field, "plan", sum(rate) inj from b_plan group by 1,2) using (field, "plan") group by 1,2"""


@query("plan_feasibility", """select field, "plan", abs(used-tw)<=1e-6*greatest(tw,1) water_ok, wb within_bounds, f.max_water_cut<=greatest(0.9,b.max_water_cut)+1e-6 water_cut_ok,
 f.max_liquid<=greatest(120,b.max_liquid)+1e-6 liquid_ok, f.vrr>=least(0.8,b.vrr)-1e-6 and f.vrr<=greatest(1.2,b.vrr)+1e-6 vrr_ok from (
 select p.field, p."plan", sum(p.rate) used, max(total_water) tw, bool_and(p.rate>=lo-1e-6 and p.rate<=hi+1e-6) wb from b_plan p join b_bounds bb on bb.field=p.field and bb.injector=p.injector group by 1,2)
 join b_facts f using (field, "plan") join (select * from b_facts where "plan"='base') b using (field)""")
def _(t):
    ref = fc(t).where(F.col("member") == 0)
    cut = F.when(F.col("oil") + F.col("water") > 0, F.col("water") / (F.col("oil") + F.col("water"))).otherwise(0.0)
    f = ref.groupBy("field", "plan").agg(F.max(cut).alias("max_water_cut"), F.max(F.col("oil") + F.col("water")).alias("max_liquid"), F.sum(F.col("liq") * F.col("dt_days")).alias("lr"))
    w = plans(t).groupBy("field", "plan").agg(F.sum("rate").alias("inj"))
    horizon = calendar(t).groupBy("field").agg(F.sum("dt_days").alias("days"))
    f = f.join(w, ["field", "plan"]).join(horizon, "field").withColumn("vrr", F.try_divide(F.col("inj") * F.col("days"), F.col("lr")))
    facts = f.select("field", "plan", "max_water_cut", "max_liquid", "vrr")
    out = scenarios.plan_feasibility(plans(t), bounds(t), facts, {"max_water_cut": 0.9, "max_liquid": 120.0, "vrr": (0.8, 1.2)})
    return out.drop("feasible")


CTES["b_base"] = """select field, member, producer, source, support from b_fsrc where "plan"='base'"""
CTES["b_h"] = "select field, greatest(1e-3*greatest(avg(rate),1),1e-6) hh from b_cur group by 1"


def _case(changes: str) -> str:
    src = f"""(select field, "case", sign, member, producer, source+case when sign>0 then ds else 0 end source, support+case when sign>0 then dp else 0 end support from (
 select c.field, c."case", p.member, p.producer, sum(p.f*delta*g.g) ds, sum(p.f*delta) dp from ({changes}) c join b_mpair p on p.field=c.field and p.injector=c.injector
 join b_gend g on g.field=p.field and g.member=p.member and g.injector=p.injector group by 1,2,3,4) join b_base using (field, member, producer), (select unnest([-1e0,1e0]) sign))"""
    return f"""select field, "case", member, sum(sign*oil*dt_days) d_oil from ({_SIM.format(k='field, "case", sign, member, producer', src=src)}) group by 1,2,3"""


_VALS = """select field, "case", value, base_value, value-base_value delta, 100*(value-base_value)/abs(base_value) delta_pct from (select field, "case", avg(cum_oil+d_oil)-0.5*stddev_pop(cum_oil+d_oil) value from {d}
 join (select * from b_tot where "plan"='base') using (field, member) group by 1,2) join (select field, avg(cum_oil)-0.5*stddev_pop(cum_oil) base_value from b_tot where "plan"='base' group by 1) using (field)"""
CTES["b_dmarg"] = _case('select field, injector "case", injector, hh delta from b_cur join b_h using (field)')
CTES["b_vmarg"] = _VALS.format(d="b_dmarg")
CTES["b_dshut"] = _case('select field, injector "case", injector, -rate delta from b_cur where rate>0')
CTES["b_vshut"] = _VALS.format(d="b_dshut")


def base_sources(t):
    return sources(t).where(F.col("plan") == "base")


def base_totals(t):
    return totals(t).where(F.col("plan") == "base").select("field", "member", "cum_oil")


def marginal(t):
    return stages.stage(
        t, "marginal",
        lambda: scenarios.marginal_value(current(t), stages.member_pairs(t), g_end(t), base_sources(t), state(t), calendar(t), base_totals(t), "balanced"),
    )


@query("marginal_value", """select field, "case" injector, round(delta/hh,2) marginal from b_vmarg join b_h using (field)""")
def _(t):
    return marginal(t).select("field", "injector", r("marginal", 2))


@query("scenario_base", """select field, round(avg(cum_oil)-0.5*stddev_pop(cum_oil),2) value from b_tot where "plan"='base' group by 1""")
def _(t):
    return economics.posture_value(base_totals(t), ["field"], "cum_oil", "balanced").select("field", r("value", 2))


def shut_in(t):
    ch = current(t).where(F.col("rate") > 0).select("field", F.col("injector").alias("case"), "injector", (-F.col("rate")).alias("delta"))
    d = scenarios.changed_oil(ch, current(t), stages.member_pairs(t), g_end(t), base_sources(t), state(t), calendar(t))
    return stages.stage(t, "shut_in", lambda: scenarios.case_values(d, base_totals(t), "balanced"))


@query("scenario_shut_in", """select field, "case", round(value,2) value, round(delta,2) delta from b_vshut""")
def _(t):
    return shut_in(t).select("field", "case", r("value", 2), r("delta", 2))


@query("plan_gains", """select field, "plan", round(v,2) value, round(100*(v-b)/abs(b),5) gain_vs_base_pct, round(100*(v-e)/abs(e),5) gain_vs_equal_pct from (select field, "plan", avg(cum_oil) v from b_tot group by 1,2)
 join (select field, avg(cum_oil) b from b_tot where "plan"='base' group by 1) using (field) join (select field, avg(cum_oil) e from b_tot where "plan"='equal' group by 1) using (field)""")
def _(t):
    v = economics.posture_value(totals(t), ["field", "plan"], "cum_oil", "aggressive")
    return scenarios.plan_gains(v).select("field", "plan", r("value", 2), r("gain_vs_base_pct", 5), r("gain_vs_equal_pct", 5))


@query("plan_search")
def _(t):
    best = scenarios.plan_search(
        bounds(t), current(t), marginal(t), stages.member_pairs(t), g_end(t), state(t), calendar(t), keep=cut_lineage
    )
    return best.select("field", "plan", "injector", "rate", "value")


@query("scenario_water_sweep")
def _(t):
    """Best plan at five water budgets and the slope of value against water."""
    fr = F.explode(F.array(*[F.lit(x) for x in (0.8, 0.9, 1.0, 1.1, 1.2)]))
    keyed = lambda d: d.withColumn("field", F.concat_ws("|", "field", F.col("fraction").cast("string")))
    whole = bounds(t).withColumn("fraction", fr).withColumn("total_water", F.col("total_water") * F.col("fraction"))
    b = cut_lineage(keyed(whole.withColumn("plain", F.col("field"))))
    spread = lambda d: keyed(d.withColumn("fraction", fr)).drop("fraction")
    cur = keyed(current(t).withColumn("fraction", fr)).select("field", "injector", (F.col("rate") * F.col("fraction")).alias("rate"))
    best = scenarios.plan_search(
        b.drop("plain", "fraction"), cut_lineage(cur), spread(marginal(t)), spread(stages.member_pairs(t)), spread(g_end(t)), spread(state(t)), spread(calendar(t)), keep=cut_lineage
    )
    v = best.groupBy("field").agg(F.max("value").alias("value"), F.sum("rate").alias("total_water"))
    back = b.select(F.col("field").alias("_key"), F.col("plain").alias("field"), "fraction").distinct()
    v = v.join(back, v["field"] == back["_key"]).select(back["field"], "fraction", "value", "total_water")
    return scenarios.gradient_by(v, ["field"], "total_water", "value", "marginal_water")


CTES["b_trend"] = "select field, regr_intercept(ln(f),d) a, regr_slope(ln(f),d) b, count(*) n from b_pair where f>0.02 group by 1 having count(*)>=4"
CTES["b_rowsum"] = "select field, quantile_cont(s,0.5) row_sum from (select field, injector, sum(f) s from b_pair group by 1,2) group by 1"
CTES["b_new"] = """select field, 'NEW' injector, producer, d, exp(-d/(1.5*med))/sum(exp(-d/(1.5*med))) over (partition by field)*0.8 f from (select p.field, p.entity producer, sqrt((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)) d from b_loc p
 join (select field, avg(x) cx, avg(y) cy from b_loc group by 1) c using (field) where role='P') join b_scale using (field) where d<=3.0*med"""
CTES["b_newf"] = """select field, injector, producer, d, shape/sum(shape) over (partition by field)*row_sum f from (select *, case when a is not null then sqrt(greatest(f,1e-12)*greatest(exp(a+b*d),1e-12)) else f end shape
 from b_new left join b_trend using (field)) join b_rowsum using (field)"""


@query("distance_trend", "select field, round(a,6) a, round(b,9) b, n from b_trend")
def _(t):
    return scenarios.distance_trend(stages.pairs(t)).select("field", r("a"), r("b", 9), "n")


def new_prior(t):
    def build():
        e = stages.entities(t)
        center = e.groupBy("field").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        site = center.select("field", F.lit("NEW").alias("well"), F.lit("NEW").alias("entity"), F.lit("I").alias("role"), "x", "y")
        pts = e.where(F.col("role") == "P").unionByName(site)
        prior = sectors.influence_distance_prior(pts, stages.scale(t), stages.ROW_SUM)
        return scenarios.scaled_prior(prior, scenarios.distance_trend(stages.pairs(t)), scenarios.median_row_sum(stages.pairs(t)))

    return stages.stage(t, "new_prior", build)


@query("scaled_prior", "select field, injector, producer, round(d,5) d, round(f,6) f from b_newf")
def _(t):
    return new_prior(t).select("field", "injector", "producer", r("d", 5), r("f"))


@query("infill_split", """select field, injector, producer, round(f*(1-share),6) f from b_pair join (select field, injector, 0.1+0.01*(cast(regexp_extract(injector,'[0-9]+') as int)%5) share from b_entities, (select 1) where role='I' and false
 union all select field, entity, 0.1+0.01*(cast(regexp_extract(entity,'[0-9]+') as int)%5) from b_entities where role='I') using (field, injector)
 union all select field, injector, 'INFILL', round(sum(f)*max(share),6) from b_pair join (select field, entity injector, 0.1+0.01*(cast(regexp_extract(entity,'[0-9]+') as int)%5) share from b_entities where role='I') using (field, injector) group by 1,2""".replace("select field, injector, 0.1+0.01*(cast(regexp_extract(injector,'[0-9]+') as int)%5) share from b_entities, (select 1) where role='I' and false\n union all select field, entity, 0.1", "select field, entity injector, 0.1").replace("%5) from b_entities where role='I') using (field, injector)\n union", "%5) share from b_entities where role='I') using (field, injector)\n union"))
def _(t):
    k = F.regexp_extract("entity", "[0-9]+", 0).cast("int")
    share = stages.entities(t).where(F.col("role") == "I").select(
        "field", F.col("entity").alias("injector"), F.lit("INFILL").alias("producer"), (0.1 + 0.01 * (k % 5)).alias("share")
    )
    new, old = scenarios.infill_split(stages.pairs(t).select("field", "injector", "producer", "f"), share)
    return old.unionByName(new).select("field", "injector", "producer", r("f"))


CTES["b_dnew"] = _case('select field, \'NEW\' "case", \'NEW\' injector, avg(rate) delta from b_cur group by 1').replace("b_mpair p", "(select n.*, member from b_newf n, b_m) p").replace(
    "join b_gend g on g.field=p.field and g.member=p.member and g.injector=p.injector", "join (select field, injector, least(case when sum(case when active then f else 0 end)>1e-12 then sum(f)/sum(case when active then f else 0 end) else 1 end,3.0) g from b_newf join b_active using (field, producer) group by 1,2) g on g.field=p.field")
CTES["b_vnew"] = _VALS.format(d="b_dnew")


def with_new(t):
    """Couplings and end-of-history multipliers of the new injector for every member."""
    m = F.explode(F.sequence(F.lit(0), F.lit(stages.MEMBERS - 1)))
    p = new_prior(t).withColumn("member", m)
    return p, forecast.redistribution_at_end(p, oilcut.active_producers(prod(t)), ["field", "member"])


@query("scenario_new_injector", """select field, "case", round(value,2) value, round(delta,2) delta from b_vnew""")
def _(t):
    p, g = with_new(t)
    ch = current(t).groupBy("field").agg(F.avg("rate").alias("delta")).select("field", F.lit("NEW").alias("case"), F.lit("NEW").alias("injector"), "delta")
    d = scenarios.changed_oil(ch, current(t), p, g, base_sources(t), state(t), calendar(t))
    return scenarios.case_values(d, base_totals(t), "balanced").select("field", "case", r("value", 2), r("delta", 2))


CTES["b_conv0"] = "select field, min(producer) producer from b_active where active group by 1"
CTES["b_cprior"] = """select field, 'CONV' injector, producer, d, exp(-d/(1.5*med))/sum(exp(-d/(1.5*med))) over (partition by field)*0.8 f from (select p.field, p.entity producer, sqrt((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)) d from b_loc p
 join (select l.field, l.x, l.y, l.entity from b_loc l join b_conv0 z on z.field=l.field and z.producer=l.entity) c on c.field=p.field and p.entity<>c.entity where role='P') join b_scale using (field) where d<=3.0*med"""
CTES["b_cf"] = """select field, injector, producer, d, shape/sum(shape) over (partition by field)*row_sum f from (select *, case when a is not null then sqrt(greatest(f,1e-12)*greatest(exp(a+b*d),1e-12)) else f end shape
 from b_cprior left join b_trend using (field)) join b_rowsum using (field)"""
CTES["b_dconv"] = _case('select field, \'CONV\' "case", \'CONV\' injector, avg(rate) delta from b_cur group by 1').replace("b_mpair p", "(select n.*, member from b_cf n, b_m) p").replace(
    "join b_gend g on g.field=p.field and g.member=p.member and g.injector=p.injector", "join (select field, injector, least(case when sum(case when active then f else 0 end)>1e-12 then sum(f)/sum(case when active then f else 0 end) else 1 end,3.0) g from b_cf join b_active using (field, producer) group by 1,2) g on g.field=p.field")
CTES["b_dconv2"] = """select field, 'CONV' "case", member, coalesce(d_oil,0)-lost d_oil from (select field, member, sum(oil*dt_days) lost from b_fc join b_conv0 using (field, producer) where "plan"='base' group by 1,2)
 left join b_dconv using (field, member)"""
CTES["b_vconv"] = _VALS.format(d="b_dconv2")


@query("scenario_convert", """select field, "case", round(value,2) value, round(delta,2) delta from b_vconv""")
def _(t):
    """One producer per field becomes an injector: its oil is lost, its neighbours respond through the scaled prior."""
    act = oilcut.active_producers(prod(t))
    chosen = act.where("active").groupBy("field").agg(F.min("producer").alias("producer"))
    e = stages.entities(t)
    site = e.join(chosen.withColumnRenamed("producer", "entity"), ["field", "entity"]).select(
        "field", "well", F.lit("CONV").alias("entity"), F.lit("I").alias("role"), "x", "y"
    )
    rest = e.where(F.col("role") == "P").join(chosen.withColumnRenamed("producer", "entity"), ["field", "entity"], "left_anti")
    prior = sectors.influence_distance_prior(rest.unionByName(site), stages.scale(t), stages.ROW_SUM)
    row = scenarios.scaled_prior(prior, scenarios.distance_trend(stages.pairs(t)), scenarios.median_row_sum(stages.pairs(t)))
    p = row.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(stages.MEMBERS - 1))))
    p = cut_lineage(p)
    g = forecast.redistribution_at_end(p, act, ["field", "member"])
    ch = current(t).groupBy("field").agg(F.avg("rate").alias("delta")).select("field", F.lit("CONV").alias("case"), F.lit("CONV").alias("injector"), "delta")
    gained = scenarios.changed_oil(ch, current(t), p, g, base_sources(t), state(t), calendar(t))
    lost = fc(t).where(F.col("plan") == "base").join(chosen, ["field", "producer"]).groupBy("field", "member").agg(F.sum(F.col("oil") * F.col("dt_days")).alias("lost"))
    d = lost.join(gained, ["field", "member"], "left").select(
        "field", F.lit("CONV").alias("case"), "member", (F.coalesce("d_oil", F.lit(0.0)) - F.col("lost")).alias("d_oil")
    )
    return scenarios.case_values(d, base_totals(t), "balanced").select("field", "case", r("value", 2), r("delta", 2))


@query("scenario_pattern_balance", """select field, injector, round(rate*0.9*liq/greatest(tot,1e-9),6) rate from b_cur join (select field, sum(rate) tot from b_cur group by 1) using (field)
 join (select field, sum(l) liq from (select field, producer, avg(liq) l from b_p where step>=n_steps-3 group by 1,2) group by 1) using (field)""")
def _(t):
    liq = prod(t).where(F.col("step") >= F.col("n_steps") - 3).groupBy("field", "producer").agg(F.avg("liq").alias("l")).groupBy("field").agg(F.sum("l").alias("liq"))
    return scenarios.pattern_balance(current(t), liq, 0.9).select("field", "injector", r("rate"))


@query("scenario_compare", """select field, 'shut in '||"case" scenario, round(value,2) value, round(delta,2) delta, round(delta_pct,5) delta_pct from b_vshut union all
 select field, 'base', round(avg(cum_oil)-0.5*stddev_pop(cum_oil),2), 0, 0 from b_tot where "plan"='base' group by 1""")
def _(t):
    s = shut_in(t).select("field", F.concat(F.lit("shut in "), "case").alias("scenario"), r("value", 2), r("delta", 2), r("delta_pct", 5))
    b = economics.posture_value(base_totals(t), ["field"], "cum_oil", "balanced")
    return s.unionByName(b.select("field", F.lit("base").alias("scenario"), r("value", 2), F.lit(0.0).alias("delta"), F.lit(0.0).alias("delta_pct")))
