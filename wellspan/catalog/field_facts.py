"""Queries: pressure, sectors, profile and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog.base import entities, entity_rates, located, raw_grid
from wellspan.catalog.ctes import CTES
from wellspan.catalog.registry import query
from wellspan.functions.numeric import rd
from wellspan.operators import events, gates, grid, pressure, sectors
from wellspan.session import cut_lineage

# ------------------------------------------------------------------ pressure
CTES["b_src_class"] = """select *, case when upper(coalesce(src,'')) similar to '.*(STATIC|SBHP|SURVEY|SHUT-IN|SHUTIN|PBU).*' then 'static'
 when upper(coalesce(src,'')) similar to '.*(ESP|PIP|INTAKE|PUMP).*' then 'esp' when upper(coalesce(src,'')) similar to '.*(GAUGE|DHG|PDG|DOWNHOLE|PERMANENT).*' then 'gauge'
 when upper(coalesce(src,'')) similar to '.*(WHP|THP|WELLHEAD).*' then 'whp' else 'gauge' end source from b_pressure"""
CTES["b_src"] = """select field, well, src, case when src is null then 'gauge' else source end source from (
 select field, well, max(src) filter (rk=1) src from (select field, well, src, row_number() over (partition by field, well order by case when src is null then 1 else 0 end, n desc, src) rk
 from (select field, well, src, count(*) n from b_pressure group by all)) group by 1,2) left join (select distinct src, source from b_src_class where src is not null) using (src)"""
CTES["b_pmonth"] = """select field, well, cast(date_trunc('month',date) as date) date, avg(bhp) bhp, avg(whp) whp from b_pressure group by 1,2,3"""
CTES["b_pgrid"] = """select g.field, g.well, g.entity, g.step, g.date, g.dt_days, g.n_steps, g.oil, g.water, m.bhp, m.whp, coalesce(s.source,'none') source from b_grid g
 left join b_pmonth m on m.field=g.field and m.well=g.well and m.date=g.date left join b_src s on s.field=g.field and s.well=g.well where role='P'"""
CTES["b_whp"] = """select field, well, entity, count(whp) n, avg(whp) mean_whp, stddev_pop(whp) std_whp,
 coalesce(count(whp)>3 and avg(whp)>0 and stddev_pop(whp)/avg(whp)>=0.15,false) usable from b_pgrid group by 1,2,3"""
CTES["b_esp"] = """select * exclude (m2,m1,p1,p2,seg,med,mad), case when coalesce(bhp is not null and len(seg)>=3 and mad>0 and abs(bhp-med)>5.0*mad
 and (m1 is not null or p1 is not null) and coalesce(abs(bhp-m1)>5.0*mad,true) and coalesce(abs(bhp-p1)>5.0*mad,true),false) then med else bhp end bhp_clean from (
 select *, 1.4826*list_median(list_transform(seg, lambda v: abs(v-med))) mad from (select *, list_median(seg) med from (
 select *, list_filter([m2,m1,bhp,p1,p2], lambda v: v is not null) seg from (select *, lag(bhp,2) over w m2, lag(bhp,1) over w m1, lead(bhp,1) over w p1, lead(bhp,2) over w p2
 from b_pgrid window w as (partition by field, entity order by step)))))"""
_K = "(3.280839895013123e0/0.14503773773020923e0)"
CTES["b_pcorr"] = f"""select e.*, w.usable whp_ok, case when source='esp' then bhp_clean+coalesce({_K}*(wc*0.433+(1-wc)*0.35)*(tvd-1900),0)+{_K}*0.433*(2100-tvd)
 when source='gauge' then bhp+{_K}*0.433*(2100-tvd) when source='whp' and w.usable then whp end p_datum
 from (select *, case when oil+water>0 then water/(oil+water) else 0 end wc from b_esp) e join b_whp w using (field, entity) join b_coords c on c.field=e.field and c.well=e.well"""
CTES["b_pwf"] = """select field, entity, step, dt_days, case when bool_or(raw is not null) over (partition by field) then coalesce(raw,0) else raw end pwf from (
 select *, coalesce(last_value(p_datum ignore nulls) over (partition by field, entity order by step rows unbounded preceding),
 first_value(p_datum ignore nulls) over (partition by field, entity order by step rows between unbounded preceding and unbounded following)) raw from b_pcorr)"""


def prepared(t):
    return pressure.prepare_pressure(raw_grid(t), t.pressure(), t.coords(), 2100.0)


@query("classify_source", "select field, src, source, count(*) n from b_src_class group by all")
def _(t):
    p = t.pressure().withColumn("source", pressure.classify_source(F.col("src"), F.lit(True), F.lit(True)))
    return p.groupBy("field", "src", "source").agg(F.count(F.lit(1)).alias("n"))


@query("well_pressure_source", "select field, well, src, source from b_src")
def _(t):
    return pressure.well_pressure_source(t.pressure())


@query("field_pressure_source", """select field, min_by(source, list_position(['gauge','esp','whp','static','none'], source)) pressure_source from (
 select e.field, coalesce(source,'none') source from b_entities e left join b_src using (field, well) where role='P') group by 1""")
def _(t):
    return pressure.field_pressure_source(entities(t).where(F.col("role") == "P"), pressure.well_pressure_source(t.pressure()))


@query("monthly_pressure", "select field, entity, step, round(bhp,7) bhp, round(whp,7) whp from b_pgrid")
def _(t):
    return pressure.pressure_on_grid(raw_grid(t), t.pressure()).select("field", "entity", "step", rd("bhp", 7).alias("bhp"), rd("whp", 7).alias("whp"))


@query("whp_gate", "select field, entity, n, round(mean_whp,7) mean_whp, round(std_whp,7) std_whp, usable from b_whp")
def _(t):
    w = pressure.whp_gate(pressure.pressure_on_grid(raw_grid(t), t.pressure()))
    return w.select("field", "entity", "n", rd("mean_whp", 7).alias("mean_whp"), rd("std_whp", 7).alias("std_whp"), "usable")


@query("esp_clean", "select field, entity, step, round(bhp,7) bhp, round(bhp_clean,7) bhp_clean from b_esp")
def _(t):
    e = pressure.esp_clean(pressure.pressure_on_grid(raw_grid(t), t.pressure()))
    return e.select("field", "entity", "step", rd("bhp", 7).alias("bhp"), rd("bhp_clean", 7).alias("bhp_clean"))


@query("depth_correction", "select field, entity, step, source, round(p_datum,7) p_datum from b_pcorr")
def _(t):
    return prepared(t).select("field", "entity", "step", "source", rd("p_datum", 7).alias("p_datum"))


@query("fill_pressure", "select field, entity, step, round(pwf,7) pwf from b_pwf")
def _(t):
    return prepared(t).select("field", "entity", "step", rd("pwf", 7).alias("pwf"))


@query("static_surveys", "select field, cast(date_trunc('month',date) as date) date, round(avg(bhp),9) p_static from b_src_class where source='static' group by 1,2")
def _(t):
    return pressure.static_surveys(t.pressure()).select("field", "date", rd("p_static", 9).alias("p_static"))


@query("dpdt", """select field, entity, step, round(case when step=0 then 0 else (pwf-lag(pwf) over (partition by field, entity order by step))/dt_days end,7) dpdt from b_pwf""")
def _(t):
    return pressure.dpdt(prepared(t), "pwf").select("field", "entity", "step", rd("dpdt", 7).alias("dpdt"))


# ------------------------------------------------------------------ sectors: all wells as one field, so the radius applies
CTES["b_loc"] = "select field, well, entity, role, x, y from b_entities join b_coords using (field, well)"
CTES["b_one"] = "select 'ALL' field, well, entity, role, x, y, field block from b_loc"
CTES["b_dist"] = """select i.field, i.entity injector, p.entity producer, i.block bi, p.block bp, sqrt((i.x-p.x)*(i.x-p.x)+(i.y-p.y)*(i.y-p.y)) d
 from b_one i join b_one p on i.field=p.field and i.role='I' and p.role='P'"""
CTES["b_near"] = """select field, 'I' role, injector id, min(d) d, min_by(producer, d) other from (select * from b_dist order by producer) group by 1,3
 union all select field, 'P', producer, min(d), min_by(injector, d) from (select * from b_dist order by injector) group by 1,3"""
CTES["b_cut"] = "select field, coalesce(quantile_cont(d,0.5) filter (where d>0), 0) med from b_near group by 1"
CTES["b_edges"] = "select field, injector, producer, d from b_dist join b_cut using (field) where bi=bp and d<=2.5*med"


def one_field(t):
    """Every well in one field, its region kept as the block."""
    return cut_lineage(
        located(t).select(F.lit("ALL").alias("field"), "well", "entity", "role", "x", "y", F.col("field").alias("block"))
    )


@query("block_map", """select e.field, e.entity, e.role, max(block) block from b_entities e left join b_category c on c.field=e.field and c.well=e.well group by 1,2,3""")
def _(t):
    return sectors.block_map(entities(t), t.category()).select("field", "entity", "role", "block")


@query("nearest_wells", "select field, role, id, round(d,6) d from b_near")
def _(t):
    return sectors.nearest_both(one_field(t)).select("field", "role", "id", rd("d").alias("d"))


@query("pair_distances", """select field, injector, producer, round(d,6) d from b_dist join b_cut using (field) where d<=2.5*med""")
def _(t):
    return sectors.pair_distances(one_field(t), 2.5).select("field", "injector", "producer", rd("d").alias("d"))


@query("pair_distances_by_field", """with d as (select i.field, i.entity injector, p.entity producer, sqrt((i.x-p.x)*(i.x-p.x)+(i.y-p.y)*(i.y-p.y)) d
  from b_loc i join b_loc p on i.field=p.field and i.role='I' and p.role='P'),
 n as (select field, injector id, min(d) d from d group by 1,2 union all select field, producer, min(d) from d group by 1,2),
 c as (select field, coalesce(quantile_cont(d,0.5) filter (where d>0), 0) med from n group by 1)
 select field, injector, producer, round(d,6) d from d join c using (field) where d<=2.5*med""")
def _(t):
    return sectors.pair_distances(cut_lineage(located(t)), 2.5).select("field", "injector", "producer", rd("d").alias("d"))


@query("sector_edges", "select field, injector, producer, round(d,6) d from b_edges")
def _(t):
    return sectors.sector_edges(one_field(t)).select("field", "injector", "producer", rd("d").alias("d"))


_REACH = """with recursive und as (select '0'||injector a, '1'||producer b from b_edges union all select '1'||producer, '0'||injector from b_edges),
 reach(a, b) as (select a, a from und union select reach.a, und.b from reach join und on reach.b=und.a),
 lab as (select a node, min(b) label from reach group by 1),
 num as (select node, label, dense_rank() over (order by label) k from lab)"""

@query("connected_components", _REACH + " select 'ALL' field, substr(node,2) entity, case when node like '0%' then 'I' else 'P' end role, 'S'||k sector from num /*recursive*/")
def _(t):
    return sectors.connected_components(sectors.sector_edges(one_field(t)))


@query("assign_isolated", _REACH + """, comp as (select substr(node,2) entity, case when node like '0%' then 'I' else 'P' end role, 'S'||k sector from num),
 iso as (select e.entity, e.role, n.other from b_one e join b_near n on n.id=e.entity and n.role=e.role where e.entity not in (select entity from comp)),
 withi as (select * from comp union all select i.entity, i.role, c.sector from iso i join comp c on c.entity=i.other where i.role='I')
 select 'ALL' field, * from withi union all select 'ALL', i.entity, i.role, c.sector from iso i join withi c on c.entity=i.other where i.role='P' /*recursive*/""")
def _(t):
    one = one_field(t)
    near = cut_lineage(sectors.nearest_both(one))
    comp = sectors.connected_components(sectors.sector_edges(one, near=near))
    return sectors.assign_isolated(one, comp, near)


CTES["b_ldist"] = """select i.field, i.entity injector, p.entity producer, sqrt((i.x-p.x)*(i.x-p.x)+(i.y-p.y)*(i.y-p.y)) d from b_loc i join b_loc p on i.field=p.field and i.role='I' and p.role='P'"""
CTES["b_scale"] = """select field, quantile_cont(d,0.5) med from (select field, injector id, min(d) d from b_ldist group by 1,2 union all select field, producer, min(d) from b_ldist group by 1,2) where d>0 group by 1"""
CTES["b_pair"] = """select field, injector, producer, d, 0.8*w/sum(w) over (partition by field, injector) f from (select *, exp(-d/(1.5*med)) w from b_ldist join b_scale using (field) where d<=3.0*med)"""


@query("influence_distance_prior", "select field, injector, producer, round(d,6) d, round(f,6) f from b_pair")
def _(t):
    e = cut_lineage(located(t))
    scale = sectors.influence_scale(cut_lineage(sectors.nearest_both(e)), 1.5, 3.0)
    return sectors.influence_distance_prior(e, scale, 0.8).select("field", "injector", "producer", rd("d").alias("d"), rd("f").alias("f"))


@query("distance_mask", """select field, injector, producer, round(d,6) d from b_dist join b_cut using (field)
 where d<=2.0*med or d<=(select min(d) from b_dist x where x.producer=b_dist.producer)""")
def _(t):
    return sectors.distance_mask(one_field(t), 2.0).select("field", "injector", "producer", rd("d").alias("d"))


# ------------------------------------------------------------------ profile and gates
CTES["b_split"] = """select field, cast(n_total-nb as int) n_train, cast(nb as int) n_blind, n_total from (select *, least(greatest(6, round_even(n_total*0.2,0)), greatest(0,n_total-2)) nb
 from (select field, count(*) n_total from b_axis group by 1))"""
CTES["b_cv"] = """select field, entity, coalesce(case when avg(x)>0 then stddev_pop(x)/avg(x) else 0 end,0) cv from (select *, case when days_on>0 then inj end x from b_grid where role='I') group by 1,2"""
CTES["b_support"] = """select field, sum(coalesce(liq,0)*dt_days) produced, sum(coalesce(inj,0)*dt_days) injected from b_grid join b_split using (field) where step<n_train group by 1"""
CTES["b_profile"] = """select *, points_available*1e0/n_params_producer ratio_producer, points_available*1e0/n_params_pair ratio_pair, n_steps*1e0/(n_inj+1) od from (
 select f.*, n_prod*(n_inj+3) n_params_producer, 3*n_inj*n_prod n_params_pair, cv.lo inj_cv_min, cv.mean inj_cv_mean, produced/injected support_ratio from (
 select field, max(n_steps) n_steps, count(*) filter (role='I' and step=0) n_inj, count(*) filter (role='P' and step=0) n_prod, avg(dt_days) filter (step>0) dt_days,
 count(*) filter (role='P' and days_on>0) points_available, avg(case when oil+water>0 then water/(oil+water) else 0 end) filter (role='P' and days_on>0) mean_water_cut
 from b_grid group by 1) f join (select field, min(cv) lo, avg(cv) mean from b_cv group by 1) cv using (field) join b_support using (field))"""
CTES["b_epw"] = """select field, coalesce(ne*1e0/nw,0) events_per_well from (select field, count(distinct entity) nw from b_entities group by 1)
 left join (select field, count(*) ne from b_events group by 1) using (field)"""
CTES["b_gates"] = """select p.*, e.events_per_well, n_steps>=8 g_history_min, od>6 g_od, ratio_producer>=4 g_points_per_param, ratio_pair>=2 g_pair_data, inj_cv_min>=0.15 g_inj_cv,
 (120.0/dt_days)>=3 g_tau_dt, support_ratio>1.15 or 0.8>1.15 g_influx, e.events_per_well>=4 g_event_heavy, mean_water_cut>=0.5 g_mature, n_steps>=120 g_long_history,
 true g_has_xy, false g_has_bhp from b_profile p join b_epw e using (field)"""


def profile(t):
    g = raw_grid(t)
    return gates.data_profile(g, grid.entity_coords(entities(t), t.coords()))


def gated(t):
    p = profile(t).join(events.events_per_well(t.events(), entities(t)), "field")
    p = p.withColumns({"tau_over_dt": 120.0 / F.col("dt_days"), "max_injector_sum": F.lit(0.8), "has_relperm": F.lit(False)})
    return gates.run_gates(p)


@query("blind_split", "select field, n_train, n_blind, n_total from b_split")
def _(t):
    return gates.blind_split(grid.time_axis(entity_rates(t)))


@query("injection_cv", "select field, entity, round(cv,6) cv from b_cv")
def _(t):
    return gates.injection_cv(raw_grid(t)).select("field", "entity", rd("cv").alias("cv"))


@query("n_params", "select field, n_params_producer, n_params_pair from b_profile")
def _(t):
    n = entities(t).groupBy("field").agg(F.count_if(F.col("role") == "I").alias("ni"), F.count_if(F.col("role") == "P").alias("np"))
    a, b = gates.n_params(F.col("ni"), F.col("np"), False)
    return n.select("field", a.alias("n_params_producer"), b.alias("n_params_pair"))


@query("support_ratio", "select field, round(produced,4) produced, round(injected,4) injected, round(produced/injected,6) support_ratio from b_support")
def _(t):
    s = gates.support_ratio(raw_grid(t))
    return s.select("field", rd("produced", 4).alias("produced"), rd("injected", 4).alias("injected"), rd("support_ratio").alias("support_ratio"))


@query("data_profile", """select field, n_steps, n_inj, n_prod, round(dt_days,6) dt_days, round(od,6) od, points_available, round(ratio_producer,6) ratio_producer,
 round(ratio_pair,6) ratio_pair, round(inj_cv_min,6) inj_cv_min, round(inj_cv_mean,6) inj_cv_mean, round(mean_water_cut,6) mean_water_cut, true has_xy,
 dt_days>=28 monthly_allocated, round(support_ratio,6) support_ratio from b_profile""")
def _(t):
    r6 = lambda c: rd(c).alias(c)
    return profile(t).select(
        "field", "n_steps", "n_inj", "n_prod", r6("dt_days"), r6("od"), "points_available", r6("ratio_producer"), r6("ratio_pair"),
        r6("inj_cv_min"), r6("inj_cv_mean"), r6("mean_water_cut"), "has_xy", "monthly_allocated", r6("support_ratio"),
    )


@query("flank_signature", """select field, entity, round(sum_f,6) sum_f, round(med,6) median_others, sum_f>1.15 and med>0 and sum_f>1.3*med is_flank from (
 select a.field, a.entity, a.sum_f, quantile_cont(b.sum_f,0.5) med, count(*) n from b_sumf a join b_sumf b on a.field=b.field and a.entity<>b.entity group by 1,2,3) where n>=2""".replace("b_sumf", """(
 select field, entity, sum(liq)/1000.0 sum_f from b_grid where role='P' group by 1,2)"""))
def _(t):
    s = raw_grid(t).where(F.col("role") == "P").groupBy("field", "entity").agg((F.sum("liq") / 1000.0).alias("sum_f"))
    out = gates.flank_signature(s)
    return out.select("field", "entity", rd("sum_f").alias("sum_f"), rd("median_others").alias("median_others"), "is_flank")


@query("run_gates", """select field, substr(gate,3) gate, passed from (unpivot (select field, g_history_min, g_od, g_points_per_param, g_pair_data, g_inj_cv, g_tau_dt, g_influx, g_event_heavy,
 g_mature, g_long_history, g_has_xy, g_has_bhp from b_gates) on columns(* exclude field) into name gate value passed)""")
def _(t):
    return gates.gates_long(gated(t))


_ELIG = """select field, variant, eligible, case when eligible then round(suit,6) else 0e0 end suitability, variant in ('crmt','crmp','aquifer') available from (
 select field, 'mpi' variant, g_has_xy eligible, 0.45e0 suit from b_gates union all
 select field, 'mlr', od>=3, 0.35e0+case when od>6 then 0.15e0 else 0 end from b_gates union all
 select field, 'crmt', g_history_min, 0.55e0+case when g_inj_cv then 0 else 0.1e0 end+case when od<6 then 0.15e0 else 0 end from b_gates union all
 select field, 'crmp', ratio_producer>=1, least(1e0, 0.6e0+case when od>6 then 0.15e0 else -0.15e0 end+case when ratio_producer>=4 then 0.1e0 else 0 end+case when g_inj_cv then 0.05e0 else -0.1e0 end
  -case when g_influx then 0.1e0 else 0 end-case when g_event_heavy then 0.1e0 else 0 end) from b_gates union all
 select field, 'crmip', ratio_pair>=2, least(1e0,0.45e0+case when ratio_pair>=4 then 0.2e0 else 0 end+case when g_inj_cv then 0.1e0 else -0.15e0 end) from b_gates union all
 select field, 'aquifer', g_influx and ratio_producer>=2, 0.8e0 from b_gates union all
 select field, 'twophase', false, 0e0 from b_gates union all select field, 'crossflow', g_event_heavy and g_has_bhp, 0.72e0 from b_gates union all
 select field, 'pinn', g_long_history and od>=6, 0.5e0+case when g_event_heavy then 0.15e0 else 0 end from b_gates union all select field, 'rnn', false, 0e0 from b_gates)"""


CTES["b_elig"] = _ELIG


@query("eligibility", "select * from b_elig")
def _(t):
    return gates.eligibility(gated(t)).drop("reason")
