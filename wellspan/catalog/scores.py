"""Queries: oil cut, verification, ranking, spread, rolling windows and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog import stages
from wellspan.catalog.ctes import CTES
from wellspan.catalog.registry import query
from wellspan.functions.numeric import rd
from wellspan.operators import fit, oilcut, rolling, verify
from wellspan.session import cut_lineage


def r(col, n=6):
    return rd(col, n).alias(col)


def prod(t):
    return fit.producer_rows(stages.grid(t))


def inj(t):
    return fit.injector_rows(stages.grid(t))


# ------------------------------------------------------------------ oil cut
CTES["b_p"] = """select field, entity producer, step, date, t_days, dt_days, n_steps, days_on>0 live, liq, oil, water from b_grid where role='P'"""
CTES["b_alloc"] = """select p.*, coalesce(s.support,0) support, sum(coalesce(s.support,0)*dt_days) over (partition by p.field, p.producer order by p.step) cwi from b_p p left join (
 select x.field, x.producer, i.step, sum(x.f*i.inj) support from b_pair x join b_grid i on i.field=x.field and i.entity=x.injector group by 1,2,3) s
 on s.field=p.field and s.producer=p.producer and s.step=p.step"""
CTES["b_fitmask"] = """select *, live and row_number() over (partition by field, producer, live order by step desc)<=24 in_fit from b_alloc"""
CTES["b_worbase"] = """select field, producer, count(*) filter (ok) n_ok, avg(fo) mean_fo, max(cwi) filter (ok) cmax from b_worrow group by 1,2"""
CTES["b_worrow"] = """select *, coalesce(fo>1e-4 and fo<1-1e-4 and cwi>=0,false) ok, case when fo>1e-4 and fo<1-1e-4 then ln(1/fo-1) end y from (
 select field, producer, step, cwi, case when oil+water>0 then oil/(oil+water) end fo from b_fitmask where in_fit)"""


def _off(src):
    return f"""select *, my-beta*mx ln_alpha, round(n*greatest(vy+beta*beta*vx-2*beta*cxy,0),9) sse, n*vy sst from (select *, least(greatest(case when vx>0 then cxy/vx else 0 end,0),50) beta from (
 select field, producer, c0, count(x) n, avg(x) mx, avg(y) my, var_pop(x) vx, var_pop(y) vy, covar_pop(x,y) cxy from (
 select w.field, w.producer, c0, y, case when c0+cwi>0 then ln(c0+cwi) end x from b_worrow w join {src} o on o.field=w.field and o.producer=w.producer where ok) group by 1,2,3 having count(x)=count(*)))"""


CTES["b_wg1"] = """select field, producer, 0e0 c0 from b_worbase where n_ok>=3 union all select field, producer, exp(ln(cm*1e-3)+ln(50000e0)/23*k) from (
 select *, case when cmax>0 then cmax else 1 end cm from b_worbase where n_ok>=3), (select unnest(range(0,24)) k)"""
CTES["b_wf1"] = _off("b_wg1") + " qualify row_number() over (partition by field, producer order by sse, c0)=1"
CTES["b_wg2"] = "select field, producer, exp(ln(c0/3)+ln(9e0)/23*k) c0 from b_wf1, (select unnest(range(0,24)) k) where c0>0"
CTES["b_wf2"] = "select * from (select * from b_wf1 union all " + _off("b_wg2") + ") qualify row_number() over (partition by field, producer order by sse, c0)=1"
CTES["b_wor"] = """select b.field, b.producer, case when n_ok<3 then 1/m-1 else exp(least(ln_alpha,700)) end alpha, case when n_ok<3 then 0 else beta end beta,
 case when n_ok<3 then 0 else c0 end "offset", case when n_ok<3 then 0 else 1-sse/case when sst>0 then sst else 1 end end r2_log, ln_alpha from (
 select *, least(greatest(coalesce(mean_fo,0.5),1e-3),1-1e-3) m from b_worbase) b left join b_wf2 f on f.field=b.field and f.producer=b.producer"""


def alloc(t):
    def build():
        s = fit.allocated_source(stages.pairs(t), inj(t), ["field"])
        return oilcut.fit_window_mask(oilcut.allocated_water(s, prod(t)), 24)

    return stages.stage(t, "alloc", build)


def wor(t):
    return stages.stage(t, "wor", lambda: oilcut.fit_wor_power(alloc(t), keep=cut_lineage))


@query("allocated_water", "select field, producer, step, round(support,5) support, round(cwi,3) cwi from b_alloc")
def _(t):
    return alloc(t).select("field", "producer", "step", r("support", 5), r("cwi", 3))


@query("fit_window_mask", "select field, producer, step, in_fit from b_fitmask")
def _(t):
    return alloc(t).select("field", "producer", "step", "in_fit")


@query("fit_wor_power", """select field, producer, round(case when alpha>0 then ln(alpha) end,3) ln_alpha, round(beta,4) beta, round("offset",1) "offset", round(r2_log,5) r2_log from b_wor""")
def _(t):
    return wor(t).select("field", "producer", rd(F.log("alpha"), 3).alias("ln_alpha"), r("beta", 4), r("offset", 1), r("r2_log", 5))


@query("eval_wor_power", """select field, producer, step, round(b_fo(alpha,beta,"offset",cwi),5) oil_cut from b_alloc join b_wor using (field, producer)""")
def _(t):
    a = alloc(t).join(wor(t), fit.PROD)
    fo = oilcut.eval_wor_power(F.col("alpha"), F.col("beta"), F.col("offset"), F.col("cwi"))
    return a.select("field", "producer", "step", rd(fo, 5).alias("oil_cut"))


CTES["b_ratio"] = """select field, producer, coalesce(quantile_cont(case when live and liq>0 then (oil+water)/liq end,0.5),1) ratio from b_p group by 1,2"""


@query("surface_ratio", "select field, producer, round(ratio,6) ratio from b_ratio")
def _(t):
    return oilcut.surface_ratio(prod(t)).select("field", "producer", r("ratio"))


@query("oil_prediction", """select field, member, producer, step, round(pred*ratio*b_fo(alpha,beta,"offset",cwi),4) oil from b_pred join b_ratio using (field, producer)
 join b_wor using (field, producer) join (select field, producer, step, cwi from b_alloc) using (field, producer, step)""")
def _(t):
    p = stages.predictions(t).join(oilcut.surface_ratio(prod(t)), fit.PROD).join(wor(t), fit.PROD)
    p = p.join(alloc(t).select(*fit.PROD, "step", "cwi"), [*fit.PROD, "step"])
    fo = oilcut.eval_wor_power(F.col("alpha"), F.col("beta"), F.col("offset"), F.col("cwi"))
    return p.select("field", "member", "producer", "step", rd(oilcut.oil_prediction(F.col("pred"), F.col("ratio"), fo), 4).alias("oil"))


@query("koval_cut", """select field, producer, step, round(case when td<1/4.0 then 0 when td>4.0 then 1 else least(greatest((4.0-sqrt(4.0/td))/3.0,0),1) end,6) water_cut from (
 select *, cwi/50000.0 td from b_alloc)""")
def _(t):
    return alloc(t).select("field", "producer", "step", rd(oilcut.koval_water_cut(F.col("cwi"), F.lit(4.0), F.lit(50000.0))).alias("water_cut"))


_K = ",".join(map(str, oilcut.KOVAL_K))
_V = ",".join(map(str, oilcut.KOVAL_V))


@query("fit_koval_grid", f"""select field, producer, k, round(v*vmax,3) v_pd, round(sse,6) sse from (
 select field, producer, k, v, vmax, round(sum(pow(case when td<1/k then 0 when td>k then 1 else least(greatest((k-sqrt(k/td))/(k-1),0),1) end - cut,2)),9) sse from (
 select *, cum/(v*vmax) td from (select *, max(cum) over (partition by field, producer) vmax, count(*) over (partition by field, producer) n from (
 select field, producer, cwi cum, least(greatest(case when oil+water>0 then water/(oil+water) else 0 end,0),1) cut from b_fitmask where in_fit and cwi>0)),
 (select unnest([{_K}])::double k), (select unnest([{_V}])::double v) where n>=3) group by all) qualify row_number() over (partition by field, producer order by sse, k, v)=1
 union all select field, producer, 2.0, round(max(cwi),3), null from b_fitmask where in_fit and cwi>0 group by 1,2 having count(*)<3""")
def _(t):
    rows = alloc(t).select("field", "producer", F.col("cwi").alias("cum"), F.when(F.col("oil") + F.col("water") > 0, F.col("water") / (F.col("oil") + F.col("water"))).otherwise(0.0).alias("cut"), "in_fit")
    return oilcut.fit_koval_grid(rows).select("field", "producer", "k", r("v_pd", 3), r("sse"))


@query("recent_oil_cut", """select field, producer, round(case when sum(oil+water)>0 then sum(oil)/sum(oil+water) end,6) oil_cut from (
 select *, row_number() over (partition by field, producer order by step desc) k from b_p where live) where k<=3 group by 1,2""")
def _(t):
    return oilcut.recent_oil_cut(prod(t)).select("field", "producer", r("oil_cut"))


@query("recent_level_ratio", """select field, member, producer, round(case when count(*)>=2 and avg(pred)>0 and avg(liq)>0 then least(greatest(avg(liq)/avg(pred),0.5),2) else 1 end,5) level from (
 select *, row_number() over (partition by field, member, producer order by step desc) k from b_pred where "on") where k<=3 group by 1,2,3""")
def _(t):
    return oilcut.recent_level_ratio(stages.predictions(t), keys=["field", "member", "producer"]).select("field", "member", "producer", r("level", 5))


@query("active_producers", "select field, producer, coalesce(bool_or(live) filter (step>=n_steps-3),false) active from b_p group by 1,2")
def _(t):
    return oilcut.active_producers(prod(t))


CTES["b_idle"] = """select field, entity injector, not coalesce(bool_or(days_on>0 and inj>0) filter (step>=n_steps-3),false) idle from b_grid where role='I' group by 1,2"""


@query("idle_injectors", "select * from b_idle")
def _(t):
    return oilcut.idle_injectors(inj(t))


@query("current_injection", "select field, entity injector, round(avg(inj),6) rate from b_grid where role='I' and step>=n_steps-3 group by 1,2")
def _(t):
    return oilcut.current_injection(inj(t), 3).select("field", "injector", r("rate"))


@query("injector_efficiency", """select field, injector, round(sum(f*fo),6) efficiency, round(sum(f*fo)*max(rate),5) oil_supported from b_pair join (
 select field, producer, case when sum(oil+water)>0 then sum(oil)/sum(oil+water) else 0 end fo from b_p where step>=n_steps-3 group by 1,2) using (field, producer)
 join (select field, entity injector, avg(inj) rate from b_grid where role='I' and step>=n_steps-3 group by 1,2) using (field, injector) group by 1,2""")
def _(t):
    return oilcut.injector_efficiency(stages.pairs(t), prod(t), inj(t)).select("field", "injector", r("efficiency"), r("oil_supported", 5))


# ------------------------------------------------------------------ verification
_R2 = lambda m: f"case when count(*) filter ({m})>=2 and var_pop(liq) filter ({m})>0 then 1-sum((liq-pred)*(liq-pred)) filter ({m})/(var_pop(liq) filter ({m})*count(*) filter ({m})) end"
_MAPE = lambda m: f"avg(abs(pred-liq)/liq) filter ({m} and liq>0)*100"
CTES["b_vr"] = f"""select field, member, producer, {_R2('tr')} train_r2, {_R2('bl')} blind_r2, {_MAPE('tr')} train_mape, {_MAPE('bl')} blind_mape, count(*) filter (tr) n_train_points,
 count(*) filter (bl) n_blind_points, sum((pred-liq)*(pred-liq)) filter (tr) sse_train from (select p.*, "on" and step<n_train tr, "on" and step>=n_train bl from b_pred p join b_split using (field))
 group by grouping sets ((field, member, producer),(field, member))"""
CTES["b_med2"] = """select field, member, quantile_cont(blind_r2,0.5) blind_r2_median, quantile_cont(blind_mape,0.5) blind_mape_median from b_vr where producer is not null group by 1,2"""
CTES["b_plaus"] = """select field, member, not (bool_or(f<-1e-9 or f>1+1e-9)) and not (select bool_or(s>1+1e-6) from (select sum(f) s from b_mpair m2 where m2.field=m.field and m2.member=m.member group by injector))
 and not (select bool_or("on" and pred<0) from b_pred p where p.field=m.field and p.member=m.member) plausible from b_mpair m group by 1,2"""
CTES["b_tb"] = "select field, lo, least(3650e0, 60*m) hi from (select field, min(dt_days) filter (step>0) lo, avg(dt_days) filter (step>0) m from b_axis group by 1)"
CTES["b_entries"] = """select v.field, v.member model, v.blind_r2, md.blind_mape_median blind_mape, case when n_train_points>0 and sse_train>0 and n_train_points-k-1>0
 then n_train_points*ln(sse_train/n_train_points)+2*k+2*k*(k+1)*1e0/(n_train_points-k-1) else 1e12 end aicc, 0.05e0+0.03e0*v.member spread, 1e0+v.member runtime_s, plausible, k n_params
 from (select *, 10+member k from b_vr where producer is null) v join b_med2 md using (field, member) join b_plaus pl using (field, member)"""
CTES["b_score"] = """select *, 0.35*c_blind_r2+0.15*c_mape+0.20*c_aicc+0.15*c_stability+0.10*c_plausibility+0.05*c_runtime score from (
 select *, least(greatest(coalesce(blind_r2,-1),0),1) c_blind_r2, least(greatest(1-coalesce(blind_mape,100)/50,0),1) c_mape,
 case when max(aicc) over w-min(aicc) over w<1e-12 then 1 else 1-(aicc-min(aicc) over w)/(max(aicc) over w-min(aicc) over w) end c_aicc,
 least(greatest(1-spread/0.5,0),1) c_stability, case when plausible then 1.0 else 0.0 end c_plausibility,
 1-(ln(1+runtime_s)-min(ln(1+runtime_s)) over w)/(max(ln(1+runtime_s)) over w-min(ln(1+runtime_s)) over w) c_runtime
 from b_entries window w as (partition by field))"""
CTES["b_rank"] = "select *, row_number() over (partition by field order by score desc, n_params, model) rank from b_score"
CTES["b_ens"] = """select field, model, case when n>1 then greatest(score,1e-9)/sum(greatest(score,1e-9)) over (partition by field) else 1 end weight from (
 select *, count(*) filter (inn) over (partition by field) n from (select *, rank<=3 and max(score) over (partition by field)-score<=0.03 and plausible inn from b_rank))
 where (n>1 and inn) or (n<=1 and rank=1)"""
CTES["b_badge"] = """select field, blind_r2, spread, plausible, nw n_warnings, case when blind_r2>=0.85 and spread<0.15 and nw<=0 and plausible then 'HIGH'
 when (blind_r2>=0.70 and nw<=1 and plausible) or (blind_r2>=0.85 and nw<=1) then 'MEDIUM' else 'LOW' end badge from (
 select field, 1-blind_mape/200 blind_r2, spread, plausible, model%2 nw from b_entries)"""


def report(t):
    return stages.stage(t, "report", lambda: verify.verify_report(stages.predictions(t), stages.n_train(t)))


def entries(t):
    def build():
        rep = report(t)
        pooled = rep.where(F.col("producer").isNull()).withColumn("k", 10 + F.col("member"))
        bounds = fit.tau_bounds(stages.grid(t).where(F.col("step") >= 0), ["field"])
        pl = verify.plausibility(stages.member_pairs(t), stages.predictions(t), stages.member_params(t), bounds)
        med = verify.median_metrics(rep)
        ic = verify.aicc(F.col("n_train_points"), F.col("k"), F.col("sse_train"))
        e = pooled.join(med, ["field", "member"]).join(pl, ["field", "member"])
        return e.select(
            "field", F.col("member").alias("model"), "blind_r2", F.col("blind_mape_median").alias("blind_mape"), ic.alias("aicc"),
            (0.05 + 0.03 * F.col("member")).alias("spread"), (1.0 + F.col("member")).alias("runtime_s"), "plausible", F.col("k").alias("n_params"),
        )

    return stages.stage(t, "entries", build)


_VR = "field, member, {p}, round(train_r2,4) train_r2, round(blind_r2,4) blind_r2, round(train_mape,3) train_mape, round(blind_mape,3) blind_mape, n_train_points, n_blind_points"
_PER = "producer is not null"


@query("verify_report", f"select {_VR.format(p='producer')}, round(sse_train,1) sse_train from b_vr")
def _(t):
    return report(t).select(
        "field", "member", "producer", r("train_r2", 4), r("blind_r2", 4), r("train_mape", 3), r("blind_mape", 3), "n_train_points", "n_blind_points", r("sse_train", 1)
    )


@query("r2", f"select field, member, producer, round(train_r2,4) r2 from b_vr where {_PER}")
def _(t):
    p = stages.predictions(t).join(stages.n_train(t), "field")
    mask = F.col("on") & (F.col("step") < F.col("n_train"))
    return p.groupBy("field", "member", "producer").agg(rd(verify.r2_of(F.col("liq"), F.col("pred"), mask), 4).alias("r2"))


@query("mape", f"select field, member, producer, round(blind_mape,3) mape from b_vr where {_PER}")
def _(t):
    p = stages.predictions(t).join(stages.n_train(t), "field")
    mask = F.col("on") & (F.col("step") >= F.col("n_train"))
    return p.groupBy("field", "member", "producer").agg(rd(verify.mape_of(F.col("liq"), F.col("pred"), mask), 3).alias("mape"))


CTES["b_rho"] = """select field, member, producer, case when count(*)>=4 and sum(e*e)>0 then sum(e*l)/sum(e*e) else 0 end rho1 from (
 select *, lag(e) over (partition by field, member, producer order by step) l from (select p.field, p.member, p.producer, p.step, liq-pred-avg(liq-pred) over (partition by p.field, p.member, p.producer) e
 from b_pred p join b_split using (field) where "on" and step<n_train)) group by 1,2,3"""


def rho(t):
    p = stages.predictions(t).join(stages.n_train(t), "field").where(F.col("on") & (F.col("step") < F.col("n_train")))
    return verify.lag1_autocorr(p.withColumn("resid", F.col("liq") - F.col("pred")), ["field", "member", "producer"], "resid")


@query("lag1_autocorr", "select field, member, producer, round(rho1,5) rho1 from b_rho")
def _(t):
    return rho(t).select("field", "member", "producer", r("rho1", 5))


@query("aicc", "select field, model, round(aicc,3) aicc from b_entries")
def _(t):
    return entries(t).select("field", "model", r("aicc", 3))


@query("median_metrics", "select field, member, round(blind_r2_median,4) blind_r2_median, round(blind_mape_median,3) blind_mape_median from b_med2")
def _(t):
    return verify.median_metrics(report(t)).select("field", "member", r("blind_r2_median", 4), r("blind_mape_median", 3))


@query("plausibility", """select field, member, plausible, (select count(*) from b_mprod p join b_tb b using (field) where p.field=b_plaus.field and p.member=b_plaus.member and (tau<=lo*1.001 or tau>=hi*0.999)) n_at_bound from b_plaus""")
def _(t):
    bounds = fit.tau_bounds(stages.grid(t), ["field"])
    return verify.plausibility(stages.member_pairs(t), stages.predictions(t), stages.member_params(t), bounds).drop("notes")


@query("fit_flags", """select field, member, producer, 'RESIDUAL_AUTOCORRELATED' code from b_rho where rho1>0.5 union all
 select field, member, producer, 'BLIND_FIT_POOR' from b_vr where producer is not null and blind_mape>15 and blind_r2<0.5""")
def _(t):
    return verify.fit_flags(report(t), rho(t))


_C = ["blind_r2", "mape", "aicc", "stability", "plausibility", "runtime"]


@query("score_models", "select field, model, " + ", ".join(f"round(c_{c},4)::double c_{c}" for c in _C) + ", round(score,4) score from b_score")
def _(t):
    return verify.score_models(entries(t)).select("field", "model", *[r(f"c_{c}", 4) for c in _C], r("score", 4))


@query("leaderboard", """select field, cast(model as varchar) model, cast(rank as int) rank, round(score,4) score, cast(null as varchar) excluded from b_rank union all select field, variant, null, null, 'excluded' from b_elig where not (eligible and available)""")
def _(t):
    from wellspan.catalog.field_facts import gated
    from wellspan.operators import gates

    scored = verify.score_models(entries(t)).withColumn("model", F.col("model").cast("string"))
    out = gates.eligibility(gated(t)).where(~(F.col("eligible") & F.col("available")))
    out = out.select("field", F.col("variant").alias("model"), F.lit("excluded").alias("excluded"))
    return verify.leaderboard(scored, out).select("field", "model", "rank", r("score", 4), "excluded")


@query("ensemble_weights", "select field, model, round(weight,5) weight from b_ens")
def _(t):
    return verify.ensemble_weights(verify.leaderboard(verify.score_models(entries(t)))).select("field", "model", r("weight", 5))


@query("ensemble_prediction", """select field, producer, step, round(sum(weight*pred),4) pred from b_pred p join b_ens e using (field) where p.member=e.model group by 1,2,3""")
def _(t):
    w = verify.ensemble_weights(verify.leaderboard(verify.score_models(entries(t))))
    return verify.ensemble_prediction(stages.predictions(t), w).select("field", "producer", "step", r("pred", 4))


def badges(t):
    e = entries(t).withColumns({"blind_r2": 1 - F.col("blind_mape") / 200, "n_warnings": F.col("model") % 2})
    return verify.confidence_badge(e.select("field", "model", "blind_r2", "spread", "plausible", "n_warnings"))


@query("confidence_badge", "select field, round(spread,2) spread, n_warnings, plausible, badge from b_badge")
def _(t):
    return badges(t).select("field", r("spread", 2), "n_warnings", "plausible", "badge")


@query("run_confidence", """select field, case when bool_or(badge='LOW') then 'LOW' when bool_or(badge='MEDIUM') then 'MEDIUM' else 'HIGH' end confidence from b_badge where spread>=0.105 group by 1""")
def _(t):
    b = badges(t).withColumn("window_id", F.when(F.col("model") >= 2, 1).otherwise(0))
    return verify.run_confidence(b, ["field"])


# ------------------------------------------------------------------ spread
CTES["b_ps"] = """select field, injector, producer, avg(f) f_mean, stddev_pop(f) f_std, quantile_cont(f,0.1) f_p10, quantile_cont(f,0.5) f_p50, quantile_cont(f,0.9) f_p90 from b_mpair group by 1,2,3"""


@query("pair_spread", "select field, injector, producer, round(f_mean,6) f_mean, round(f_std,6) f_std, round(f_p10,6) f_p10, round(f_p50,6) f_p50, round(f_p90,6) f_p90 from b_ps")
def _(t):
    return verify.pair_spread(stages.member_pairs(t)).select("field", "injector", "producer", *[r(c) for c in ("f_mean", "f_std", "f_p10", "f_p50", "f_p90")])


@query("parameter_spread", """select field, round(f.spread,6) f_spread, round(t.spread,6) tau_spread, 5::bigint n_members from (select field, (sum(f_std*f_mean)/sum(f_mean))/greatest(sum(f_mean*f_mean)/sum(f_mean),1e-9) spread from b_ps group by 1) f
 join (select field, avg(s/m) spread from (select field, producer, stddev_pop(tau) s, avg(tau) m from b_mprod group by 1,2) group by 1) t using (field)""")
def _(t):
    return verify.parameter_spread(stages.member_pairs(t), stages.member_params(t)).select("field", r("f_spread"), r("tau_spread"), "n_members")


@query("prediction_band", """select field, producer, step, round(quantile_cont(pred,0.1),4) p10, round(quantile_cont(pred,0.5),4) p50, round(quantile_cont(pred,0.9),4) p90 from b_pred group by 1,2,3""")
def _(t):
    return verify.prediction_band(stages.predictions(t)).select("field", "producer", "step", r("p10", 4), r("p50", 4), r("p90", 4))


@query("pair_confidence", "select field, injector, producer, round(case when f_mean<=1e-3 then 1 else least(greatest(1-f_std/f_mean,0),1) end,6) confidence from b_ps")
def _(t):
    return verify.pair_confidence(stages.member_pairs(t)).select("field", "injector", "producer", r("confidence"))


# ------------------------------------------------------------------ rolling and shifts
CTES["b_seg2"] = """select field, a, lead(a) over (partition by field order by a) b from (select field, 0 a from b_split union select field, cast(n_total as int) from b_split union
 select field, step from b_breaks)"""
CTES["b_roll"] = """select field, cast(row_number() over (partition by field order by s)-1 as int) window_id, s step_from, least(s+36,b) step_to from (
 select field, a, b, a+6*k s from b_seg2, (select unnest(range(0,500))::int k) where b is not null and a+6*k+24<=b) where s=a or s-6+36<b"""
CTES["b_fser"] = """select p.field, p.injector, p.producer, r.window_id, r.step_from, f*avg(g.inj)/max(m.mi) f from b_pair p join b_roll r using (field)
 join b_grid g on g.field=p.field and g.entity=p.injector and g.step>=r.step_from and g.step<r.step_to
 join (select field, entity, avg(inj) mi from b_grid where role='I' group by 1,2 having avg(inj)>0) m on m.field=p.field and m.entity=p.injector group by p.field, p.injector, p.producer, r.window_id, r.step_from, f"""


def bounds(t):
    from wellspan.catalog.tables import dates
    from wellspan.operators import events

    def build():
        br = events.break_points(t.events(), dates(t))
        n = stages.grid(t).groupBy("field").agg(F.max("n_steps").alias("n_steps"))
        return rolling.rolling_bounds(n, br)

    return stages.stage(t, "bounds", build)


def f_series(t):
    def build():
        mean = F.avg("inj")
        i = inj(t).select("field", "injector", "step", "n_steps", "inj")
        per = rolling.rows_in_windows(i, bounds(t)).groupBy("field", "injector", "window_id").agg(mean.alias("wi"))
        overall = i.groupBy("field", "injector").agg(mean.alias("mi")).where(F.col("mi") > 0)
        s = stages.pairs(t).join(per, ["field", "injector"]).join(overall, ["field", "injector"])
        return s.select("field", "injector", "producer", "window_id", (F.col("f") * F.col("wi") / F.col("mi")).alias("f"))

    return stages.stage(t, "f_series", build)


@query("rolling_bounds", "select * from b_roll")
def _(t):
    return bounds(t)


@query("rows_in_windows", """select g.field, g.entity injector, r.window_id, count(*) n, round(sum(inj),4) inj from b_grid g join b_roll r on r.field=g.field and g.step>=r.step_from and g.step<r.step_to
 where role='I' group by 1,2,3""")
def _(t):
    w = rolling.rows_in_windows(inj(t), bounds(t))
    return w.groupBy("field", "injector", "window_id").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("inj"), 4).alias("inj"))


@query("fit_rolling")
def _(t):
    from wellspan.operators.gates import n_blind

    b = bounds(t)
    keys = ["field", "window_id"]
    p = rolling.rows_in_windows(stages.response(t), b)
    i = rolling.rows_in_windows(inj(t).select("field", "injector", "step", "n_steps", "inj"), b)
    m = stages.pairs(t).select("field", "injector", "producer").join(b.select(*keys), "field")
    n = (F.col("step_to") - F.col("step_from")).cast("int")
    nt = b.select(*keys, (n - n_blind(n)).alias("n_train"))
    f = fit.fit_producer_grid(p, i, m, nt, keys, keep=cut_lineage)
    return f.select(*keys, "producer", "tau", F.size("injectors").alias("n_injectors"), "sse")


@query("window_blend", """select field, injector, producer, round(wl,6) w_last, round(wl*f*1.1+(1-wl)*f,6) f from b_pair join (
 select field, case when greatest(coalesce(a.blind_r2,0),0)+greatest(coalesce(b.blind_r2,0),0)>0 then greatest(coalesce(a.blind_r2,0),0)/(greatest(coalesce(a.blind_r2,0),0)+greatest(coalesce(b.blind_r2,0),0)) else 0.5 end wl from
 (select * from b_vr where producer is null and member=4) a join (select * from b_vr where producer is null and member=2) b using (field)) using (field)""")
def _(t):
    pooled = report(t).where(F.col("producer").isNull())
    sc = pooled.where(F.col("member") == 4).select("field", F.col("blind_r2").alias("last_r2")).join(
        pooled.where(F.col("member") == 2).select("field", F.col("blind_r2").alias("full_r2")), "field"
    )
    full = stages.pairs(t).select("field", "injector", "producer", "f")
    last = full.withColumn("f", F.col("f") * 1.1)
    return rolling.window_blend(last, full, sc).select("field", "injector", "producer", r("w_last"), r("f"))


CTES["b_cus"] = """select *, pa-min(pa) over o up, pd-min(pd) over o down from (select *, sum(a) over o pa, sum(d) over o pd from (
 select *, case when rn=1 then 0 else x-0.5 end a, case when rn=1 then 0 else -x-0.5 end d from (select *, (f/ref-f0/ref)/0.1 x, f/ref v from (
 select *, greatest(f0,0.02) ref from (select *, first_value(f) over o f0, row_number() over o rn, count(*) over (partition by field, injector, producer) n from b_fser
 window o as (partition by field, injector, producer order by window_id)))) where n>=3) window o as (partition by field, injector, producer order by window_id))
 window o as (partition by field, injector, producer order by window_id)"""


@query("cusum", "select field, injector, producer, window_id, round(up,4) up, round(down,4) down from b_cus")
def _(t):
    keys = ["field", "injector", "producer"]
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    s = f_series(t).withColumn("n", n).where(F.col("n") >= 3).withColumn("v", F.col("f") / F.greatest(F.first("f").over(w), F.lit(0.02)))
    return rolling.cusum(s, keys, "v", "window_id", F.lit(0.1)).select(*keys, "window_id", r("up", 4), r("down", 4))


@query("detect_shifts", """select field, injector, producer, case when u=2 and mag>=0.25 then 'strengthened' else 'weakened' end direction,
 case when u=2 and mag>=0.25 then us else ds end since, round(mag,4) magnitude from (
 select field, injector, producer, max(f) vmax, avg(case when f>0.02 then 1.0 else 0.0 end) con, max(v) filter (back=1)-1 mag, count(*) filter (back<=2 and up>2) u, count(*) filter (back<=2 and down>2) d,
 min(mid) filter (up>2) us, min(mid) filter (down>2) ds from (select c.*, date '1995-01-01'+c.window_id*30 mid, row_number() over (partition by field, injector, producer order by window_id desc) back from b_cus c) group by 1,2,3)
 where vmax>=0.05 and con>=0.5 and ((u=2 and mag>=0.25) or (d=2 and mag<=-0.25))""")
def _(t):
    s = f_series(t).withColumn("mid_date", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("window_id") * 30).cast("int")))
    spread = stages.n_train(t).select("field", F.lit(0.1).alias("spread"))
    out = rolling.detect_shifts(s, ["field", "injector", "producer"], "f", spread, 0.02, ("strengthened", "weakened"), True)
    return out.withColumn("magnitude", rd("magnitude", 4))
