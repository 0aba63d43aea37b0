"""SQL twins of the intermediate tables, used only to check results in another engine.

``with_ctes`` puts the expressions a statement needs, directly or through others, in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def expand(sql: str) -> str:
    """Inline ``b_fo(alpha, beta, offset, cwi)``: the oil cut of a power-law water-oil ratio, zero when it overflows."""

    def oil_cut(m) -> str:
        a, b, o, c = (x.strip() for x in m.group(1).split(","))
        wor = f"({a}*pow(greatest({o}+{c},1e-9),{b}))"
        return f"(case when isnan({wor}) then 0e0 else 1/(1+{wor}) end)"

    return re.sub(r"\bb_fo\(([^()]*)\)", oil_cut, sql)


def with_ctes(sql: str) -> str:
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bb_\w+\b", text)):
            if name in CTES and name not in order:
                need(expand(CTES[name]))
                order.append(name)

    sql = expand(sql)
    need(sql)
    if not order:
        return sql
    recursive = "RECURSIVE " if any("/*recursive*/" in CTES[n] for n in order) or "/*recursive*/" in sql else ""
    head = ",\n".join(f"{n} AS ({expand(CTES[n])})" for n in order)
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"WITH {recursive}{head},\n{body[len(start):]}"
    return f"WITH {recursive}{head}\n{body}"


# ---------------------------------------------------------------- bindings
CTES["b_wells"] = """
select s_suppkey k, concat('S-', s_suppkey) well, r_name field, n_name block, n_regionkey region_no
from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey"""
CTES["b_month"] = """
select l_suppkey, cast(date_trunc('month', l_shipdate) as date) date,
 sum(case when l_suppkey%3=1 or (l_suppkey%3=2 and l_shipdate<timestamp '1998-06-16')
          then case when l_returnflag='R' then l_quantity else 0 end end) q_oil,
 sum(case when l_suppkey%3=1 or (l_suppkey%3=2 and l_shipdate<timestamp '1998-06-16')
          then case when l_returnflag<>'R' then l_quantity else 0 end end) q_water,
 sum(case when l_suppkey%3=0 or (l_suppkey%3=2 and l_shipdate>=timestamp '1998-06-16') then l_quantity end) q_inj,
 cast(count(distinct cast(l_shipdate as date)) as double) days_on
from lineitem group by 1,2"""
CTES["b_rates"] = """
select field, well, date, q_oil, q_water, cast(null as double) q_gas, q_inj, days_on
from b_month join b_wells on l_suppkey=k"""
CTES["b_category"] = """
select well, field, case when k%10=7 and c=1 then 'B' else 'A' end reservoir, block,
 case when k%20=7 then case when c=1 then 0.25e0 else 0.75e0 end end alloc_factor
from b_wells cross join (select 0 c union all select 1 c) t where c=0 or k%10=7"""
CTES["b_coords"] = """
select field, well, cast((k*7919)%10007 as double) x, cast((k*104729)%10009 as double) y,
 cast(2000+k%50 as double) tvd from b_wells"""
CTES["b_pressure"] = """
select field, well, cast(o_orderdate as date) date, 8000+o_totalprice/100 bhp, 1000+o_totalprice/500 whp,
 case o_orderpriority when '1-URGENT' then 'ESP' when '2-HIGH' then 'gauge' when '3-MEDIUM' then 'WHP'
                      when '5-LOW' then 'static survey' end src, 1900e0 depth
from orders join b_wells on o_orderkey%(select count(*) from supplier)=k"""
CTES["b_events"] = """
select field, well, cast(date '1995-01-01' + to_months(cast(event_id%83 as int)) as date) date,
 case when event_id%500=0 then 'WORKOVER' when event_type='click' then 'CHOKE' when event_type='view' then 'ESP_FREQ'
      when event_type='error' then 'PUMP' else 'OTHER' end type, event_type note, event_id seq
from events join b_wells on user_id%(select count(*) from supplier)=k"""
# ---------------------------------------------------------------- roles
CTES["b_steps"] = """
select *, case when coalesce(q_oil,0)+coalesce(q_water,0)>0 and coalesce(q_inj,0)>0 then 'B'
 when coalesce(q_oil,0)+coalesce(q_water,0)>0 then 'P' when coalesce(q_inj,0)>0 then 'I' else 'Z' end "mode" from b_rates"""
CTES["b_types"] = """
select field, well, case when hp and hi then 'MIXED' when hp then 'PROD' when hi then 'INJ' else 'NONE' end type,
 first, last, n_active, n_simultaneous from (
select field, well, bool_or("mode" in ('P','B')) hp, bool_or("mode" in ('I','B')) hi,
 min(date) filter ("mode"<>'Z') first, max(date) filter ("mode"<>'Z') last,
 count(*) filter ("mode"<>'Z') n_active, count(*) filter ("mode"='B') n_simultaneous from b_steps group by 1,2)"""
CTES["b_roles"] = """
select *, coalesce(clear,
  first_value(clear ignore nulls) over (partition by field, well order by date rows between 1 following and unbounded following),
  last_value(clear ignore nulls) over (partition by field, well order by date rows between unbounded preceding and 1 preceding),
  'P') role
from (select *, case when "mode"<>'B' then "mode" end clear from b_steps where "mode"<>'Z')"""
CTES["b_conv"] = """
select field, well, date, from_role, role to_role from (
select *, lag(role) over (partition by field, well order by date) from_role from b_roles) where from_role<>role"""
CTES["b_entity"] = """
select field, well, entity, role, date,
 case when type='MIXED' and role='I' then 0 else q_oil end q_oil, case when type='MIXED' and role='I' then 0 else q_water end q_water,
 case when type='MIXED' and role='I' then 0 else q_gas end q_gas, case when type='MIXED' and role='P' then 0 else q_inj end q_inj, days_on
from (
 select s.*, t.type, case when t.type='MIXED' then concat(s.well,'@',r.role) else s.well end entity, r.role
 from b_steps s join b_types t using (field, well)
 join (select 'P' role union all select 'I') r on
  (t.type='PROD' and r.role='P') or (t.type='INJ' and r.role='I') or
  (t.type='MIXED' and r.role='P' and s."mode" in ('P','B')) or (t.type='MIXED' and r.role='I' and s."mode" in ('I','B')))"""
# ---------------------------------------------------------------- grid
CTES["b_axis"] = """
select field, date, step, t_days, cast(coalesce(date_diff('day', prv, date), date_diff('day', date, nxt), 30) as double) dt_days,
 n_steps from (
select field, date, cast(row_number() over w - 1 as int) step, cast(date_diff('day', min(date) over (partition by field), date) as double) t_days,
 lag(date) over w prv, lead(date) over w nxt, cast(count(*) over (partition by field) as int) n_steps
from (select distinct field, date from b_entity) window w as (partition by field order by date))"""
CTES["b_entities"] = "select distinct field, well, entity, role from b_entity"
CTES["b_grid"] = """
select *, case when role='P' then oil*1.25 + water*1.02 end liq, case when role='I' then inj_s*1.02 end inj
from (select field, well, entity, role, step, date, t_days, dt_days, n_steps, oil, water, gas, inj_s,
 case when dys<=0 and (case when role='P' then oil+water else inj_s end)>0 then dt_days else dys end days_on
from (select e.field, e.well, e.entity, e.role, a.step, a.date, a.t_days, a.dt_days, a.n_steps,
 coalesce(r.q_oil,0) oil, coalesce(r.q_water,0) water, coalesce(r.q_gas,0) gas, coalesce(r.q_inj,0) inj_s, coalesce(r.days_on,0) dys
from b_entities e join b_axis a using (field) left join b_entity r on r.field=e.field and r.entity=e.entity and r.date=a.date))"""
CTES["b_seg"] = """
select *, case when role='P' and days_on>0 and liq>0 then liq end ux from b_grid"""
CTES["b_med"] = """
select *, list_filter([ux_m3,ux_m2,ux_m1,ux,ux_p1,ux_p2,ux_p3], lambda v: v is not null) seg from (
select *, lag(ux,3) over w ux_m3, lag(ux,2) over w ux_m2, lag(ux,1) over w ux_m1, lead(ux,1) over w ux_p1, lead(ux,2) over w ux_p2,
 lead(ux,3) over w ux_p3 from b_seg window w as (partition by field, entity order by step))"""
CTES["b_mad"] = """
select *, 1.4826*list_median(list_transform(seg, lambda v: abs(v-med))) mad from (select *, list_median(seg) med from b_med)"""
CTES["b_clean"] = """
select field, well, entity, role, step, date, t_days, dt_days, n_steps, days_on, oil oil_raw, water water_raw, liq liq_raw, inj inj_raw,
 is_spike, case when is_spike then med else liq end liq, inj, inj_s, gas,
 case when liq>0 then oil*(case when is_spike then med else liq end)/liq else oil end oil,
 case when liq>0 then water*(case when is_spike then med else liq end)/liq else water end water
from (select *, coalesce(ux is not null and len(seg)>=3 and mad>0 and abs(ux-med)>5.0*mad and abs(ux-med)>=0.25*abs(med)
  and (ux_m1 is not null or ux_p1 is not null) and coalesce(abs(ux-ux_m1)>5.0*mad,true) and coalesce(abs(ux-ux_p1)>5.0*mad,true), false) is_spike
 from b_mad)"""
