"""Queries: conformance, expressions, listings, roles, grid, cleaning, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.catalog.base import cleaned, entities, entity_rates, raw_grid
from wellspan.catalog.ctes import CTES
from wellspan.catalog.registry import query
from wellspan.config import DEFAULTS
from wellspan.functions import units
from wellspan.functions.numeric import rd
from wellspan.functions.text import normalise_id, parse_date
from wellspan.operators import clean, conform, events, grid, listing, roles

# ------------------------------------------------------------------ conformance
# A badly formatted copy of the rates: mixed date layouts, loose ids, text numbers.
CTES["b_raw"] = """
select field, concat('  s - ', substr(well,3), ' ') WELL_NAME,
 case k%6 when 0 then strftime(date,'%Y-%m-%d') when 1 then strftime(date,'%d/%m/%Y') when 2 then strftime(date,'%d-%b-%y')
   when 3 then strftime(date,'%b-%y') when 4 then strftime(date,'%Y%m') else case when month(date)=1 then 'n/a '||year(date) else strftime(date,'%d.%m.%Y') end end PROD_DATE,
 case when month(date)=2 then 'n/a' else cast(cast(q_oil as bigint) as varchar) end OIL_BBL, cast(cast(q_water as bigint) as varchar) WATER_BBL,
 cast(cast(q_inj as bigint) as varchar) INJ, days_on "DAYS"
from (select *, cast(substr(well,3) as bigint) k from b_rates)"""
_PARSE = """coalesce(try_strptime(s,'%Y-%m-%d'), try_strptime(s,'%d/%m/%Y'), try_strptime(s,'%m/%d/%Y'), try_strptime(s,'%d-%b-%y'),
 try_strptime(s,'%b-%y'), try_strptime(s,'%Y%m'), try_strptime(s,'%d.%m.%Y'))"""
CTES["b_parsed"] = f"select *, cast({_PARSE} as date) d from (select *, trim(PROD_DATE) s from b_raw)"


def raw_rates(t):
    k = F.substring("well", 3, 20).cast("bigint")
    fmt = lambda p: F.date_format("date", p)
    text = (
        F.when(k % 6 == 0, fmt("yyyy-MM-dd")).when(k % 6 == 1, fmt("dd/MM/yyyy")).when(k % 6 == 2, fmt("dd-MMM-yy"))
        .when(k % 6 == 3, fmt("MMM-yy")).when(k % 6 == 4, fmt("yyyyMM"))
        .otherwise(F.when(F.month("date") == 1, F.concat(F.lit("n/a "), F.year("date"))).otherwise(fmt("dd.MM.yyyy")))
    )
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    return t.rates().select(
        "field", F.concat(F.lit("  s - "), F.substring("well", 3, 20), F.lit(" ")).alias("WELL_NAME"), text.alias("PROD_DATE"),
        F.when(F.month("date") == 2, "n/a").otherwise(whole("q_oil")).alias("OIL_BBL"), whole("q_water").alias("WATER_BBL"),
        whole("q_inj").alias("INJ"), F.col("days_on").alias("DAYS"),
    )


MAPPING = conform.Mapping(
    {"well": "WELL_NAME", "date": "PROD_DATE", "q_oil": "OIL_BBL", "q_water": "WATER_BBL", "q_inj": "INJ", "days_on": "DAYS"},
    {"q_oil": "bbl/d", "q_water": "bbl/month", "q_inj": "m3/d"},
)
_BBL = "(1.0e0/6.289810770432105e0)"


@query("conform", f"""select field, concat('S-', trim(substr(trim(WELL_NAME),4))) well, d "date",
 round(try_cast(OIL_BBL as double)*{_BBL},6) q_oil, round(try_cast(WATER_BBL as double)/day(last_day(d))*{_BBL},6) q_water,
 try_cast(INJ as double) q_inj, "DAYS" days_on, cast(null as double) q_gas from b_parsed where d is not null""")
def _(t):
    out = conform.conform(raw_rates(t), "rates", MAPPING)
    return out.select("field", "well", "date", rd("q_oil").alias("q_oil"), rd("q_water").alias("q_water"), "q_inj", "days_on", "q_gas")


@query("require_columns", """select 'UNMAPPED_REQUIRED_COLUMN' code, 'dataset:'||ds scope, ds dataset, f field, n n_rows from
 (select 'rates' ds, 'q_oil / q_water / q_inj' f union all select 'coords', 'y') m, (select count(*) n from b_rates) c""")
def _(t):
    bad = [("rates", conform.Mapping({"well": "w", "date": "d"})), ("coords", conform.Mapping({"well": "w", "x": "x"}))]
    rows = [conform.require_columns(t.spark, ds, m) for ds, m in bad]
    n = t.rates().agg(F.count(F.lit(1))).scalar()
    return rows[0].unionByName(rows[1]).select(
        "code", "scope", F.col("context")["dataset"].alias("dataset"), F.col("context")["field"].alias("field"), n.alias("n_rows")
    )


@query("parse_dates", """select field, s raw, d "date", count(*) n from b_parsed group by all""")
def _(t):
    raw = raw_rates(t).select("field", F.trim("PROD_DATE").alias("raw"), parse_date(F.col("PROD_DATE")).alias("date"))
    return raw.groupBy("field", "raw", "date").agg(F.count(F.lit(1)).alias("n"))


@query("bad_dates", """select field, sum(n)::bigint n_bad, array_to_string(list_sort(list(s))[1:3], ', ') examples
 from (select field, PROD_DATE s, count(*) n from b_parsed where d is null group by all) group by 1""")
def _(t):
    return conform.bad_dates(raw_rates(t), "PROD_DATE", ["field"])


@query("lenient_cast", """select field, WELL_NAME well_name, PROD_DATE prod_date, try_cast(OIL_BBL as double) q_oil from b_raw""")
def _(t):
    return raw_rates(t).select(
        "field", F.col("WELL_NAME").alias("well_name"), F.col("PROD_DATE").alias("prod_date"),
        F.col("OIL_BBL").try_cast("double").alias("q_oil"),
    )


TAGS = ["m3/d", "bbl/d", "psi", "bar", "ft", "Mscf/d", "scf/stb"]


@query("unit_convert", """select o_orderkey, tag, kind, round(o_totalprice*factor, 4) value from (
 select *, case o_orderkey%7 when 0 then 'm3/d' when 1 then 'bbl/d' when 2 then 'psi' when 3 then 'bar' when 4 then 'ft' when 5 then 'Mscf/d'
  else 'scf/stb' end tag from orders) join (values ('m3/d','rate',1e0),('bbl/d','rate',1e0/6.289810770432105e0),
  ('psi','pressure',1e0/0.14503773773020923e0),('bar','pressure',100e0),('ft','length',1e0/3.280839895013123e0),
  ('Mscf/d','gas_rate',1000e0/35.31466672148859e0),('scf/stb','gor',1e0/(35.31466672148859e0/6.289810770432105e0))) u(tag,kind,factor) using (tag)""")
def _(t):
    pick = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = t.read("orders").select("o_orderkey", "o_totalprice", pick.alias("tag"))
    out = units.to_internal_by_tag(o, "o_totalprice", "tag", "value")
    return out.select("o_orderkey", "tag", "kind", rd("value", 4).alias("value"))


@query("monthly_volume_to_rate", """select field, well, date, round(q_oil/day(last_day(date)),6) rate from b_rates""")
def _(t):
    return t.rates().select("field", "well", "date", rd(units.month_volume_to_day_rate(F.col("q_oil"), F.col("date"))).alias("rate"))


@query("normalise_id", """select field, raw, case when well='S-1' then 'NORTH-1' else well end well from (
 select distinct field, WELL_NAME raw, concat('S-', trim(substr(trim(WELL_NAME),4))) well from b_raw)""")
def _(t):
    ids = raw_rates(t).select("field", F.col("WELL_NAME").alias("raw")).distinct()
    ids = ids.withColumn("well", normalise_id(F.col("raw")))
    aliases = t.wells().where(F.col("k") == 1).select(F.lit("s - 1").alias("alias"), F.lit("NORTH-1").alias("target"))
    return conform.apply_aliases(ids, aliases).select("field", "raw", "well")


@query("fill_missing_columns", """select field, well, date, q_oil, cast(null as double) q_water, cast(null as double) q_gas,
 cast(null as double) q_inj, cast(null as double) days_on from b_rates""")
def _(t):
    return conform.fill_missing_columns(t.rates().select("field", "well", "date", "q_oil"))


@query("unmatched_ids", """select distinct well from (select well from b_pressure union all select concat('X-', well) from b_pressure) where well not in (select well from b_rates)""")
def _(t):
    gauges = t.pressure().select("well")
    return conform.unmatched_ids(t.rates(), gauges.unionByName(gauges.select(F.concat(F.lit("X-"), "well").alias("well"))))


# ------------------------------------------------------------------ filters and listings
@query("category_filter", """select r.field, r.well, r.date, r.q_oil, r.q_inj from b_rates r where exists (select 1 from b_category c where
 c.field=r.field and c.well=r.well and c.field='ASIA' and c.reservoir='B')""")
def _(t):
    return listing.category_filter(t.rates(), t.category(), field="ASIA", reservoir="B").select("field", "well", "date", "q_oil", "q_inj")


@query("well_subset", """select field, well, date, q_oil from b_rates where well in ('S-1','S-4','S-7')""")
def _(t):
    return listing.well_subset(t.rates(), ["S-1", "S-4", "S-7"]).select("field", "well", "date", "q_oil")


@query("well_listing", """select t.*, true has_coords, exists(select 1 from b_pressure p where p.well=t.well) has_pressure from b_types t""")
def _(t):
    return listing.well_listing(t.rates(), t.coords(), t.pressure())


@query("category_tree", """select field, reservoir, array_to_string(list_sort(list(distinct block)),'|') blocks from b_category group by 1,2""")
def _(t):
    return listing.category_tree(t.category()).select("field", "reservoir", F.array_join("blocks", "|").alias("blocks"))


# ------------------------------------------------------------------ expressions
CTES["b_pvt"] = """select cast(1000+2000*r_regionkey as double) p, 1.0+0.05*r_regionkey bo, 20.0+15.0*r_regionkey rs, 0.02/(1+r_regionkey) bg from region"""


def pvt_table(t):
    k = F.col("r_regionkey")
    return t.read("region").select(
        (1000 + 2000 * k).cast("double").alias("p"), (1.0 + 0.05 * k).alias("bo"), (20.0 + 15.0 * k).alias("rs"), (0.02 / (1 + k)).alias("bg")
    )


@query("pvt_lookup", """select field, well, date, round(bhp,4) bhp, round(case when lo.p is null then f.bo when hi.p is null then l.bo
 else lo.bo+(hi.bo-lo.bo)*(bhp-lo.p)/(hi.p-lo.p) end,4) bo, round(case when lo.p is null then f.rs when hi.p is null then l.rs
 else lo.rs+(hi.rs-lo.rs)*(bhp-lo.p)/(hi.p-lo.p) end,4) rs from b_pressure
 left join b_pvt lo on lo.p=(select max(p) from b_pvt where p<=bhp) left join b_pvt hi on hi.p=(select min(p) from b_pvt where p>bhp)
 cross join (select * from b_pvt order by p limit 1) f cross join (select * from b_pvt order by p desc limit 1) l""")
def _(t):
    pts = units.pvt_segments(pvt_table(t)).scalar()
    p = t.pressure().withColumn("pts", pts)
    at = lambda n: rd(units.pvt_at(F.col("pts"), F.col("bhp"), n), 4).alias(n)
    return p.select("field", "well", "date", rd("bhp", 4).alias("bhp"), at("bo"), at("rs"))


def gas_rates(t):
    """Rates with a gas column made from water and month."""
    return t.rates().withColumn("q_gas", F.col("q_water") * F.month("date"))


CTES["b_gas"] = "select field, well, date, q_oil, q_water, q_inj, days_on, q_water*month(date) q_gas from b_rates"


@query("free_gas", """select field, well, date, coalesce((case when q_oil>0 then q_gas/q_oil else 0 end) > 3.0*1.05, false) free from b_gas""")
def _(t):
    return gas_rates(t).select("field", "well", "date", units.free_gas(F.col("q_oil"), F.col("q_gas"), F.lit(3.0)).alias("free"))


@query("reservoir_production", """select field, well, date, round(q_oil*1.25+q_water*1.02+case when coalesce((case when q_oil>0 then q_gas/q_oil else 0 end)>3.0*1.05,false)
 then greatest(q_gas-q_oil*3.0,0)*0.004 else 0 end,6) q_res from b_gas where q_oil is not null""")
def _(t):
    g = gas_rates(t).where(F.col("q_oil").isNotNull())
    q = units.reservoir_production(
        F.col("q_oil"), F.col("q_water"), F.col("q_gas"), F.lit(1.25), F.lit(1.02), F.lit(3.0), F.lit(0.004)
    )
    return g.select("field", "well", "date", rd(q).alias("q_res"))


@query("reservoir_injection", """select field, well, date, round(q_inj*1.02,6) i_res from b_rates where q_inj is not null""")
def _(t):
    return t.rates().where(F.col("q_inj").isNotNull()).select("field", "well", "date", rd(F.col("q_inj") * DEFAULTS.bw).alias("i_res"))


@query("datum_shift", """select field, well, date, round(bhp+9.8*(2000-depth),4) p_datum from b_pressure""")
def _(t):
    return t.pressure().select("field", "well", "date", rd(units.datum_shift(F.col("bhp"), F.col("depth"), 2000.0, 9.8), 4).alias("p_datum"))


@query("mixture_gradient", """select field, well, date, round(wc*0.433+(1-wc)*0.35,6) gradient from (
 select field, well, date, case when q_oil+q_water>0 then q_water/(q_oil+q_water) else 0 end wc from b_rates where q_oil is not null)""")
def _(t):
    cut = units.water_cut(F.col("q_oil"), F.col("q_water"))
    return t.rates().where(F.col("q_oil").isNotNull()).select(
        "field", "well", "date", rd(units.mixture_gradient(cut, 0.433, 0.35)).alias("gradient")
    )


@query("calendar_day_rate", """select field, entity, date, round(liq/dt_days,6) rate from b_grid where role='P'""")
def _(t):
    g = raw_grid(t).where(F.col("role") == "P")
    return g.select("field", "entity", "date", rd(units.calendar_day_rate(F.col("liq"), F.col("dt_days"))).alias("rate"))


@query("producing_day_rate", """select field, well, date, round(case when days_on>0 then q_oil/days_on else 0 end,6) rate from b_rates""")
def _(t):
    return t.rates().select("field", "well", "date", rd(units.producing_day_rate(F.col("q_oil"), F.col("days_on"))).alias("rate"))


@query("water_cut", """select field, entity, step, round(case when oil+water>0 then water/(oil+water) else 0 end,6) water_cut from b_grid where role='P'""")
def _(t):
    return grid.add_water_cut(raw_grid(t).where(F.col("role") == "P")).select("field", "entity", "step", rd("water_cut").alias("water_cut"))


# ------------------------------------------------------------------ roles
@query("classify_steps", """select field, well, date, "mode" from b_steps""")
def _(t):
    return roles.classify_steps(t.rates()).select("field", "well", "date", "mode")


@query("well_types", "select * from b_types")
def _(t):
    return roles.well_types(t.rates())


@query("resolved_role", """select field, well, date, "mode", role from b_roles""")
def _(t):
    return roles.resolved_role(t.rates()).select("field", "well", "date", "mode", "role")


@query("conversions", "select * from b_conv")
def _(t):
    return roles.conversions(t.rates())


@query("split_roles", """select field, well, entity, role, date, q_oil, q_water, q_inj, days_on from b_entity""")
def _(t):
    return entity_rates(t).select("field", "well", "entity", "role", "date", "q_oil", "q_water", "q_inj", "days_on")


CTES["b_convev"] = """select field, well, date, 'CONVERSION' type, concat(case from_role when 'P' then 'producer' else 'injector' end, ' to ',
 case to_role when 'P' then 'producer' else 'injector' end) note, cast(null as bigint) seq from b_conv"""


@query("conversion_events", "select field, well, date, type, note from b_convev")
def _(t):
    return roles.conversion_events(t.rates())


@query("merge_events", "select field, well, date, type, note from b_events union all select field, well, date, type, note from b_convev")
def _(t):
    return roles.merge_events(t.events(), t.rates()).drop("seq")


@query("split_commingled", """select r.field, case when f.share is not null then concat(r.well,'#',f.reservoir) else r.well end well, r.date,
 round(q_oil*coalesce(share,1),6) q_oil, round(q_water*coalesce(share,1),6) q_water, round(q_inj*coalesce(share,1),6) q_inj, days_on
 from b_rates r left join (select field, well, reservoir, case when nf=n then alloc_factor/tot else 1e0/n end share from (
 select *, count(*) over w n, count(alloc_factor) over w nf, sum(alloc_factor) over w tot, count(distinct reservoir) over w nr
 from b_category window w as (partition by field, well)) where nr>1) f on f.field=r.field and f.well=r.well""")
def _(t):
    out = roles.split_commingled(t.rates(), t.category())
    return out.select("field", "well", "date", rd("q_oil").alias("q_oil"), rd("q_water").alias("q_water"), rd("q_inj").alias("q_inj"), "days_on")


# ------------------------------------------------------------------ grid
@query("time_axis", "select field, step, date, t_days, dt_days, n_steps from b_axis")
def _(t):
    return grid.time_axis(entity_rates(t))


@query("densify", """select field, entity, role, step, date, oil, water, inj_s, days_on from b_grid""")
def _(t):
    return grid.densify(entity_rates(t)).select("field", "entity", "role", "step", "date", "oil", "water", "inj_s", "days_on")


@query("drop_duplicates", """select field, well, entity, role, date, max_by(q_oil, seq) q_oil, max_by(q_inj, seq) q_inj from (
 select *, 1 seq from b_entity union all select * replace (q_oil*2 as q_oil, q_inj*2 as q_inj), 2 from b_entity where month(date)=6) group by all""")
def _(t):
    e = entity_rates(t)
    again = e.where(F.month("date") == 6).withColumns({"q_oil": F.col("q_oil") * 2, "q_inj": F.col("q_inj") * 2})
    both = e.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))
    return grid.drop_duplicates_keep_last(both, "seq").select("field", "well", "entity", "role", "date", "q_oil", "q_inj")


@query("reservoir_grid", """select field, entity, step, round(liq,6) liq, round(inj,6) inj from b_grid""")
def _(t):
    return raw_grid(t).select("field", "entity", "step", rd("liq").alias("liq"), rd("inj").alias("inj"))


@query("pivot_wide", """select field, date, (k//4)::int page, max(entity) filter (k%4=0) e0, max(entity) filter (k%4=1) e1, max(entity) filter (k%4=2) e2, max(entity) filter (k%4=3) e3,
 max(oil) filter (k%4=0) v0, max(oil) filter (k%4=1) v1, max(oil) filter (k%4=2) v2, max(oil) filter (k%4=3) v3
 from b_grid join (select field, entity, row_number() over (partition by field order by entity)-1 k from (select distinct field, entity from b_grid)) using (field, entity) group by 1,2,3""")
def _(t):
    return grid.pivot_pages(raw_grid(t), "oil", 4)


@query("entity_coords", """with e as (select field, entity, role, well from b_entities union all select concat(field,' new'), entity, role, well from b_entities union all select distinct concat(field,' new'), 'S-1', 'P', 'S-1' from b_entities),
 c as (select field, well, x, y from b_coords union all select concat(field,' new'), well, x, y from b_coords)
 select distinct e.field, entity, role, e.well, x, y, usable from e left join c using (field, well)
 join (select e.field, bool_and(x is not null and y is not null) usable from e left join c using (field, well) group by 1) u on u.field=e.field""")
def _(t):
    """Every field as it is, and once more with a well added that has coordinates in one field only."""
    named = lambda d: d.withColumn("field", F.concat("field", F.lit(" new")))
    e, c = entities(t), t.coords()
    added = named(e).select("field").distinct().withColumns({"well": F.lit("S-1"), "entity": F.lit("S-1"), "role": F.lit("P")})
    return grid.entity_coords(e.unionByName(named(e)).unionByName(added).distinct(), c.unionByName(named(c)))


@query("window_slice", """select field, entity, step-12 step, t_days-t0 t_days, case when step=12 then dt1 else dt_days end dt_days, least(60,n_steps)-12 n_steps from (
 select *, first_value(t_days) over w t0, nth_value(dt_days,2) over (w rows between unbounded preceding and unbounded following) dt1
 from b_grid where step>=12 and step<60 window w as (partition by field, entity order by step))""")
def _(t):
    return grid.window_slice(raw_grid(t), 12, 60).select("field", "entity", "step", "t_days", "dt_days", "n_steps")


@query("active_entities", """select field, entity, count(*) n, round(sum(coalesce(liq,inj)),4) volume from b_grid group by 1,2
 having count(*) filter (days_on>0)>=20 and sum(coalesce(liq,inj))>0""")
def _(t):
    g = grid.active_entities(raw_grid(t), 20)
    return g.groupBy("field", "entity").agg(F.count(F.lit(1)).alias("n"), rd(F.sum(F.coalesce("liq", "inj")), 4).alias("volume"))


@query("subset", """select field, entity, step, liq, inj from b_grid where entity in (select well from b_category where reservoir='B') or entity in ('S-0','S-1')""")
def _(t):
    keep = t.category().where(F.col("reservoir") == "B").select("field", F.col("well").alias("entity"))
    keep = keep.unionByName(t.wells().where(F.col("k") < 2).select("field", F.col("well").alias("entity"))).distinct()
    return raw_grid(t).join(keep, ["field", "entity"], "left_semi").select("field", "entity", "step", "liq", "inj")


CTES["b_field"] = """select field, step, date, t_days, dt_days, n_steps, coalesce(sum(inj),0) inj, coalesce(sum(liq),0) liq,
 sum(case when role='P' then oil else 0 end) oil, sum(case when role='P' then water else 0 end) water,
 max(case when role='P' then days_on end) days_on_prod, max(case when role='I' then days_on end) days_on_inj from b_grid group by all"""


@query("field_collapse", """select field, step, round(inj,6) inj, round(liq,6) liq, oil, water, days_on_prod, days_on_inj from b_field""")
def _(t):
    return grid.field_collapse(raw_grid(t)).select(
        "field", "step", rd("inj").alias("inj"), rd("liq").alias("liq"), "oil", "water", "days_on_prod", "days_on_inj"
    )


# ------------------------------------------------------------------ cleaning
@query("cap_negatives", """select field, entity, step, greatest(oil-20,0) oil, greatest(water-20,0) water, greatest(inj-20,0) inj from b_grid""")
def _(t):
    g = raw_grid(t).withColumns({c: F.col(c) - 20 for c in ("oil", "water", "inj")})
    return clean.cap_negatives(g).select("field", "entity", "step", "oil", "water", F.when(F.col("role") == "I", F.col("inj")).otherwise(0.0).alias("inj"))


@query("negative_report", """select field, entity, count(*) filter (case when role='P' then oil<20 or water<20 else inj<20 end) n_negative from b_grid group by 1,2""")
def _(t):
    g = raw_grid(t).withColumns({c: F.col(c) - 20 for c in ("oil", "water", "inj")})
    return clean.negative_report(g)


@query("hampel", """select field, entity, step, round(liq_raw,6) liq_raw, round(liq,6) liq, is_spike from b_clean where role='P'""")
def _(t):
    return cleaned(t).where(F.col("role") == "P").select(
        "field", "entity", "step", rd("liq_raw").alias("liq_raw"), rd("liq").alias("liq"), "is_spike"
    )


@query("rescale_split", """select field, entity, step, round(oil,6) oil, round(water,6) water, oil_raw, water_raw from b_clean where role='P'""")
def _(t):
    return cleaned(t).where(F.col("role") == "P").select(
        "field", "entity", "step", rd("oil").alias("oil"), rd("water").alias("water"), "oil_raw", "water_raw"
    )


@query("outlier_report", """select field, entity, count(*) filter (is_spike) n_replaced from b_clean group by 1,2""")
def _(t):
    return clean.outlier_report(cleaned(t))


# ------------------------------------------------------------------ events
CTES["b_evstep"] = """select e.field, e.well, e.date, e.type, e.note, e.seq, (select count(*) from b_axis a where a.field=e.field and a.date<e.date)::int step,
 (select max(n_steps) from b_axis a where a.field=e.field) n_steps from b_events e where e.field in (select field from b_axis)"""
CTES["b_breaks"] = """select field, step, n_steps, min_by(concat(type,' at ',well,' (',date,')'), seq) reason from b_evstep
 where type in ('WORKOVER','CONVERSION','INFILL','RECOMPLETION') and step>0 and step<n_steps group by 1,2,3"""


def dates(t):
    return grid.field_dates(entity_rates(t))


@query("event_step", "select field, well, date, type, step from b_evstep")
def _(t):
    return events.event_step(t.events(), dates(t)).select("field", "well", "date", "type", "step")


@query("break_points", "select field, step, reason from b_breaks")
def _(t):
    return events.break_points(t.events(), dates(t)).select("field", "step", "reason")


@query("history_windows")
def _(t):
    d = dates(t)
    return events.history_windows(events.break_points(t.events(), d), d)


@query("events_per_well", """select field, round(coalesce(ne*1e0/nw,0),6) events_per_well from (select field, count(distinct entity) nw from b_entities group by 1)
 left join (select field, count(*) ne from b_events group by 1) using (field)""")
def _(t):
    return events.events_per_well(t.events(), entities(t)).select("field", rd("events_per_well").alias("events_per_well"))


@query("lift_event_counts", """select e.field, e.entity, count(v.seq) n_lift_events from b_entities e left join b_events v on v.field=e.field and v.well=e.well
 and v.type in ('CHOKE','ESP_FREQ','ESP','LIFT','PUMP','FREQUENCY') where e.role='P' group by 1,2""")
def _(t):
    return events.lift_event_counts(t.events(), entities(t).where(F.col("role") == "P"))


@query("long_shutins", """select field, entity, min(step) step_from, max(step)+1 step_to, (count(*))::int "months", min(date) since from (
 select *, row_number() over (partition by field, entity order by step) - row_number() over (partition by field, entity, days_on<=0 order by step) grp
 from (select * replace (case when step%29 between 11 and 18 then 0 else days_on end as days_on) from b_grid where role='P')) where days_on<=0 group by field, entity, grp, n_steps
 having count(*)>=6 and min(step)>0 and max(step)+1<n_steps""")
def _(t):
    closed = F.when((F.col("step") % 29).between(11, 18), 0.0).otherwise(F.col("days_on"))
    return events.long_shutins(raw_grid(t).withColumn("days_on", closed))


@query("fit_weights", """select field, entity, step, round(case when cut then 0 else w end,6) weight from (
 select *, (coalesce(max(re) over (o rows between 1 preceding and current row),0)>0) or (coalesce(max(si) over (o rows between 1 following and 2 following),0)>0) cut from (
 select *, (case when days_on>0 then 1 else 0 end)*pow(0.5,(n_steps-1-step)/12.0) w,
  case when days_on>0 and lag(days_on) over o <=0 then 1 else 0 end re, case when days_on<=0 and lag(days_on) over o>0 then 1 else 0 end si
 from b_grid where role='P' window o as (partition by field, entity order by step)) window o as (partition by field, entity order by step))""")
def _(t):
    w = events.fit_weights(raw_grid(t), half_life=12.0, after_restart=2, before_shutin=2)
    return w.select("field", "entity", "step", rd("weight").alias("weight"))
