"""Connectivity estimation recast as grid x Gram aggregation.

For a given time constant the response is linear in the couplings. Spark brings each producer's history and the rates of the
injectors in reach together in one row; a task then filters, solves a box-bounded least squares of a dozen unknowns
for each time constant and keeps the best, on Arrow batches of many producers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.config import DEFAULTS, Settings
from wellspan.functions.response import exp_filter, primary_decline, tau_grid
from wellspan.operators.solver import History, best_fit, bounded_least_squares, normal_equations, shared_least_squares
from wellspan.session import cut_lineage

PROD = ["field", "producer"]
#: Rounds without progress after which a group of fits is left unsettled; rounds between two looks at the duality gap, and how far
#: a round goes beyond its couplings.
STALE, LOOK, OVER = 3, 5, 1.6
#: Producers or injectors, and numbers in cross products, up to which a field's couplings are bounded in one task.
WELLS, NUMBERS = 20_000, 8_000_000


def producer_start(prod: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First producing step and initial rate: the first rate when on stream from the start, else the median of the
    three grid rows from the start.  prod: field, producer, step, t_days, on, liq."""
    pk = [*(keys or ["field"]), "producer"]
    w = Window.partitionBy(*pk)
    p = prod.withColumn("start", F.min(F.when(F.col("on"), F.col("step"))).over(w))
    early = F.when((F.col("step") >= F.col("start")) & (F.col("step") < F.col("start") + 3), F.col("liq"))
    out = p.groupBy(*pk).agg(
        F.max("start").alias("start"), F.max("step").alias("last_step"),
        F.max(F.when(F.col("step") == F.col("start"), F.col("liq"))).alias("first_rate"),
        F.percentile(early, 0.5).alias("median3"),
        F.max(F.when(F.col("step") == F.col("start"), F.col("t_days"))).alias("t_start"),
    )
    q0 = F.when(F.col("start").isNull(), 0.0).when(F.col("start") == 0, F.col("first_rate")).otherwise(F.col("median3"))
    return out.select(*pk, F.coalesce("start", F.col("last_step") + 1).alias("start"), q0.alias("q0"), "t_start")


def producer_rows(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("role") == "P").select(
        "field", F.col("entity").alias("producer"), "step", "date", "t_days", "dt_days", "n_steps",
        (F.col("days_on") > 0).alias("on"), "liq", "oil", "water",
    )


def injector_rows(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("role") == "I").select(
        "field", F.col("entity").alias("injector"), "step", "date", "t_days", "dt_days", "n_steps",
        (F.col("days_on") > 0).alias("on"), "inj",
    )


def _series(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """One row per key with its steps and values as arrays of equal length, so that a history travels to each pair as one row."""
    v = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", *values))).alias("v"))
    part = lambda name: F.transform("v", lambda e: e[name]).alias(f"{name}s")
    return v.select(*keys, part("step"), *[part(c) for c in values])


def shutin_redistribution(pairs: DataFrame, prod: DataFrame, keys: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Multiplier per injector and step that passes a closed producer's share on to the open ones.

    A pair is dealt to its injector with the producer's history in one row, and unfolded there."""
    tot = pairs.groupBy(*keys, "injector").agg(F.sum("f").alias("tot"))
    at = [c for c in [*keys, "producer"] if c in prod.columns]
    opened = pairs.join(_series(prod, at, "on"), at).select(*keys, "injector", "f", "steps", "ons").repartition(*keys, "injector")
    opened = opened.select(*keys, "injector", "f", F.explode(F.arrays_zip("steps", "ons")).alias("e"))
    per = opened.groupBy(*keys, "injector", F.col("e.steps").alias("step")).agg(
        F.sum(F.when(F.col("e.ons"), F.col("f")).otherwise(0.0)).alias("open_sum")
    ).join(tot, [*keys, "injector"])
    g = F.when(F.col("open_sum") > 1e-12, F.col("tot") / F.greatest("open_sum", F.lit(1e-12))).otherwise(1.0)
    return per.select(*keys, "injector", "step", F.least(g, F.lit(max(1.0, cfg.shut_in_max_multiplier))).alias("g"))


def allocated_source(pairs: DataFrame, inj: DataFrame, keys: list[str], g: DataFrame | None = None) -> DataFrame:
    """Allocated injection per producer and step: sum over injectors of f times rate. ``g`` has one row per injector and step.

    Rates and multipliers meet once per injector; a pair is dealt to its producer with them in one row, and unfolded there."""
    rates = _series(inj, ["field", "injector"], "inj")
    if g is not None:
        times = g.groupBy(*keys, "injector").agg(F.map_from_entries(F.collect_list(F.struct("step", "g"))).alias("_g"))
        rates = pairs.select(*keys, "injector").distinct().join(rates, ["field", "injector"]).join(times, [*keys, "injector"], "left")
        each = F.zip_with("steps", "injs", lambda step, rate: rate * F.coalesce(F.try_element_at("_g", step), F.lit(1.0)))
        rates = rates.withColumn("injs", each).drop("_g")
    rows = pairs.join(rates, ["field", "injector"] if g is None else [*keys, "injector"])
    rows = rows.select(*keys, "producer", "f", "steps", "injs").repartition(*keys, "producer")
    rows = rows.select(*keys, "producer", "f", F.explode(F.arrays_zip("steps", "injs")).alias("e"))
    return rows.groupBy(*keys, "producer", F.col("e.steps").alias("step")).agg(F.sum(F.col("f") * F.col("e.injs")).alias("support"))


def predict_history(
    grid: DataFrame, pairs: DataFrame, params: DataFrame, members: list[str] | None = None, redistribute: bool = True,
    cfg: Settings = DEFAULTS, pressure: DataFrame | None = None,
) -> DataFrame:
    """Fitted liquid per producer and step; zero before the start and while closed.

    pairs: field, injector, producer, f; params: field, producer, tau, gain_p, tau_p[, j]; both also carry the extra
    key columns named in ``members``.  With redistribution a closed producer's state is frozen.
    """
    keys = ["field", *(members or [])]
    prod, inj = producer_rows(grid), injector_rows(grid)
    g = shutin_redistribution(pairs, prod, keys, cfg) if redistribute else None
    src = allocated_source(pairs, inj, keys, g)
    src = src.groupBy(*keys, "producer").agg(F.map_from_entries(F.collect_list(F.struct("step", "support"))).alias("_supports"))
    rows = prod.join(producer_start(prod), PROD).join(params.join(src, [*keys, "producer"], "left"), PROD)
    rows = rows.withColumn("support", F.try_element_at("_supports", F.col("step"))).drop("_supports")
    source = F.coalesce("support", F.lit(0.0))
    if pressure is not None:
        rows = rows.join(pressure, [*PROD, "step"], "left")
        source = source - F.coalesce("j", F.lit(0.0)) * F.col("tau") * F.coalesce("dpdt", F.lit(0.0))
    live = F.coalesce(F.col("step") >= F.col("start"), F.lit(False))
    rows = rows.withColumns({"_src": source, "_live": live})
    open_ = F.col("on") if redistribute else None
    # rows before the start are a series of their own, so that all rows stay where the joins on PROD have put them
    rows = exp_filter(rows, [*keys, "producer", "_live"], F.col("_src"), F.col("tau"), "x", open_)
    prim = primary_decline(F.col("gain_p"), F.col("q0"), F.col("t_days"), F.col("t_start"), F.col("tau_p"))
    q = F.col("x") + prim
    q = F.when(F.col("on"), q).otherwise(0.0) if redistribute else q
    fit = F.when(F.col("_live"), F.struct(q.alias("pred"), F.col("x").alias("state")))
    here = F.collect_list(fit).over(Window.partitionBy(*keys, "producer", "step"))  # more than one only where a step repeats
    out = rows.select(*keys, "producer", "step", "date", "t_days", "dt_days", "n_steps", "on", "liq", "oil", "water", here.alias("_here"))
    out = out.withColumn("_here", F.explode_outer("_here")).withColumns({c: F.coalesce(F.col(f"_here.{c}"), F.lit(0.0)) for c in ("pred", "state")})
    return out.drop("_here")


# ---------------------------------------------------------------------------------------------- field tank
def tau_bounds(steps: DataFrame, keys: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Range of time constants from the step lengths: shortest step up to sixty mean steps."""
    tail = F.when(F.col("step") > 0, F.col("dt_days"))
    b = steps.groupBy(*keys).agg(F.min(tail).alias("lo"), F.avg(tail).alias("mean_dt"))
    return b.select(*keys, "lo", F.least(F.lit(cfg.tau_max_days), 60.0 * F.col("mean_dt")).alias("hi"))


def _tank_pass(rows: DataFrame, keys: list[str], taus: DataFrame) -> DataFrame:
    """Closed-form f and SSE for every time constant.  ``taus``: keys, taus (array), small: one row per field."""
    r = rows.join(taus, keys).withColumn("tau", F.explode("taus")).drop("taus").repartition(*keys, "tau")
    k = [*keys, "tau"]
    r = exp_filter(r, k, F.col("inj"), F.col("tau"), "c")
    y = F.col("q") - F.col("q0") * F.exp(-F.col("t_days") / F.col("tau"))
    r = r.withColumn("y", y).where(F.col("step") < F.col("n_train"))
    w2 = F.col("w") * F.col("w")
    s = r.groupBy(*k).agg(
        F.sum(w2 * F.col("c") * F.col("y")).alias("cy"), F.sum(w2 * F.col("c") * F.col("c")).alias("cc"),
        F.sum(w2 * F.col("y") * F.col("y")).alias("yy"),
    )
    f = F.when(F.col("cc") > 0, F.least(F.greatest(F.col("cy") / F.col("cc"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    s = s.withColumn("f", f)
    return s.withColumn("sse", F.col("yy") - 2 * F.col("f") * F.col("cy") + F.col("f") * F.col("f") * F.col("cc"))


def fit_field_tank(rows: DataFrame, keys: list[str] | None = None, cfg: Settings = DEFAULTS, keep=None) -> DataFrame:
    """One injector, one producer per field.  rows: keys, step, t_days, dt_days, inj, q, q0, w, n_train.
    A second pass searches between the neighbours of the best grid point; ``keep`` materialises the first pass."""
    keys = keys or ["field"]
    n = cfg.tau_grid_points
    b = tau_bounds(rows, keys, cfg)
    coarse = b.select(*keys, tau_grid(F.col("lo"), F.col("hi"), n).alias("taus"))
    first = _tank_pass(rows, keys, coarse)
    pick = lambda d: d.groupBy(*keys).agg(F.min_by(F.struct("tau", "f", "sse"), F.struct("sse", "tau")).alias("b")).select(*keys, "b.*")
    best = (keep or (lambda d: d))(pick(first))
    ratio = F.exp((F.log("hi") - F.log("lo")) / (n - 1))
    fine = best.join(b, keys).select(*keys, tau_grid(F.col("tau") / ratio, F.col("tau") * ratio, n).alias("taus"))
    return pick(_tank_pass(rows, keys, fine).select(*keys, "tau", "f", "sse").unionByName(best))


def tank_allocation(prod: DataFrame, tank: DataFrame, injectors: DataFrame) -> DataFrame:
    """Couplings of a field tank: every injector gives each producer the tank's f times its share of training liquid.

    ``tank``: field, f, n_train.  The result is one row per producer plus the tank's f, as every injector of the field
    has the same row; ``injectors`` only says how many there are.
    """
    vol = prod.join(tank, "field").where(F.col("step") < F.col("n_train")).groupBy("field", "producer").agg(
        F.greatest(F.sum("liq"), F.lit(0.0)).alias("v"), F.max("f").alias("f")
    )
    tot = vol.groupBy("field").agg(F.sum("v").alias("tv"), F.count(F.lit(1)).alias("np"))
    share = F.when(F.col("tv") > 0, F.col("v") / F.col("tv")).otherwise(1.0 / F.col("np"))
    n_inj = injectors.groupBy("field").agg(F.count(F.lit(1)).alias("n_injectors"))
    return vol.join(tot, "field").join(n_inj, "field").select(
        "field", "producer", share.alias("share"), (F.col("f") * share).alias("f_per_injector"), "n_injectors"
    )


# ---------------------------------------------------------------------------------------------- producer grid
def producer_matrices(
    prod: DataFrame, inj: DataFrame, mask: DataFrame, n_train: DataFrame, keys: list[str] | None = None, cfg: Settings = DEFAULTS,
    multiplier: DataFrame | None = None, pressure: DataFrame | None = None,
) -> DataFrame:
    """One row per producer with its history from the start and the rates of its injectors, all as arrays.

    prod: keys, producer, step, t_days, dt_days, on, liq, w; inj: keys, injector, step, inj; mask: keys, injector, producer;
    multiplier: keys, injector, step, g; pressure: keys, producer, step, dpdt. An injector's series is put together once and
    travels to the producers in reach, so a row is bounded by a history and a producer's neighbours. Steps are matched by
    number: an injector without a row at a step injects nothing.
    """
    keys = keys or ["field"]
    pk = [*keys, "producer"]
    start = producer_start(prod, keys)
    b = tau_bounds(prod, keys, cfg)
    rows = prod.join(start, pk).join(n_train, keys).where(F.col("step") >= F.col("start"))
    if pressure is not None:
        rows = rows.join(pressure.select(*pk, "step", "dpdt"), [*pk, "step"], "left")
    slope = F.coalesce("dpdt", F.lit(0.0)) if pressure is not None else F.lit(None).cast("double")
    cell = F.struct("step", (F.col("t_days") - F.col("t_start")).alias("t"), F.col("dt_days").cast("double").alias("dt"), "on", F.coalesce("liq", F.lit(0.0)).alias("liq"), F.coalesce("w", F.lit(0.0)).alias("w"), (F.col("step") < F.col("n_train")).alias("train"), slope.alias("dpdt"))
    own = rows.groupBy(*pk).agg(F.array_sort(F.collect_list(cell)).alias("v"), F.max("q0").alias("q0"))
    part = lambda name: F.transform("v", lambda e: e[name]).alias(name)
    own = own.select(*pk, "q0", *[part(c) for c in ("step", "t", "dt", "on", "liq", "w", "train", "dpdt")])
    rate = F.coalesce("inj", F.lit(0.0))
    if multiplier is not None:
        inj = inj.join(multiplier, [*keys, "injector", "step"], "left")
        rate = rate * F.coalesce("g", F.lit(1.0))
    series = inj.groupBy(*keys, "injector").agg(F.array_sort(F.collect_list(F.struct("step", rate.alias("rate")))).alias("s"))
    near = mask.select(*pk, "injector").distinct().join(series, [*keys, "injector"]).groupBy(*pk).agg(F.array_sort(F.collect_list(F.struct("injector", "s"))).alias("v"))
    flat = lambda name: F.flatten(F.transform("v", lambda e: F.transform(e["s"], lambda x: x[name])))
    near = near.select(*pk, F.transform("v", lambda e: e["injector"]).alias("injectors"), F.transform("v", lambda e: F.size(e["s"])).alias("lengths"), flat("step").alias("inj_step"), flat("rate").alias("inj_rate"))
    return own.join(near, pk).join(b, keys)


def _history(row, pressed: bool) -> History:
    step = np.asarray(row.step, dtype=int)
    rates = np.zeros((len(row.injectors), int(max(step.max(initial=0), np.max(row.inj_step, initial=0))) + 1))
    rates[np.repeat(np.arange(len(row.injectors)), np.asarray(row.lengths, dtype=int)), np.asarray(row.inj_step, dtype=int)] = np.asarray(row.inj_rate, dtype=float)
    number = lambda x: np.asarray(x, dtype=float)
    return History(
        number(row.t), number(row.dt), np.asarray(row.on, dtype=bool), number(row.liq), number(row.w), np.asarray(row.train, dtype=bool),
        float(row.q0 or 0.0), rates[:, step], number(row.dpdt) if pressed else None,
    )


def _key_types(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in keys)


def producer_grams(
    prod: DataFrame, inj: DataFrame, mask: DataFrame, n_train: DataFrame, keys: list[str] | None = None,
    cfg: Settings = DEFAULTS, freeze: bool = True, taus: DataFrame | None = None, multiplier: DataFrame | None = None,
) -> DataFrame:
    """Cross products per producer and time constant: injectors, gram (row-major), rhs, yy.

    The grid spans the range of the step lengths; ``taus`` (keys, producer, taus) names other time constants.
    """
    keys = keys or ["field"]
    pk = [*keys, "producer"]
    rows = producer_matrices(prod, inj, mask, n_train, keys, cfg, multiplier)
    rows = rows.join(taus, pk) if taus is not None else rows.withColumn("taus", tau_grid(F.col("lo"), F.col("hi"), cfg.tau_grid_points))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                at = np.asarray(row.taus, dtype=float)
                for tau, g, r, yy in zip(at, *normal_equations(_history(row, False), at, freeze)):
                    out.append((*[getattr(row, c) for c in pk], float(tau), row.injectors, g.ravel(), r, float(yy)))
            yield pd.DataFrame(out, columns=[*pk, "tau", "injectors", "gram", "rhs", "yy"])

    return rows.mapInPandas(reduce, f"{_key_types(rows, pk)}, tau double, injectors array<string>, gram array<double>, rhs array<double>, yy double")


def box_least_squares(g: np.ndarray, r: np.ndarray, hi: float) -> np.ndarray:
    """Many small problems: the least f'Gf - 2 r'f over 0 <= f <= hi.  g: (B, k, k), r: (B, k); padded unknowns (zero diagonal)
    stay at zero."""
    return np.array([bounded_least_squares(gi, ri, np.full(len(ri), hi))[0] for gi, ri in zip(g, r)]).reshape(r.shape)


def solve_grams(grams: DataFrame, keys: list[str] | None = None, upper: float = 1.0) -> DataFrame:
    """Bounded couplings and SSE per (producer, tau), solved to the optimality conditions; ``slack`` says how far off they are."""
    keys = keys or ["field"]
    cols = [*keys, "producer", "tau"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fs, errs, slacks = [], [], []
            for gram, rhs, yy in zip(pdf["gram"], pdf["rhs"], pdf["yy"]):
                r = np.asarray(rhs, dtype=float)
                g = np.asarray(gram, dtype=float).reshape(len(r), len(r))
                f, slack = bounded_least_squares(g, r, np.full(len(r), upper))
                fs.append(f)
                errs.append(max(float(yy - 2 * r @ f + f @ g @ f), 0.0))
                slacks.append(slack)
            yield pdf[[*cols, "injectors"]].assign(f=fs, sse=errs, slack=slacks)

    use = grams.select(*cols, "injectors", "gram", "rhs", "yy")
    return use.mapInPandas(run, f"{_key_types(grams, cols)}, injectors array<string>, f array<double>, sse double, slack double")


def fit_matrices(rows: DataFrame, keys: list[str] | None = None, cfg: Settings = DEFAULTS, freeze: bool = True, pressed: bool = False) -> DataFrame:
    """Best time constant, couplings in [0, 1] and pressure coefficient (0 or more) of each producer of ``producer_matrices``."""
    pk = [*(keys or ["field"]), "producer"]
    points = cfg.tau_grid_points
    # small rows, much work: as many tasks as a shuffle has, which Spark does not merge
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *pk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                h = _history(row, pressed)
                if row.lo is None or not row.lo > 0 or not (h.train & (h.w > 0)).any():
                    continue  # nothing to fit
                sse, tau, x, slack = best_fit(h, float(row.lo), float(row.hi), points, freeze)
                f, j = (x[:-1], float(x[-1])) if pressed else (x, 0.0)
                out.append((*[getattr(row, c) for c in pk], tau, j, row.injectors, f, sse, slack))
            yield pd.DataFrame(out, columns=[*pk, "tau", "j", "injectors", "f", "sse", "slack"])

    return rows.mapInPandas(run, f"{_key_types(rows, pk)}, tau double, j double, injectors array<string>, f array<double>, sse double, slack double")


def fit_producer_grid(
    prod: DataFrame, inj: DataFrame, mask: DataFrame, n_train: DataFrame, keys: list[str] | None = None,
    cfg: Settings = DEFAULTS, freeze: bool = True, keep=None, redistribute: bool = True, pressure: DataFrame | None = None,
    tolerance: float = 1e-3,
) -> DataFrame:
    """Best time constant and couplings per producer: keys, producer, tau, j, injectors, f, sse, slack, settled.

    The fit is the model that predictions use: while a producer is closed, its share of an injector goes to the open ones. The
    multiplier depends on the couplings, so fits and multipliers take turns: only producers in reach of an injector whose
    multiplier still moves by more than ``tolerance`` are fitted again, near their last time constant. A group of ``keys`` whose
    largest movement has not shrunk by a tenth for ``STALE`` rounds is left as it is, with ``settled`` false; so the rounds end
    by themselves.
    Producers without a training row are not fitted. ``pressure`` (keys, producer, step, dpdt) adds a coefficient j of 0 or more,
    as in ``predict_history``. ``keep`` materialises the rounds.
    """
    ks, keep = keys or ["field"], keep or cut_lineage
    pk, pressed = [*ks, "producer"], pressure is not None
    near = keep(mask.select(*pk, "injector").distinct())
    now = keep(fit_matrices(producer_matrices(prod, inj, near, n_train, ks, cfg, None, pressure), ks, cfg, freeze, pressed))
    if not redistribute:
        return now.withColumn("settled", F.lit(True))
    used, groups = None, None  # multipliers of the last fits; movement, least movement and rounds without progress of each group
    while True:
        fresh = keep(shutin_redistribution(couplings(now, ks), prod, ks, cfg))
        last = F.lit(1.0) if used is None else F.coalesce("last", F.lit(1.0))
        both = fresh if used is None else fresh.join(used.withColumnRenamed("g", "last"), [*ks, "injector", "step"], "left")
        moved = keep(both.groupBy(*ks, "injector").agg(F.max(F.abs(F.col("g") - last)).alias("moved")))
        state = moved.groupBy(*ks).agg(F.max("moved").alias("most"))
        if groups is None:
            state = state.select(*ks, "most", F.col("most").alias("best"), F.lit(0).alias("stale"))
        else:
            state = state.join(groups.select(*ks, F.col("best").alias("_b"), F.col("stale").alias("_s")), ks)
            fell = F.col("most") < 0.9 * F.col("_b")
            state = state.select(*ks, "most", F.least("most", "_b").alias("best"), F.when(F.col("_s") >= STALE, F.col("_s")).when(fell, 0).otherwise(F.col("_s") + 1).alias("stale"))
        groups = keep(state)
        again = moved.where(F.col("moved") > tolerance).join(groups.where(F.col("stale") < STALE).select(*ks), ks, "left_semi")
        again = keep(near.join(again.select(*ks, "injector"), [*ks, "injector"], "left_semi").select(*pk).distinct())
        if again.isEmpty():
            settled = groups.select(*ks, (F.col("most") <= tolerance).alias("settled"))
            return now.join(settled, ks, "left").withColumn("settled", F.coalesce("settled", F.lit(True)))
        used = fresh
        some = producer_matrices(prod, inj, near.join(again, pk, "left_semi"), n_train, ks, cfg, used, pressure)
        reach = F.exp((F.log("hi") - F.log("lo")) / (cfg.tau_grid_points - 1))
        some = some.join(now.select(*pk, F.col("tau").alias("_tau")), pk)
        some = some.withColumns({"lo": F.greatest("lo", F.col("_tau") / reach), "hi": F.least("hi", F.col("_tau") * reach)}).drop("_tau")
        fits = fit_matrices(some, ks, cfg, freeze, pressed)
        now = keep(now.join(again, pk, "left_anti").unionByName(fits))


def couplings(fit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long form of fitted couplings: keys, injector, producer, f."""
    keys = keys or ["field"]
    z = F.explode(F.arrays_zip(F.col("injectors").alias("injector"), F.col("f").alias("f"))).alias("z")
    return fit.select(*keys, "producer", z).select(*keys, F.col("z.injector").alias("injector"), "producer", F.col("z.f").alias("f"))


def quick_sums(pairs: DataFrame) -> DataFrame:
    """Sum of couplings per producer and per injector."""
    p = pairs.groupBy("field", F.col("producer").alias("entity")).agg(F.sum("f").alias("sum_f")).withColumn("role", F.lit("P"))
    i = pairs.groupBy("field", F.col("injector").alias("entity")).agg(F.sum("f").alias("sum_f")).withColumn("role", F.lit("I"))
    return p.unionByName(i)


def candidate_members(solved: DataFrame, keys: list[str] | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Grid solutions whose SSE is within tolerance of the producer's best, numbered from the best."""
    w = Window.partitionBy(*(keys or ["field"]), "producer")
    s = solved.withColumn("_best", F.min("sse").over(w)).where(F.col("sse") <= F.col("_best") * (1 + cfg.keep_within) + 1e-12)
    return s.withColumn("member", F.row_number().over(w.orderBy("sse", "tau")) - 1).drop("_best")


def _drawn(rows: DataFrame) -> DataFrame:
    """Each producer's best couplings that also stay near ``z - u``, with the weight ``rho`` of each injector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram, rhs, z, u, rho in zip(*(pdf[c] for c in ("gram", "rhs", "z", "u", "rho"))):
                r, z, u, rho = (np.asarray(x, dtype=float) for x in (rhs, z, u, rho))
                g = np.asarray(gram, dtype=float).reshape(len(r), len(r)) + np.diag(rho / 2)
                out.append(bounded_least_squares(g, r + rho / 2 * (z - u), np.ones(len(r)), np.clip(z, 0.0, 1.0))[0])
            yield pdf[["field", "producer", "injectors", "z", "u", "rho"]].assign(f=out)

    return rows.mapInPandas(run, "field string, producer string, injectors array<string>, z array<double>, u array<double>, rho array<double>, f array<double>")


def _within(v: np.ndarray, bound: float) -> np.ndarray:
    """The nearest point to v without negative parts and with a sum of ``bound`` at most."""
    v = np.maximum(v, 0.0)
    if v.sum() <= bound:
        return v
    down = np.sort(v)[::-1]
    over = (np.cumsum(down) - bound) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(down > over)[-1]], 0.0)


def _bounded(rows: DataFrame, bound: float) -> DataFrame:
    """Each injector's couplings within its bound, and what they still differ from the producers' by (``u``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [_within(np.asarray(v, dtype=float), bound) for v in pdf["v"]]
            yield pdf[["field", "injector", "producers", "i"]].assign(z=z, u=[np.asarray(v, dtype=float) - x for v, x in zip(pdf["v"], z)])

    return rows.mapInPandas(run, "field string, injector string, producers array<string>, i array<int>, z array<double>, u array<double>")


def _both_sides(rows: DataFrame) -> DataFrame:
    """(field, primal, dual): the objective of the couplings ``z``, and of the best couplings against the prices rho u."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram, rhs, z, u, rho in zip(*(pdf[c] for c in ("gram", "rhs", "z", "u", "rho"))):
                r, z = np.asarray(rhs, dtype=float), np.asarray(z, dtype=float)
                g, price = np.asarray(gram, dtype=float).reshape(len(r), len(r)), np.asarray(rho, dtype=float) * np.asarray(u, dtype=float)
                x, _ = bounded_least_squares(g, r - 0.5 * price, np.ones(len(r)))
                out.append((float(z @ g @ z - 2 * r @ z), float(x @ g @ x - 2 * r @ x + price @ x)))
            yield pdf[["field"]].assign(primal=[x[0] for x in out], dual=[x[1] for x in out])

    sides = rows.mapInPandas(run, "field string, primal double, dual double")
    return sides.groupBy("field").agg(F.sum("primal").alias("primal"), F.sum("dual").alias("dual"))


def _bounded_at_once(rows: DataFrame, bound: float, rounds: int | None, gap: float) -> DataFrame:
    """The couplings of fields of bounded size, each in one task; none of a field whose producers share too widely for that."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["rhs"].map(len).to_numpy()
        k = int(sizes.max(initial=0))
        names = np.concatenate([np.asarray(x, dtype=object) for x in pdf["injectors"]])
        live = np.arange(k) < sizes[:, None]
        g, r, at = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k)), np.full((len(pdf), k), -1)
        at[live] = pd.factorize(names)[0]
        for j, (gram, rhs, n) in enumerate(zip(pdf["gram"], pdf["rhs"], sizes)):
            g[j, :n, :n], r[j, :n] = np.asarray(gram, dtype=float).reshape(n, n), rhs
        try:
            f, off = shared_least_squares(g, r, at, bound, *[] if rounds is None else [rounds])
        except MemoryError:
            return pd.DataFrame(columns=["field", "injector", "producer", "f", "gap", "settled"])
        off /= max(float(pdf["yy"].sum()), 1e-300)
        return pd.DataFrame({"field": pdf["field"].iloc[0], "injector": names, "producer": np.repeat(pdf["producer"].to_numpy(), sizes), "f": f[live], "gap": off, "settled": off <= gap})

    return rows.groupBy("field").applyInPandas(run, "field string, injector string, producer string, f double, gap double, settled boolean")


def injector_sum_bound(
    grams: DataFrame, bound: float = 1.0, rounds: int | None = None, gap: float = 1e-6, keep=None, wells: int = WELLS
) -> DataFrame:
    """Couplings with every injector's sum at most ``bound``: field, injector, producer, f, gap, settled.

    A field of at most ``wells`` producers and injectors is solved in one task by an interior point method, whose multipliers give its
    gap; ``rounds`` limits its steps. Its memory grows with the field times the injectors across it, as producers share injectors with
    producers near by. Larger fields, and those that share more widely, take rounds between all tasks.

    Alternating directions: producers solve alone, drawn to what their injectors allow; injectors project on their bound; the
    difference adds up to a price on each pair. A round is two small exchanges, whose groups are a producer's or an injector's
    neighbours. The couplings returned are the injectors', which keep the bound; what their objective exceeds the dual one of
    the prices by, as a share of the field's squared data, is ``gap``. It is looked at every ``LOOK`` rounds: a field is done
    when it is at most ``gap``, draws half as strongly where it fell by less than 70 percent, and is left with ``settled`` false
    where it has not fallen by a tenth for ``STALE`` looks, or after ``rounds`` if a caller names a number. Only open fields go on. ``grams`` holds one row per
    producer (its chosen tau); the cross products are computed once. ``keep`` materialises an iterate (checkpoint).
    """
    keep = keep or cut_lineage
    g = keep(grams.select("field", "producer", "injectors", "gram", "rhs", "yy").where("field is not null and producer is not null"))
    k = F.size("rhs")
    n_injectors = g.select("field", F.explode("injectors").alias("injector")).distinct().groupBy("field").agg(F.count("*").alias("m"))
    sizes = g.groupBy("field").agg(F.count("*").alias("n"), F.max(k).alias("k")).join(n_injectors, "field")
    small = sizes.where((F.col("n") <= wells) & (F.col("m") <= wells) & (F.col("n") * F.col("k") * F.col("k") <= NUMBERS)).select("field")
    small = keep(small)
    done, n = keep(_bounded_at_once(g.join(small, "field", "left_semi"), bound, rounds, gap)), 0
    g = keep(g.join(done.select("field").distinct(), "field", "left_anti"))
    if g.isEmpty():
        return done
    diagonal = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.col("gram")[i * k + i])
    slots = g.select("field", "producer", F.posexplode(F.arrays_zip(F.col("injectors").alias("injector"), diagonal.alias("d"))).alias("i", "e"))
    pairs = slots.select("field", "producer", "i", "e.injector", F.lit(0.0).alias("z"), F.lit(0.0).alias("u"), F.col("e.d").alias("d"))
    base = keep(pairs.groupBy("field", "injector").agg(F.greatest(2 * F.avg("d"), F.lit(1e-12)).alias("base")))
    pairs = keep(pairs.drop("d"))
    looks = keep(g.groupBy("field").agg(F.sum("yy").alias("yy")).withColumns({"c": F.lit(1.0), "gap": F.lit(None).cast("double"), "least": F.lit(None).cast("double"), "stale": F.lit(0)}))

    def by_producer(now, strength):
        cell = F.array_sort(F.collect_list(F.struct("i", "z", "u", "rho")))
        rows = now.join(strength, ["field", "injector"]).groupBy("field", "producer").agg(cell.alias("v"))
        part = lambda c: F.transform("v", lambda e: e[c]).alias(c)
        return g.join(rows.select("field", "producer", part("z"), part("u"), part("rho")), ["field", "producer"])

    while True:
        n += 1
        strength = base.join(looks.select("field", "c"), "field").select("field", "injector", (F.col("base") * F.col("c")).alias("rho"))
        drawn = _drawn(by_producer(pairs, strength))
        each = drawn.select("field", "producer", F.posexplode(F.arrays_zip("injectors", "f", "z", "u")).alias("i", "e"))
        value = OVER * F.col("e.f") + (1 - OVER) * F.col("e.z") + F.col("e.u")
        cell = F.array_sort(F.collect_list(F.struct("producer", "i", value.alias("v"))))
        met = each.groupBy("field", F.col("e.injectors").alias("injector")).agg(cell.alias("a"))
        part = lambda c: F.transform("a", lambda e: e[c])
        moved = _bounded(met.select("field", "injector", part("producer").alias("producers"), part("i").alias("i"), part("v").alias("v")), bound)
        pairs = moved.select("field", "injector", F.explode(F.arrays_zip("producers", "i", "z", "u")).alias("e"))
        pairs = keep(pairs.select("field", F.col("e.producers").alias("producer"), "e.i", "injector", "e.z", "e.u"))
        last = rounds is not None and n >= rounds
        if n % LOOK and not last:
            continue
        price = pairs.join(strength, ["field", "injector"]).groupBy("field", "injector").agg(F.max(F.col("rho") * F.col("u")).alias("p"))
        paid = price.groupBy("field").agg((bound * F.sum(F.greatest("p", F.lit(0.0)))).alias("paid"))
        now = _both_sides(by_producer(pairs, strength)).join(paid, "field").join(looks.withColumnsRenamed({"gap": "was"}), "field")
        now = now.withColumn("gap", F.greatest((F.col("primal") - F.col("dual") + F.col("paid")) / F.greatest("yy", F.lit(1e-300)), F.lit(0.0)))
        weak = F.col("was").isNotNull() & (F.col("gap") > 0.3 * F.col("was"))
        stale = F.when(F.col("least").isNull() | (F.col("gap") < 0.9 * F.col("least")), 0).otherwise(F.col("stale") + 1)
        now = keep(now.select("field", "yy", F.when(weak, F.col("c") / 2).otherwise(F.col("c")).alias("c"), "gap", F.least("gap", F.coalesce("least", "gap")).alias("least"), stale.alias("stale"), weak.alias("weak")))
        over = (F.col("gap") <= gap) | (F.col("stale") >= STALE) | F.lit(last)
        part = pairs.join(now.where(over).select("field", "gap", (F.col("gap") <= gap).alias("settled")), "field")
        part = keep(part.select("field", "injector", "producer", F.col("z").alias("f"), "gap", "settled"))
        done = done.unionByName(part)
        open_ = now.where(~over)
        if open_.isEmpty():
            return done
        # prices are rho u: where the strength halves, u doubles
        pairs = keep(pairs.join(open_.select("field", "weak"), "field").withColumn("u", F.when(F.col("weak"), 2 * F.col("u")).otherwise(F.col("u"))).drop("weak"))
        looks = keep(open_.drop("weak"))
        g, base = (keep(df.join(looks.select("field"), "field", "left_semi")) for df in (g, base))


# ---------------------------------------------------------------------------------------------- aquifer
def aquifer_influx(balance: DataFrame, keys: list[str], we0: Column, k1: Column, k2: Column) -> DataFrame:
    """Influx per step of a first-order tank driven by injection minus production, never negative."""
    out = exp_filter(balance, keys, -k2 * F.col("imbalance") / k1, 1.0 / k1, "we", initial=we0)
    return out.withColumn("we", F.greatest("we", F.lit(0.0)))


def aquifer_candidates(field_rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Start grid per field: influx as a share of mean training injection, rate constants, k2 = k1 / 2."""
    mean = field_rows.where(F.col("step") < F.col("n_train")).groupBy("field").agg(F.avg("inj").alias("mi"))
    cand = F.array(*[
        F.struct(F.lit(i).alias("cand"), F.lit(fr).alias("fr"), F.lit(k).alias("k1"), F.lit(k * 0.5).alias("k2"))
        for i, (fr, k) in enumerate((fr, k) for fr in cfg.we0_fractions for k in cfg.k_per_day)
    ])
    return mean.withColumn("c", F.explode(cand)).select("field", "c.cand", (F.col("c.fr") * F.col("mi")).alias("we0"), "c.k1", "c.k2")


AQUIFER_ID = "AQUIFER@I"


def fit_aquifer_grid(
    prod: DataFrame, inj: DataFrame, mask: DataFrame, n_train: DataFrame, field_rows: DataFrame, cfg: Settings = DEFAULTS,
    keep=None,
) -> DataFrame:
    """Tank parameters per field by penalised SSE over the start grid; the tank acts as one more injector."""
    keys = ["field", "cand"]
    cands = aquifer_candidates(field_rows.join(n_train, "field"), cfg)
    bal = field_rows.withColumn("imbalance", F.col("inj") - F.col("liq")).join(cands, "field")
    we = aquifer_influx(bal.repartition(*keys), keys, F.col("we0"), F.col("k1"), F.col("k2"))
    ids = cands.select("field", "cand")
    both = inj.join(ids, "field").select(*keys, "injector", "step", "inj").unionByName(
        we.select(*keys, F.lit(AQUIFER_ID).alias("injector"), "step", F.col("we").alias("inj"))
    )
    prods = prod.join(ids, "field")
    reach = mask.select("field", "injector", "producer").unionByName(
        prod.select("field", F.lit(AQUIFER_ID).alias("injector"), "producer").distinct()
    ).join(ids, "field")
    fit = fit_producer_grid(prods, both, reach, n_train.join(ids, "field"), keys, cfg, keep=keep, redistribute=False)  # no well takes over influx
    fit = (keep or (lambda d: d))(fit)
    f = couplings(fit, keys)
    rows = f.groupBy(*keys, "injector").agg(F.sum("f").alias("s"))
    over = F.when(F.col("injector") == AQUIFER_ID, F.pow(F.col("s") - 1.0, 2)).otherwise(F.pow(F.greatest(F.col("s") - 1.0, F.lit(0.0)), 2))
    pen = rows.groupBy(*keys).agg(F.sum(over).alias("pen"))
    train = prod.join(n_train, "field").where(F.col("step") < F.col("n_train"))
    var = train.groupBy("field", "producer").agg((F.var_pop("liq") * F.count(F.lit(1))).alias("v")).groupBy("field").agg(F.sum("v").alias("var"))
    sse = fit.groupBy(*keys).agg(F.sum("sse").alias("sse"))
    tot = sse.join(pen, keys).join(var, "field").join(cands, keys)
    tot = tot.withColumn("score", F.col("sse") + 10.0 * F.col("pen") * F.col("var"))
    return tot.groupBy("field").agg(F.min_by(F.struct("cand", "we0", "k1", "k2", "sse", "score"), F.struct("score", "cand")).alias("b")).select("field", "b.*")
