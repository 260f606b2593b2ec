"""Undo label switching of bidirectional gene-flow events in a trace.

Each sample is either kept or mirrored: (phi_x, phi_y, theta_x, theta_y) or
(1-phi_x, 1-phi_y, theta_y, theta_x).  Rounds of "summarise the sample, then
put every row on its better side" run until no row moves.  Only the summary of
a round (a dozen numbers for each chain and event) reaches the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

#: fitted parameters stay inside these bounds
FIT_BOUNDS = (0.5, 99999.0)
CLIP = 1e-9
CHECKPOINT_EVERY = 10
#: least variance of a parameter, so that constant columns and single samples have a fit
LEAST_VAR = 1e-12


def _psi(x: float) -> tuple[float, float]:
    """Digamma and trigamma for x > 0."""
    d = t = 0.0
    while x < 10:
        d -= 1 / x
        t += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    d += math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))
    t += 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))
    return d, t


def _maximise(gradient, start: tuple[float, float]) -> tuple[float, float]:
    """Coordinate-wise bisection of a concave, box-bounded two-parameter fit."""
    lo, hi = FIT_BOUNDS
    x = [min(max(v, lo), hi) for v in start]
    for _ in range(500):
        old = list(x)
        for i in (0, 1):
            low, high = lo, hi

            def slope(v, i=i):
                y = list(x)
                y[i] = v
                return gradient(*y)[i]

            if slope(low) <= 0:
                x[i] = low
            elif slope(high) >= 0:
                x[i] = high
            else:
                for _ in range(80):
                    mid = math.sqrt(low * high)
                    low, high = (mid, high) if slope(mid) > 0 else (low, mid)
                x[i] = math.sqrt(low * high)
        if all(abs(a - b) <= 1e-9 * (1 + abs(b)) for a, b in zip(x, old)):
            break
    return x[0], x[1]


def fit_beta(mean_log: float, mean_log1m: float, start: tuple[float, float]) -> tuple[float, float]:
    def gradient(p, q):
        s = _psi(p + q)[0]
        return s - _psi(p)[0] + mean_log, s - _psi(q)[0] + mean_log1m

    return _maximise(gradient, start)


def fit_gamma(mean: float, mean_log: float, start: tuple[float, float]) -> tuple[float, float]:
    def gradient(a, b):
        return math.log(b) - _psi(a)[0] + mean_log, a / b - mean

    return _maximise(gradient, start)


def _moment_beta(m: float, v: float) -> tuple[float, float]:
    z = m * (1 - m) / v - 1 if v > 0 else 0.0
    z = z if z > 0 else 0.01
    return m * z, (1 - m) * z


def _gain(method: str, cur: list[Column], new: list[Column]) -> Column:
    """Score of ``new`` minus score of ``cur`` by the fit in a row's columns; positive means switch.

    Parameters that an event does not have are null and add nothing.
    """
    terms = []
    for i, (p, q) in enumerate(zip(cur, new)):
        a, b = F.col(f"fit_a{i}"), F.col(f"fit_b{i}")
        if method == "cog0":
            term = (p - q) * (p + q - 2 * a)
        elif method == "cogn":
            term = (p - q) * (p + q - 2 * a) / (2 * b)
        elif i < 2:
            term = (a - 1) * F.log(q / p) + (b - 1) * F.log((1 - q) / (1 - p))
        else:
            term = (a - 1) * F.log(q / p) - b * (q - p)
        terms.append(F.coalesce(term, F.lit(0.0)))
    return reduce(lambda x, y: x + y, terms)


def _fit(method: str, s: dict, old: list | None, size: int) -> list[tuple[float, float]]:
    """Two numbers for each parameter: mean and variance, or those of a beta (phi) or gamma (theta) distribution."""
    mean, var = [s[f"m{i}"] for i in range(size)], [max(s[f"v{i}"] or 0.0, LEAST_VAR) for i in range(size)]
    if method in ("cog0", "cogn"):
        return list(zip(mean, var))
    if old is None:
        return [_moment_beta(mean[i], var[i]) if i < 2 else (mean[i] ** 2 / var[i], mean[i] / var[i]) for i in range(size)]
    return [fit_beta(s[f"l{i}"], s[f"k{i}"], old[i]) if i < 2 else fit_gamma(mean[i], s[f"l{i}"], old[i]) for i in range(size)]


def label_switch(
    trace: DataFrame, bdi_events: DataFrame, method: str = "beta_gamma", max_rounds: int = 100
) -> tuple[DataFrame, DataFrame]:
    """The trace with all samples on one side, and (chain, event, n_reflected): the samples mirrored.

    ``bdi_events(event, phi_x, phi_y, theta_x, theta_y)`` names the parameters of each bidirectional event; without
    both thetas, or where they are linked, leave them null.  Chains and events are treated apart but together: one
    aggregate a round gives the sufficient statistics of every (chain, event), whose fits, a row each, go back to the
    samples as a small table.  A (chain, event) stops when none of its rows moves.  Constant columns and single samples
    are fitted with a least variance; a (chain, event) without samples of each parameter stays as it is.
    """
    spark = trace.sparkSession
    named = {}  # the events of an analysis, a handful
    for e in bdi_events.collect():
        thetas = [e["theta_x"], e["theta_y"]] if e["theta_x"] and e["theta_y"] else []
        named[e["event"]] = [e["phi_x"], e["phi_y"], *thetas]
    every = [p for names in named.values() for p in names]
    if len(set(every)) < len(every):
        raise ValueError("a parameter belongs to two events")
    slots = [(e, p, i) for e, names in named.items() for i, p in enumerate(names)]
    slots = spark.createDataFrame(slots, "event string, param string, slot int")
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1 - CLIP)), F.lit(CLIP)))
    in_range = lambda c: F.when((c < 0) | (c > 1), F.raise_error(F.lit("phi out of range")).cast("double")).otherwise(c)
    group = ["chain", "event"]
    wide = (
        trace.join(F.broadcast(slots), "param").groupBy(*group, "gen")
        .agg(*[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"p{i}") for i in range(4)])
    )
    wide = wide.withColumn("p0", clip(in_range(F.col("p0")))).withColumn("p1", clip(in_range(F.col("p1"))))
    start = F.coalesce((F.col("p0") >= 0.5) & (F.col("p1") >= 0.5), F.lit(False))
    state = cut_lineage(wide.withColumn("side", start))
    plain = [F.col(f"p{i}") for i in range(4)]
    mirror = [1 - plain[0], 1 - plain[1], plain[3], plain[2]]
    on_side = lambda flag: [F.when(flag, m).otherwise(p) for p, m in zip(plain, mirror)]

    def summarise(df: DataFrame, moved: Column) -> dict:
        vals = on_side(F.col("side"))
        aggs = [F.avg(v).alias(f"m{i}") for i, v in enumerate(vals)]
        aggs += [F.var_samp(v).alias(f"v{i}") for i, v in enumerate(vals)]
        aggs += [F.avg(F.log(v)).alias(f"l{i}") for i, v in enumerate(vals)]
        aggs += [F.avg(F.log(1 - vals[i])).alias(f"k{i}") for i in (0, 1)]
        aggs += [F.count_if(moved).alias("moved"), F.count_if("side").alias("mirrored")]
        return {(r["chain"], r["event"]): r.asDict() for r in df.groupBy(*group).agg(*aggs).collect()}

    size = lambda g: len(named[g[1]])
    summary = summarise(state, F.lit(False))
    fits = {g: _fit(method, s, None, size(g)) for g, s in summary.items() if all(s[f"m{i}"] is not None for i in range(size(g)))}
    active = set(fits)
    columns = ", ".join(f"fit_a{i} double, fit_b{i} double" for i in range(4))

    def small(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, f"chain_ string, event_ string, {schema}"))  # a row for each chain and event

    same = F.expr("chain <=> chain_ AND event = event_")
    for round_no in range(max_rounds):
        if not active:
            break
        rows = [(*g, *[x for pair in [*fits[g], *[(None, None)] * (4 - size(g))] for x in pair]) for g in active]
        fitted = state.join(small(rows, columns), same, "left")
        flip = F.col("event_").isNotNull() & (_gain(method, on_side(F.col("side")), on_side(~F.col("side"))) > 0)
        state = fitted.withColumn("moved", flip).withColumn("side", F.col("side") != F.col("moved"))
        state = state.select(*group, "gen", *plain, "side", "moved")
        if round_no % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            state = cut_lineage(state)
        summary = summarise(state, F.col("moved"))
        state = state.drop("moved")
        active = {g for g in active if summary[g]["moved"]}
        fits |= {g: _fit(method, summary[g], fits[g], size(g)) for g in active}
    names = F.array(*[F.struct(F.lit(i).alias("slot"), v.alias("fixed")) for i, v in enumerate(on_side(F.col("side")))])
    done = state.join(small([(*g, True) for g in fits], "known boolean"), same)
    cells = done.select("chain", "event", "gen", F.explode(names).alias("c")).select("chain", "event", "gen", "c.slot", "c.fixed")
    fixed = cells.join(F.broadcast(slots), ["event", "slot"]).select("chain", "gen", "param", "fixed").alias("f")
    joined = trace.alias("t").join(fixed, F.expr("t.chain <=> f.chain AND t.gen = f.gen AND t.param = f.param"), "left")
    out = joined.select(*[F.coalesce("f.fixed", "t.value").alias("value") if c == "value" else F.col(f"t.{c}") for c in trace.columns])
    counts = [(*g, s["mirrored"] if g in fits else 0) for g, s in summary.items()]
    return out, spark.createDataFrame(counts, "chain string, event string, n_reflected long")
