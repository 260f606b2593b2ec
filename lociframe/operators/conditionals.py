"""Posterior marginals as mixtures of per-sample conditional distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import mathfns as M
from lociframe.functions.blocks import attach_group_row
from lociframe.operators.trace import KEYS, ess

#: groups held in one task before their partial grids are written out
HELD_GROUPS = 2000


def checked_conditionals(cond: DataFrame, dist: str) -> DataFrame:
    """Drop missing rows; half-missing or out-of-range rows fail the job."""
    a, b = F.col("a1"), F.col("b1")
    half = a.isNull() != b.isNull()
    bad = half | (a <= 0) | (b <= 0)
    if dist == "invgamma":
        bad = bad | (a <= 2)
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("bad conditional for "), F.col("param"))).cast("double"))
    return cond.withColumn("a1", F.coalesce(checked, a)).filter("a1 is not null")


def _mean_var(dist: str, a: Column, b: Column) -> tuple[Column, Column]:
    if dist == "gamma":
        return a / b, a / (b * b)
    if dist == "invgamma":
        return b / (a - 1), b * b / ((a - 1) * (a - 1) * (a - 2))
    s = a + b
    return a / s, a * b / (s * s * (s + 1))


def _log_constant(dist: str, a: Column, b: Column) -> Column:
    if dist == "beta":
        return M.lgamma(a + b) - M.lgamma(a) - M.lgamma(b)
    return a * F.log(b) - M.lgamma(a)


def _density(dist, const, a, b, y):
    """Density of each sample (rows) at each grid point (columns); the exponents of all are one product of matrices."""
    if dist == "gamma":
        powers, one, two = a - 1, np.log(y), -y
    elif dist == "invgamma":
        powers, one, two = -(a + 1), np.log(y), -1 / y
    else:
        powers, one, two, b = a - 1, np.log(y), np.log(1 - y), b - 1
    exponents = np.column_stack([const, powers, b]) @ np.vstack([np.ones_like(y), one, two])
    return np.exp(exponents, out=exponents)


def _centres(lo: float, width: float, bins: int) -> np.ndarray:
    return lo + (np.arange(bins) + 0.5) * width


def _grid_sums(share, keys: list[str]):
    """mapInPandas body: add ``share(group)`` vectors per key over a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for key, total in held.items():
                yield pd.DataFrame({**dict(zip(keys, key)), "bin": np.arange(len(total)), "s": total})
            held.clear()

        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                vector = sum(share(group.iloc[i : i + 512]) for i in range(0, len(group), 512))
                held[key] = held[key] + vector if key in held else vector
            if len(held) > HELD_GROUPS:
                yield from flush()
        yield from flush()

    return run


def grid_intervals(cells: DataFrame, keys: list[str], bins: int, tail: float) -> DataFrame:
    """Highest-density and equal-tail limits from ``cells(keys, bin, y, pdf)``.

    ``bins`` cells per group, ordered by ``bin``.  The density interval follows
    a two-pointer scan: from the left end, then from each further cell up to
    the mode, windows of at most 1 - tail mass; strictly shorter ones win.
    """
    along = Window.partitionBy(*keys).orderBy("bin")  # a fixed number of bins
    rows = cells.withColumn("cdf", F.sum("pdf").over(along))
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", "y", "pdf", "cdf"))).alias("g"),
    )
    packed = packed.select(
        *keys,
        F.transform("g", lambda c: c["y"]).alias("y"),
        F.transform("g", lambda c: c["cdf"]).alias("cdf"),
        (F.array_position(F.transform("g", lambda c: c["pdf"]), F.array_max(F.transform("g", lambda c: c["pdf"]))) - 1).alias("mode"),
    )
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bins.bit_length()))])
    at = lambda i: F.try_element_at(F.col("cdf"), (i + 1).cast("int"))

    def break_after(left):
        # first u >= 1 with cdf[u] - cdf[left] > 1 - tail; bins when there is none
        found = F.aggregate(
            steps,
            F.lit(0),
            lambda n, s: F.when((n + s <= bins) & (at(n + s - 1) - at(left) <= 1 - tail), n + s).otherwise(n),
        )
        return F.greatest(found, F.lit(1))

    limits = packed.withColumn("brk", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), break_after))
    brk = lambda i: F.get(F.col("brk"), i)
    candidates = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.least(F.greatest(F.col("mode"), F.lit(1)), F.lit(bins - 2)).cast("int")),
            lambda l: F.struct((brk(l - 1) - l).alias("w"), l.alias("l"), brk(l - 1).alias("u"), brk(l).alias("next")),
        ),
        lambda c: (c["l"] <= F.col("mode")) & (c["u"] < bins) & (c["next"] > c["u"]),
    )
    start = F.when(brk(F.lit(0)) > 1, brk(F.lit(0)) - 1).otherwise(F.lit(bins - 1))
    chosen = limits.withColumn("best", F.array_min(candidates)).withColumn("u0", start)
    shorter = F.col("best").isNotNull() & (F.col("best.w") < F.col("u0"))
    y = lambda i: F.get(F.col("y"), i.cast("int"))
    first_above = F.array_position(F.transform("cdf", lambda c: c > tail / 2), F.lit(True))
    below = F.size(F.filter("cdf", lambda c: c < 1 - tail / 2))
    return chosen.select(
        *keys,
        y(F.when(shorter, F.col("best.l")).otherwise(F.lit(0))).alias("hpd_lo"),
        y(F.when(shorter, F.col("best.u")).otherwise(F.col("u0"))).alias("hpd_hi"),
        y(F.when(first_above > 0, first_above - 1).otherwise(F.lit(bins - 1))).alias("et_lo"),
        y(F.greatest(below - 1, F.lit(0))).alias("et_hi"),
    )


def _efficiencies(c: Column, tau: Column) -> list[Column]:
    return [c.alias("c"), (c / tau).alias("eff_u"), (1 / (1 + (tau - 1) / c)).alias("eff_y")]


def conditional_to_marginal(cond: DataFrame, dist: str, bins: int = 1000, tail: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Mean, sd, intervals and efficiency of each parameter's marginal.

    The grid spans mean +- 4 sd; every sample adds its density to the bins
    inside its own task, so only one vector per group and task is shuffled.
    """
    names = cond.select(*keys).distinct()
    good = checked_conditionals(cond, dist)
    m, v = _mean_var(dist, F.col("a1"), F.col("b1"))
    samples = good.withColumn("value", m).withColumn("v", v)
    stats = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("vm"), F.avg("v").alias("mv")
    )
    stats = stats.withColumn("sd", F.sqrt(F.col("vm") + F.col("mv")))
    lo = F.greatest(F.col("mean") - 4 * F.col("sd"), F.lit(0.0))
    hi = F.col("mean") + 4 * F.col("sd")
    hi = F.least(hi, F.lit(1.0)) if dist == "beta" else hi
    grid = stats.select(*keys, "n", lo.alias("lo"), ((hi - lo) / bins).alias("width"))
    fed = attach_group_row(
        good.select(*keys, "gen", "a1", "b1", _log_constant(dist, F.col("a1"), F.col("b1")).alias("const")), grid, keys, ["gen"]
    ).select(*keys, "a1", "b1", "const", "lo", "width")

    def share(g: pd.DataFrame) -> np.ndarray:
        y = _centres(g["lo"].iloc[0], g["width"].iloc[0], bins)
        return _density(dist, g["const"].to_numpy(), g["a1"].to_numpy(), g["b1"].to_numpy(), y).sum(axis=0)

    types = dict(cond.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "bin long, s double"])
    cells = (
        fed.mapInPandas(_grid_sums(share, keys), schema)
        .groupBy(*keys, "bin")
        .agg(F.sum("s").alias("s"))
        .join(grid, keys)
        .select(
            *keys,
            "bin",
            (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("y"),
            (F.col("s") * F.col("width") / F.col("n")).alias("pdf"),
        )
    )
    intervals = grid_intervals(cells, keys, bins, tail)
    tau = ess(samples.select(*keys, "gen", "value"), keys=keys, population_sd=True).select(*keys, "tau")
    c = F.when(F.sqrt("vm") < 1e-10, F.lit(float("inf"))).otherwise((F.col("mv") + F.col("vm")) / F.col("vm"))
    done = stats.join(intervals, keys).join(tau, keys, "left")
    out = done.select(*keys, "mean", "sd", "et_lo", "et_hi", "hpd_lo", "hpd_hi", *_efficiencies(c, F.col("tau")))
    return names.join(out, keys, "left")


def conditional_to_marginal_product(
    cond_theta: DataFrame, cond_w: DataFrame, pairs: DataFrame, dist: str, bins: int = 60, tail: float = 0.05
) -> DataFrame:
    """Marginal of M = theta * w / 4 on a grid of products of theta/2 and w/2.

    ``pairs(param, theta, w)`` names the product and its two conditionals; w is
    always gamma.  A task multiplies its samples' two density tables, so a
    sample costs 2 x bins densities rather than bins squared.
    """
    keys = ["chain", "param"]
    theta = checked_conditionals(cond_theta, dist).select(
        "chain", "gen", F.col("param").alias("theta"), F.col("a1").alias("a"), F.col("b1").alias("b")
    )
    w = checked_conditionals(cond_w, "gamma").select(
        "chain", "gen", F.col("param").alias("w"), F.col("a1").alias("aw"), F.col("b1").alias("bw")
    )
    pairs = F.broadcast(pairs)  # the products of one analysis
    both = w.join(pairs, "w").join(theta, ["chain", "gen", "theta"])
    m1, v1 = _mean_var(dist, F.col("a"), F.col("b"))
    m2, v2 = _mean_var("gamma", F.col("aw"), F.col("bw"))
    u = both.select(*keys, "gen", "a", "b", "aw", "bw", m1.alias("m1"), v1.alias("v1"), m2.alias("m2"), v2.alias("v2"))
    u = u.withColumn("value", F.col("m1") * F.col("m2"))
    second = (F.col("v1") + F.col("m1") * F.col("m1")) * (F.col("v2") + F.col("m2") * F.col("m2"))
    stats = u.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("m1").alias("mean1"), F.avg("m2").alias("mean2"), F.avg("value").alias("meany"),
        (F.var_pop("m1") + F.avg("v1")).alias("var1"), (F.var_pop("m2") + F.avg("v2")).alias("var2"),
        F.var_pop("value").alias("vmy"), F.avg(second).alias("meany2"),
    )
    grid = stats
    for i in ("1", "2"):
        mean, sd = F.col(f"mean{i}") / 2, F.sqrt(F.col(f"var{i}") / 4)
        lo = F.greatest(mean - 4 * sd, F.lit(0.0))
        grid = grid.withColumn(f"lo{i}", lo).withColumn(f"width{i}", (mean + 4 * sd - lo) / bins)
    limits = grid.select(*keys, "n", "lo1", "width1", "lo2", "width2")
    # densities of theta/2 and w/2: rescale b so the shared densities apply
    half_b = F.col("b") / 2 if dist == "invgamma" else F.col("b") * 2
    fed = u.withColumn("b", half_b).withColumn("bw", F.col("bw") * 2)
    fed = fed.withColumn("const1", _log_constant(dist, F.col("a"), F.col("b")))
    fed = fed.withColumn("const2", _log_constant("gamma", F.col("aw"), F.col("bw")))
    fed = attach_group_row(fed, limits, keys, ["gen"]).select(
        *keys, "a", "b", "aw", "bw", "const1", "const2", "lo1", "width1", "lo2", "width2"
    )

    def share(g: pd.DataFrame) -> np.ndarray:
        col = lambda c: g[c].to_numpy()
        y1 = _centres(g["lo1"].iloc[0], g["width1"].iloc[0], bins)
        y2 = _centres(g["lo2"].iloc[0], g["width2"].iloc[0], bins)
        p1 = _density(dist, col("const1"), col("a"), col("b"), y1)
        p2 = _density("gamma", col("const2"), col("aw"), col("bw"), y2)
        return (p1.T @ p2).ravel()

    sums = fed.mapInPandas(_grid_sums(share, keys), "chain string, param string, bin long, s double")
    cells = sums.groupBy(*keys, "bin").agg(F.sum("s").alias("s")).join(limits, keys)
    y1 = F.col("lo1") + (F.floor(F.col("bin") / bins) + 0.5) * F.col("width1")
    y2 = F.col("lo2") + (F.col("bin") % bins + 0.5) * F.col("width2")
    cells = cells.select(
        *keys, "bin", (y1 * y2).alias("y"), (F.col("s") * F.col("width1") * F.col("width2") / F.col("n")).alias("pdf")
    )
    by_product = Window.partitionBy(*keys).orderBy("y", "bin")  # bins x bins cells
    cells = cells.withColumn("bin", (F.row_number().over(by_product) - 1).cast("long"))
    intervals = grid_intervals(cells, keys, bins * bins, tail)
    tau = ess(u.select(*keys, "gen", "value"), population_sd=True).select(*keys, "tau")
    variance = (F.col("meany2") - F.col("meany") * F.col("meany")) / 16
    c = F.when(F.sqrt("vmy") < 1e-10, F.lit(float("inf"))).otherwise(variance / (F.col("vmy") / 16))
    names = cond_w.select("chain", F.col("param").alias("w")).distinct().join(pairs, "w").select(*keys)
    out = stats.join(intervals, keys).join(tau, keys, "left").select(
        *keys,
        (F.col("meany") / 4).alias("mean"), F.sqrt(variance).alias("sd"),
        F.col("mean2").alias("w_mean"), F.sqrt("var2").alias("w_sd"),
        "et_lo", "et_hi", "hpd_lo", "hpd_hi", *_efficiencies(c, F.col("tau")),
    )
    return names.join(out, keys, "left")


def unmatched_iterations(cond_theta: DataFrame, cond_w: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chain, param, gen, side): iterations of a product that have a conditional of one factor only.

    ``side`` is the factor that is there, ``theta`` or ``w``.  ``conditional_to_marginal_product`` uses the others.
    """
    pairs = F.broadcast(pairs)  # the products of one analysis
    one = cond_theta.select("chain", "gen", F.col("param").alias("theta")).join(pairs, "theta").select("chain", "param", "gen").distinct()
    two = cond_w.select("chain", "gen", F.col("param").alias("w")).join(pairs, "w").select("chain", "param", "gen").distinct()
    both = one.withColumn("_t", F.lit(True)).join(two.withColumn("_w", F.lit(True)), ["chain", "param", "gen"], "full")
    side = F.when(F.col("_t").isNull(), F.lit("w")).otherwise(F.lit("theta"))
    return both.filter("_t is null or _w is null").select("chain", "param", "gen", side.alias("side"))
