"""Posterior-trace analytics on ``trace(chain, gen, param, value)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import mathfns as M
from lociframe.functions.blocks import (
    attach_group_row,
    gen_block,
    running_totals,
    value_ranks,
    values_at_ranks,
)

KEYS = ["chain", "param"]
#: samples per block of the lag products; each block also sees the next lags
LAG_BLOCK = 8192
MAX_LAG = 2000
#: samples that must remain in the longest lag
MIN_PAIRS = 10


def burnin_thin(trace: DataFrame, burnin: int, sampfreq: int) -> DataFrame:
    return trace.filter((F.col("gen") > burnin) & ((F.col("gen") - burnin) % sampfreq == 0))


def shorten_param_names(trace: DataFrame, keep_labels: bool = False) -> DataFrame:
    """``kind:node:label`` to ``kind:node``, or to ``kind:label``."""
    pattern = r"^([^:]+):([^:]+):(.+)$"
    return trace.withColumn("param", F.regexp_replace("param", pattern, "$1:$3" if keep_labels else "$1:$2"))


def split_param_names(trace: DataFrame) -> DataFrame:
    """Add ``kind``, ``node`` and ``label`` from the column-name grammar."""
    parts = F.split("param", ":", 3)
    return (
        trace.withColumn("kind", F.get(parts, F.lit(0)))
        .withColumn("node", F.get(parts, F.lit(1)))
        .withColumn("label", F.get(parts, F.lit(2)))
    )


def trace_moments(trace: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return trace.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def _present(trace: DataFrame) -> DataFrame:
    """Samples with a value; a missing one takes no part in ranks and lags."""
    return trace.filter(F.col("value").isNotNull())


def _for_every_group(trace: DataFrame, keys: list[str], out: DataFrame) -> DataFrame:
    """``out`` with a row of NULLs for groups that have missing samples only."""
    return trace.select(*keys).distinct().join(out, keys, "left")


def _ranked(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with their rank and the group size ``n``."""
    trace = _present(trace)
    ranked = value_ranks(trace, keys)
    size = trace.groupBy(*keys).agg(F.count("value").alias("n"))
    return attach_group_row(ranked, size, keys, ["value"])


def _value_at(rank: Column) -> Column:
    hit = (F.col("start") <= rank) & (rank < F.col("start") + F.col("cnt"))
    return F.max(F.when(hit, F.col("value")))


def trace_quantiles(trace: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Median, and the sorted elements at floor(0.025 n) and floor(0.975 n)."""
    return _for_every_group(trace, keys, _quantiles(_ranked(trace, keys), keys))


def _quantiles(ranked: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    half = F.floor(n / 2)
    lower_half = F.when(n % 2 == 0, half - 1).otherwise(half)
    return (
        ranked.groupBy(*keys)
        .agg(
            _value_at(half).alias("_upper"),
            _value_at(lower_half).alias("_lower"),
            _value_at(F.floor(n * 0.025)).alias("q025"),
            _value_at(F.floor(n * 0.975)).alias("q975"),
        )
        .select(*keys, ((F.col("_upper") + F.col("_lower")) / 2).alias("median"), "q025", "q975")
    )


def hpd_interval(trace: DataFrame, keys: list[str] = KEYS, alpha: float = 0.05) -> DataFrame:
    """Shortest window of floor(n(1-alpha/2)) - floor(n alpha/2) ranks.

    Along equal values the window only grows, so the first rank of every
    distinct value is the only candidate start.  The window starting at the
    lower tail wins ties against all, then the smallest start.
    """
    return _for_every_group(trace, keys, _hpd(_ranked(trace, keys), keys, alpha))


def _hpd(ranked: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    n = F.col("n")
    low, high = F.floor(n * (alpha / 2)), F.floor(n * (1 - alpha / 2))
    steps = ranked.select(*keys, "n", F.col("value").alias("lo"), "start", (F.col("start") + high - low).alias("rank"))
    wanted = steps.filter(F.col("rank") < n)
    widths = values_at_ranks(ranked, wanted, keys, "value", "n").withColumn("hi", F.col("at_rank"))
    best = widths.groupBy(*keys).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "start", "lo", "hi")).alias("best"))
    tails = ranked.groupBy(*keys).agg(_value_at(low).alias("t_lo"), _value_at(high).alias("t_hi"), F.max("n").alias("n"))
    shorter = (n > 2) & (F.col("best.w") < F.col("t_hi") - F.col("t_lo"))
    return tails.join(best, keys, "left").select(
        *keys,
        F.when(shorter, F.col("best.lo")).otherwise(F.col("t_lo")).alias("hpd_lo"),
        F.when(shorter, F.col("best.hi")).otherwise(F.col("t_hi")).alias("hpd_hi"),
    )


def sample_index(trace: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add ``r``, the 1-based position of each sample in its series."""
    return running_totals(trace, keys, ["gen"], gen_block(), {"r": F.lit(1)})


def _lag_products(key_columns: list[str], max_lag: int):
    """Sums of products of centred samples at every lag, for one block."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        y = pdf["centred"].to_numpy()
        own = int(pdf["own"].sum())
        lags = min(max_lag, len(y))
        size = 1 << int(math.ceil(math.log2(2 * len(y) + 1)))
        head = np.fft.rfft(y[:own], size)
        products = np.fft.irfft(np.conj(head) * np.fft.rfft(y, size), size)[:lags]
        out = pd.DataFrame({"lag": np.arange(lags, dtype="int64"), "s": products})
        for c in key_columns:
            out[c] = pdf[c].iloc[0]
        return out[[*key_columns, "lag", "s"]]

    return block


def autocorrelation(trace: DataFrame, max_lag: int = MAX_LAG, keys: list[str] = KEYS, population_sd: bool = False) -> DataFrame:
    """Lag-k autocorrelation with divisor n-k, for lags below min(max_lag, n-10).

    A series is cut into blocks that overlap by ``max_lag`` samples; each block
    gives its share of every lag sum, and the shares are added.  Work and
    shuffle grow with n, never with n x lags.
    """
    trace = _present(trace)
    moments = trace.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.stddev_pop("value") if population_sd else F.stddev_samp("value")).alias("sd"),
    )
    block = max(LAG_BLOCK, max_lag)
    centred = attach_group_row(sample_index(trace, keys), moments.select(*keys, "mean"), keys, ["gen"]).select(
        *keys, "r", (F.col("value") - F.col("mean")).alias("centred")
    )
    at = F.floor((F.col("r") - 1) / block)
    halo = ((F.col("r") - 1) % block < max_lag) & (at > 0)
    owners = F.when(halo, F.array(at, at - 1)).otherwise(F.array(at))
    blocks = centred.select(*keys, "r", "centred", at.alias("_at"), F.explode(owners).alias("blk")).select(
        *keys, "r", "centred", "blk", (F.col("_at") == F.col("blk")).alias("own")
    )
    types = dict(trace.select(*keys).dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "lag long, s double"])
    shares = blocks.groupBy(*keys, "blk").applyInPandas(_lag_products(keys, max_lag), schema)
    sums = shares.filter("lag > 0").groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
    return (
        sums.join(moments, keys)
        .filter(F.col("lag") < F.least(F.lit(max_lag), F.col("n") - MIN_PAIRS))
        .select(*keys, "lag", (F.col("s") / (F.col("n") - F.col("lag")) / F.nullif(F.col("sd") * F.col("sd"), F.lit(0.0))).alias("rho"))
    )


def ess(trace: DataFrame, max_lag: int = MAX_LAG, keys: list[str] = KEYS, population_sd: bool = False) -> DataFrame:
    """Effective sample size by the initial positive sequence of lag pairs.

    tau = -1 + 2 sum(rho[2p] + rho[2p+1]); the sum stops before the first pair
    with 2p+1 > 10 and a negative sum.  A constant series has tau = n; series
    of at most 11 samples give NULL.
    """
    acf = autocorrelation(trace, max_lag, keys, population_sd)
    first_lag = acf.groupBy(*keys).agg(F.max(F.when(F.col("lag") == 1, F.col("rho"))).alias("rho1"))
    pairs = (
        acf.groupBy(*keys, F.floor(F.col("lag") / 2).alias("p"))
        .agg(F.sum("rho").alias("pair"), F.count_if(F.col("lag") % 2 == 1).alias("odd"))
        .filter("odd = 1")
        .withColumn("pair", F.when(F.col("p") == 0, F.col("pair") + 1).otherwise(F.col("pair")))
    )
    so_far = Window.partitionBy(*keys).orderBy("p")  # at most max_lag/2 pairs per series
    stopped = F.max(((F.col("p") * 2 + 1 > 10) & (F.col("pair") < 0)).cast("int")).over(so_far)
    tau = pairs.withColumn("_stop", stopped).filter("_stop = 0").groupBy(*keys).agg((2 * F.sum("pair") - 1).alias("tau"))
    sd = F.stddev_pop("value") if population_sd else F.stddev_samp("value")
    base = trace.groupBy(*keys).agg(F.count("value").alias("n"), (sd / (F.abs(F.avg("value")) + 1) < 1e-9).alias("flat"))
    joined = base.join(tau, keys, "left").join(first_lag, keys, "left")
    tau_used = F.when(F.col("flat"), F.col("n").cast("double")).when(F.col("n") > MIN_PAIRS + 1, F.col("tau"))
    return joined.select(
        *keys,
        tau_used.alias("tau"),
        (F.col("n") / tau_used).alias("ess"),
        (1 / tau_used).alias("eff"),
        F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("rho1")).alias("rho1"),
    )


STATISTICS = ("mean", "median", "sd", "min", "max", "q025", "q975", "hpd_lo", "hpd_hi", "ess", "eff", "rho1")


def trace_summary(trace: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The twelve-statistic table, one row per parameter; values are ranked once."""
    return _summary(trace, keys).select(*keys, *STATISTICS)


def _summary(trace: DataFrame, keys: list[str]) -> DataFrame:
    ranked = _ranked(trace, keys)
    return (
        trace_moments(trace, keys)
        .join(_quantiles(ranked, keys), keys, "left")
        .join(_hpd(ranked, keys), keys, "left")
        .join(ess(trace, keys=keys), keys, "left")
    )


def multi_chain_summary(trace: DataFrame) -> DataFrame:
    """(pooled, chain, param, n, the twelve statistics): a row for each chain, and with ``pooled`` one for all chains.

    The pooled series of a parameter is its chains one after the other, by name and a null chain first; its ess, eff
    and rho1 are those of that series.  A null chain is a chain like others and counts once in the pool.
    """
    series = F.concat(F.when(F.col("chain").isNull(), F.lit("n")).otherwise(F.lit("c")), F.coalesce("chain", F.lit("")))
    own = trace.select(series.alias("series"), "param", "gen", "value")
    spans = own.groupBy("param", "series").agg((F.max("gen") - F.least(F.min("gen"), F.lit(0)) + 1).alias("span"))
    before = Window.partitionBy("param").orderBy(F.desc(F.col("series").startswith("n")), "series").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum("span").over(before), F.lit(0))).drop("span")  # a row a chain
    # chains are few and hold many samples each, so the samples stay where they are
    placed = own.join(offsets, ["param", "series"])
    copies = F.array(
        F.struct(F.col("series"), F.col("gen")), F.struct(F.lit("p").alias("series"), (F.col("gen") + F.col("offset")).alias("gen"))
    )
    both = placed.select("param", "value", F.explode(copies).alias("c")).select("c.series", "param", "c.gen", "value")
    out = _summary(both, ["series", "param"])
    chain = F.when(F.col("series").startswith("c"), F.expr("substring(series, 2)"))
    return out.select((F.col("series") == "p").alias("pooled"), chain.alias("chain"), "param", "n", *STATISTICS)


def running_mean(trace: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    totals = running_totals(trace, keys, ["gen"], gen_block(), {"_n": F.lit(1), "_s": F.col("value")})
    return totals.withColumn("rmean", F.col("_s") / F.col("_n")).drop("_n", "_s")


def running_species_posterior(samples: DataFrame, max_species: int) -> DataFrame:
    """Running P(#species = k) after each sample, zeros included.

    ``samples(chain, gen, n_species)``; ``max_species`` is the number of
    putative species of the analysis.
    """
    hits = {f"p{k}": (F.col("n_species") == k).cast("long") for k in range(1, max_species + 1)}
    totals = running_totals(samples, ["chain"], ["gen"], gen_block(), {"_n": F.lit(1), **hits})
    cells = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"p{k}") / F.col("_n")).alias("p")) for k in range(1, max_species + 1)])
    return totals.select("chain", "gen", F.explode(cells).alias("c")).select("chain", "gen", "c.k", "c.p")


def total_loglik(locus_logl: DataFrame, beta: float = 1.0) -> DataFrame:
    return locus_logl.groupBy("gen").agg((F.sum("logl") / F.lit(float(beta))).alias("lnl"))


def marginal_likelihood(power_posterior: DataFrame, weights: DataFrame) -> DataFrame:
    """log M = half the weighted sum of the mean log likelihood at each power."""
    means = power_posterior.groupBy("beta_idx").agg(F.avg("lnl").alias("e_lnl"))
    return means.join(weights, "beta_idx").agg((0.5 * F.sum(F.col("weight") * F.col("e_lnl"))).alias("log_m"))


def bayes_factor(first: DataFrame, second: DataFrame) -> DataFrame:
    """Difference of two one-row evidence tables."""
    a, b = first.select(F.col("log_m").alias("m1")), second.select(F.col("log_m").alias("m2"))
    return a.crossJoin(F.broadcast(b)).select((F.col("m1") - F.col("m2")).alias("log_bf"))


def scaled_tau(trace: DataFrame) -> DataFrame:
    """``r_tau = tau / mu_bar`` per sample."""
    mu = trace.filter("param = 'mu_bar'").select("chain", "gen", F.col("value").alias("mu"))
    taus = trace.filter("param like 'tau:%'")
    return taus.join(mu, ["chain", "gen"]).select(
        "chain", "gen", F.concat(F.lit("r_"), F.col("param")).alias("param"), (F.col("value") / F.col("mu")).alias("value")
    )


def w_to_m(trace: DataFrame, pops: DataFrame) -> DataFrame:
    """``M:i->j = W:i->j * theta_j / 4``; a linked theta comes from its master.

    ``pops(node, linked_to)`` names nodes as in the columns.  Without a theta
    for the target the value is NULL.
    """
    rates = trace.filter("param like 'W:%'").withColumn("node", F.regexp_extract("param", r"^W:[^:]*?->([^:]+)", 1))
    masters = F.broadcast(pops.select("node", F.coalesce("linked_to", "node").alias("master")))  # one species tree
    thetas = trace.filter("param like 'theta:%'").select(
        "chain", "gen", F.regexp_extract("param", r"^theta:([^:]+)", 1).alias("master"), F.col("value").alias("theta")
    )
    return (
        rates.join(masters, "node", "left")
        .withColumn("master", F.coalesce("master", "node"))
        .join(thetas, ["chain", "gen", "master"], "left")
        .select(
            "chain",
            "gen",
            F.regexp_replace("param", "^W:", "M:").alias("param"),
            (F.col("value") * F.col("theta") / 4).alias("value"),
        )
    )


def node_annotation(summary: DataFrame, pops: DataFrame) -> DataFrame:
    """Mean age, age interval, theta and branch length of species-tree nodes.

    ``summary`` is :func:`trace_summary` of one chain; parameters are
    ``tau:<node>`` and ``theta:<node>``.  ``pops(node_id, parent_id, label,
    linked_to)``; tips have age 0.
    """
    stat = lambda kind, **cols: summary.filter(F.col("param").startswith(f"{kind}:")).select(
        F.split("param", ":")[1].cast("int").alias("node_id"), *[F.col(c).alias(a) for a, c in cols.items()]
    )
    ages = stat("tau", age="mean", lo="hpd_lo", hi="hpd_hi")
    thetas = stat("theta", theta="mean").withColumnRenamed("node_id", "master")
    nodes = pops.join(ages, "node_id", "left").withColumn("master", F.coalesce("linked_to", "node_id"))
    nodes = nodes.join(thetas, "master", "left").withColumn("age", F.coalesce("age", F.lit(0.0)))
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("age").alias("parent_age"))
    return nodes.join(parents, "parent_id", "left").select(
        "node_id", "label", "age", "lo", "hi", "theta", (F.col("parent_age") - F.col("age")).alias("length")
    )


def union_traces(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Continue a run: samples already present in ``earlier`` are not repeated."""
    last = earlier.groupBy("chain").agg(F.max("gen").alias("_last"))
    fresh = later.join(last, "chain", "left").filter(F.col("_last").isNull() | (F.col("gen") > F.col("_last")))
    return earlier.unionByName(fresh.drop("_last"))


def migration_model_posterior(active_rates: DataFrame) -> dict[str, DataFrame]:
    """Posterior of the set of active migration pairs.

    ``active_rates(gen, pair, rate)`` has one row per active pair, and a row
    with NULL ``pair`` for a sample without any.  Returns ``models`` (model, n,
    p), ``rates`` (model, pair, mean_rate) and ``sizes`` (n_pairs, n, p).
    """
    samples = active_rates.groupBy("gen").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("pair"))).alias("model"), F.count("pair").alias("n_pairs")
    )
    total = samples.agg(F.count(F.lit(1)).alias("total"))
    share = lambda df: df.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total")).drop("total")
    models = share(samples.groupBy("model", "n_pairs").agg(F.count(F.lit(1)).alias("n")))
    sizes = share(samples.groupBy("n_pairs").agg(F.count(F.lit(1)).alias("n")))
    rates = (
        active_rates.filter("pair is not null")
        .join(samples.select("gen", "model"), "gen")
        .groupBy("model", "pair")
        .agg(F.avg("rate").alias("mean_rate"))
    )
    return {"models": models, "rates": rates, "sizes": sizes}


def migration_count_summary(migcounts: DataFrame) -> DataFrame:
    """Total and mean migrations per (pair, locus) and, with NULL locus, per pair."""
    return (
        migcounts.withColumn("pair", F.concat_ws("->", "source", "target"))
        .rollup("pair", "locus")
        .agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.grouping("pair").alias("g"))
        .filter("g = 0")
        .drop("g")
    )


def prior_log_density(values: DataFrame, dist: str, a: float, b: float) -> DataFrame:
    return values.withColumn("lnp", M.log_pdf(dist, F.col("value"), F.lit(float(a)), F.lit(float(b))))


def posterior_vs_prior(posterior: DataFrame, prior: DataFrame, on: str) -> DataFrame:
    return posterior.join(prior.select(on, "prior"), on, "left")
