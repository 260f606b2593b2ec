"""Likelihood of given gene trees, in bulk.

A gene tree becomes one row: an array of nodes, children first, each with its
transition matrices.  A pattern meets the trees of its locus in one join, and
pruning is a fold over the array, so tree height adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import states

#: patterns of one locus that share one copy of the locus's trees
PATTERN_BLOCK = 4096
#: sampled trees about of one locus that one task evaluates on a block of patterns
TREE_BLOCK = 256
#: models that are sent to every task, and matrices of one stacked product
REGISTRY_MODELS, MATRIX_ROWS = 1000, 1024
_FACTORS = ("lam", "left", "right")


def _matrix(entries: list[list[Column]]) -> Column:
    return F.array(*[e for row in entries for e in row])


def _identity(n: int) -> Column:
    return F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(n) for j in range(n)])


def _jc69(t: Column) -> Column:
    e = F.expm1(-4 * t / 3)
    return _matrix([[1 + 0.75 * e if i == j else -0.25 * e for j in range(4)] for i in range(4)])


def _k80(t: Column, kappa: Column) -> Column:
    e1 = F.expm1(-4 * t / (kappa + 2))
    e2 = F.expm1(-2 * t * (kappa + 1) / (kappa + 2))
    entry = lambda i, j: 1 + (e1 + 2 * e2) / 4 if i == j else (e1 - 2 * e2) / 4 if abs(i - j) == 2 else -e1 / 4
    return _matrix([[entry(i, j) for j in range(4)] for i in range(4)])


def _f81(t: Column, pi: list[Column]) -> Column:
    rate = 1 / (1 - reduce(lambda x, y: x + y, [p * p for p in pi]))
    e = F.expm1(-rate * t)
    return _matrix([[(1 + e if i == j else F.lit(0.0)) - pi[j] * e for j in range(4)] for i in range(4)])


def _two_rate(t: Column, pi: list[Column], scale: Column, pyr: Column, pur: Column) -> Column:
    """Closed form for models with one rate for each transition type.

    ``pyr`` and ``pur`` multiply the transversion rate; ``scale`` converts the
    branch length to transversion time.
    """
    a, c, g, tt = pi
    group = {0: a + g, 2: a + g, 1: c + tt, 3: c + tt}
    bt = t * scale
    e1 = F.expm1(-bt)
    within = {k: F.expm1(-bt * (group[k] * (pur if k in (0, 2) else pyr) + (1 - group[k]))) for k in range(4)}

    def entry(i, j):
        if abs(i - j) % 2:
            return -pi[j] * e1
        other = 1 - group[j]
        between = other * pi[j] / group[j] * e1
        return 1 + between + (1 - pi[j] / group[j]) * within[j] if i == j else between - pi[j] / group[j] * within[j]

    return _matrix([[entry(i, j) for j in range(4)] for i in range(4)])


def _t92(t: Column, kappa: Column, gc: Column) -> Column:
    """Shares A = T and C = G follow from the G+C share; the branch length is not rescaled."""
    pi = [(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]
    e1, e2 = F.expm1(-t), F.expm1(-(kappa + 1) * t / 2)

    def entry(i, j):
        if abs(i - j) % 2:
            return -pi[j] * e1
        return 1 + pi[j] * e1 + (1 - 2 * pi[j]) * e2 if i == j else pi[j] * (e1 - 2 * e2)

    return _matrix([[entry(i, j) for j in range(4)] for i in range(4)])


def transition_probs(branches: DataFrame) -> DataFrame:
    """Add ``p``, the 4x4 matrix (row-major, A C G T), for closed-form models.

    Needs ``model`` and ``t``; ``kappa`` for K80, HKY, F84 and T92; ``freqs``
    (four shares) for F81, HKY, F84, T92 and TN93; ``qrates`` (pyrimidine,
    purine, transversion) for TN93.  Branches shorter than 1e-100 give the
    identity.
    """
    t, model = F.col("t"), F.col("model")
    has = lambda c: c in branches.columns
    out = F.when(model == "JC69", _jc69(t))
    if has("kappa"):
        kappa = F.col("kappa")
        out = out.when(model == "K80", _k80(t, kappa))
    if has("freqs"):
        pi = [F.col("freqs")[i] for i in range(4)]
        a, c, g, tt = pi
        r, y = a + g, c + tt
        out = out.when(model == "F81", _f81(t, pi))
        mean = lambda pyr, pur, tv=1.0: 1 / (2 * tt * c * pyr + 2 * a * g * pur + 2 * y * r * tv)
        if has("kappa"):
            out = out.when(model == "HKY", _two_rate(t, pi, mean(kappa, kappa), kappa, kappa))
            out = out.when(model == "T92", _t92(t, kappa, c + g))
            # F84 is scaled with plain kappa, without the group terms
            out = out.when(model == "F84", _two_rate(t, pi, mean(kappa, kappa), 1 + kappa / y, 1 + kappa / r))
        if has("qrates"):
            q = [F.col("qrates")[i] for i in range(3)]
            out = out.when(model == "TN93", _two_rate(t, pi, mean(q[0], q[1]), q[0] / q[2], q[1] / q[2]))
    checked = out.otherwise(F.raise_error(F.concat(F.lit("no closed form for model "), model)).cast("array<double>"))
    return branches.withColumn("p", F.when(t < 1e-100, _identity(4)).otherwise(checked))


def _eigen_system(rates: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and left/right factors of a reversible rate matrix, mean rate 1."""
    n = len(freqs)
    exchange = np.zeros((n, n))
    exchange[np.triu_indices(n, 1)] = rates
    exchange += exchange.T
    q = exchange * freqs
    np.fill_diagonal(q, -q.sum(axis=1))
    q /= -(freqs * np.diag(q)).sum()
    root = np.sqrt(freqs)
    values, vectors = np.linalg.eigh(root[:, None] * q / root)
    return values, vectors / root[:, None], vectors.T * root


def _general_matrices(t: np.ndarray, system: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """The flat matrices of one model for many branch lengths, by stacked products of bounded size."""
    lam, left, right = system
    n = len(lam)
    for at in range(0, len(t), MATRIX_ROWS):
        part = t[at : at + MATRIX_ROWS]
        p = np.eye(n) + (left * np.expm1(np.outer(part, lam))[:, None, :]) @ right
        p[part < 1e-100] = np.eye(n)
        yield np.maximum(p, 0.0).reshape(len(part), -1)


def transition_probs_general(branches: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``p`` by eigen-decomposition: GTR and the protein models.

    ``models(model_id, rates, freqs)``: the upper triangle of exchange rates and
    the state frequencies (4 or 20).  Up to REGISTRY_MODELS models are
    decomposed once and sent to the tasks; more, such as a model for each
    locus, are decomposed and joined.  Either way the branches of a model in an
    Arrow batch are stacked products.
    """
    few = models.select("model_id", "rates", "freqs").limit(REGISTRY_MODELS + 1).collect()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in branches.schema]) + ", p array<double>"

    def fill(pdf: pd.DataFrame, system) -> pd.DataFrame:
        mats = np.empty(len(pdf), object)
        t = pdf["t"].to_numpy(float)
        for model, at in pdf.groupby("model_id", sort=False).indices.items():
            rows = (row for part in _general_matrices(t[at], system(model, at[0])) for row in part)
            for i, row in zip(at, rows):
                mats[i] = row
        return pdf.assign(p=mats)

    if len(few) <= REGISTRY_MODELS:
        registry = {m["model_id"]: _eigen_system(np.asarray(m["rates"]), np.asarray(m["freqs"])) for m in few}
        shared = branches.sparkSession.sparkContext.broadcast(registry)

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield fill(pdf, lambda model, _: shared.value[model])

        return branches.filter(F.col("model_id").isin(list(registry))).mapInPandas(multiply, schema)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            systems = [_eigen_system(np.asarray(r), np.asarray(f)) for r, f in zip(pdf["rates"], pdf["freqs"])]
            parts = {name: [s[k].ravel() for s in systems] for k, name in enumerate(_FACTORS)}
            yield pd.DataFrame({"model_id": pdf["model_id"], **parts})

    systems = models.select("model_id", "rates", "freqs").mapInPandas(
        decompose, "model_id string, " + ", ".join(f"{name} array<double>" for name in _FACTORS)
    )

    def multiply_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lam, left, right = (pdf[name].to_numpy() for name in _FACTORS)
            square = lambda x, i: x[i].reshape(len(lam[i]), -1)
            yield fill(pdf.drop(columns=list(_FACTORS)), lambda _, i: (lam[i], square(left, i), square(right, i)))

    joined = branches.join(systems, "model_id").select(*branches.columns, *_FACTORS)
    return joined.mapInPandas(multiply_joined, schema)


def _gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma of many (a, x) at once.

    Below a + 1 the power series, summed until no term changes its sum; above,
    one minus the continued fraction, evaluated forwards.  Finished entries
    leave the loop.
    """
    a, x = (np.ravel(v).astype(float) for v in np.broadcast_arrays(a, x))
    out = np.zeros(len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
    at = np.flatnonzero((x > 0) & (x < a + 1))
    term = 1 / a[at]
    total, step = term.copy(), 0
    while len(at):
        step += 1
        term = term * x[at] / (a[at] + step)
        total = total + term
        out[at] = total * front[at]
        more = term > total * 1e-16
        at, term, total = at[more], term[more], total[more]
    at = np.flatnonzero(x >= a + 1)
    # numerators and denominators of successive convergents, rescaled to stay finite
    b = x[at] + 1 - a[at]
    h0, h1, k0, k1 = np.zeros(len(at)), np.ones(len(at)), np.ones(len(at)), b.copy()
    last, step = h1 / k1, 0
    out[at] = 1 - front[at] * last
    while len(at) and step < 1000:
        step += 1
        b = b + 2
        c = step * (a[at] - step)
        h0, h1, k0, k1 = h1, b * h1 + c * h0, k1, b * k1 + c * k0
        size = np.abs(k1)
        h0, h1, k0, k1 = h0 / size, h1 / size, k0 / size, k1 / size
        now = h1 / k1
        out[at] = 1 - front[at] * now
        more = np.abs(now - last) > 1e-16 * np.abs(now)
        at, b, last = at[more], b[more], now[more]
        h0, h1, k0, k1 = h0[more], h1[more], k0[more], k1[more]
    return out


_lgamma = np.vectorize(lgamma, otypes=[float])


def _gamma_quantiles(probs: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(a, rate 1) by bisection on the log scale, all at once."""
    lo, hi = np.full(len(probs), 1e-300), np.maximum(10.0, 20 * a + 100)
    for _ in range(200):
        mid = np.sqrt(lo * hi)
        below = _gamma_p(a, mid) < probs
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if np.all(hi / lo - 1 < 1e-15):
            break
    return np.sqrt(lo * hi)


def gamma_rates(alpha: float | np.ndarray, k: int) -> np.ndarray:
    """Mean rate of each of k equally likely slices of Gamma(alpha, alpha); a row for each of many alphas."""
    shapes = np.atleast_1d(np.asarray(alpha, float))
    each = np.repeat(shapes, k - 1)
    cuts = _gamma_quantiles(np.tile(np.arange(1, k) / k, len(shapes)), each)
    inner = _gamma_p(each + 1, cuts).reshape(len(shapes), k - 1)
    edges = np.hstack([np.zeros((len(shapes), 1)), inner, np.ones((len(shapes), 1))])
    rates = np.diff(edges, axis=1) * k
    return rates if np.ndim(alpha) else rates[0]


def gamma_categories(alphas: DataFrame, k: int) -> DataFrame:
    """(alpha, cat, rate) for the distinct alphas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alpha = pdf["alpha"].to_numpy(float)
            rates = gamma_rates(alpha, k)
            yield pd.DataFrame({"alpha": np.repeat(alpha, k), "cat": np.tile(np.arange(k), len(alpha)), "rate": rates.ravel()})

    return alphas.select(F.col("alpha").cast("double")).distinct().mapInPandas(run, "alpha double, cat int, rate double")


def tree_rows(gene_nodes: DataFrame, pmats: DataFrame) -> DataFrame:
    """(gen, locus, cats): per rate category, the nodes ordered children first.

    ``gene_nodes(gen, locus, node_id, parent_id, time, seq_idx)`` with
    ``seq_idx`` NULL on inner nodes; equal times are ordered by ``node_id``,
    which must then be larger for the parent.  ``pmats(gen, locus, node_id,
    cat, p)`` for all nodes but the root.  One tree is one row: its size is the
    number of sequences of a locus.
    """
    key = ["gen", "locus"]
    mats = pmats.groupBy(*key, "node_id").agg(F.array_sort(F.collect_list(F.struct("cat", "p"))).alias("ps"))
    nodes = gene_nodes.join(mats, [*key, "node_id"], "left")
    item = F.struct(
        "time", F.col("seq_idx").isNull().alias("inner"), "node_id", "parent_id", "seq_idx",
        F.transform("ps", lambda x: x["p"]).alias("ps"),
    )
    rows = nodes.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("t"), F.max(F.size("ps")).alias("n_cat"))
    ids = F.transform("t", lambda x: x["node_id"])
    rows = rows.withColumn("ids", ids)
    up = F.transform("t", lambda x: F.array_position("ids", x["parent_id"]) - 1)
    rows = rows.withColumn("up", up)
    kids = lambda i: F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda j: F.get(F.col("up"), j) == i)
    cats = F.transform(
        F.sequence(F.lit(0), F.col("n_cat") - 1),
        lambda c: F.transform(
            F.col("t"),
            lambda x, i: F.struct(x["seq_idx"].alias("seq_idx"), kids(i).alias("kids"), F.get(x["ps"], c).alias("p")),
        ),
    )
    return rows.select(*key, cats.alias("cats"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas do not share parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _message(p: Column, v: Column, n: int) -> Column:
    """P times the state vector; the last element (log scale) is carried on."""
    if n == 4:
        sums = [reduce(lambda x, y: x + y, [p[i * 4 + j] * v[j] for j in range(4)]) for i in range(4)]
        return F.array(*sums, v[4])
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, j: s + F.get(p, i * n + j) * F.get(v, j)),
    )
    return F.concat(rows, F.array(F.get(v, F.lit(n))))


def _multiply(x: Column, y: Column, n: int) -> Column:
    """Product of two messages; their log scales add up."""
    if n == 4:
        return F.array(*[x[i] * y[i] for i in range(4)], x[4] + y[4])
    return F.concat(
        F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a * b), F.array(F.get(x, F.lit(n)) + F.get(y, F.lit(n)))
    )


def _rescale(v: Column, n: int) -> Column:
    """Divide by the largest state and add its log to the scale."""
    top = F.greatest(*[v[i] for i in range(4)]) if n == 4 else F.array_max(F.slice(v, 1, n))

    def divided(s):
        if n == 4:
            return F.array(*[v[i] / s for i in range(4)], v[4] + F.log(s))
        return F.concat(F.transform(F.slice(v, 1, n), lambda x: x / s), F.array(F.get(v, F.lit(n)) + F.log(s)))

    return bind(F.when(top > 0, top).otherwise(F.lit(1.0)), divided)


def _tip_messages(nodes: Column) -> Column:
    """Give every tip of a DNA tree its message for each of the 16 state sets.

    A tree meets many patterns; its tips' messages are then only looked up.
    """

    def message(p, mask):
        bits = F.array(*[F.call_function("getbit", mask, F.lit(i)).cast("double") for i in range(4)], F.lit(0.0))
        return bind(bits, lambda v: F.when(p.isNull(), v).otherwise(_message(p, v, 4)))

    def with_table(x):
        table = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda m: message(x["p"], m))
        tips = F.when(x["seq_idx"].isNotNull(), table)
        inner_p = F.when(x["seq_idx"].isNull(), x["p"])
        return F.struct(x["seq_idx"].alias("seq_idx"), x["kids"].alias("kids"), inner_p.alias("p"), tips.alias("tips"))

    return F.transform(nodes, with_table)


def _prune(nodes: Column, tip_vector, n: int) -> Column:
    """Fold the nodes; the accumulator holds one message per node so far."""
    ones = F.array(*[F.lit(1.0)] * n, F.lit(0.0))

    def merge(acc, kids):
        product = F.aggregate(kids, ones, lambda v, k: bind(F.get(acc, k), lambda m: _multiply(v, m, n)))
        return bind(product, lambda v: _rescale(v, n))

    def step(acc, node):
        sent = lambda v: F.when(node["p"].isNull(), v).otherwise(_message(node["p"], v, n))
        at_tip = tip_vector(node) if n == 4 else bind(tip_vector(node), sent)
        out = F.when(node["seq_idx"].isNotNull(), at_tip).otherwise(bind(merge(acc, node["kids"]), sent))
        return F.concat(acc, F.array(out))

    return F.aggregate(nodes, F.array().cast("array<array<double>>"), step)


def conditional_likelihoods(gene_nodes: DataFrame, patterns: DataFrame, pmats: DataFrame, dtype: str = "DNA") -> DataFrame:
    """(gen, locus, pattern_id, weight, root): root vectors of every category.

    ``root`` has one array per category: the state vector divided by its
    largest element, then the log of all divisions.  ``patterns`` are coded
    columns from ``compress_patterns``.
    """
    n = 4 if dtype == "DNA" else 20
    trees = tree_rows(gene_nodes, pmats)
    if n == 4:
        # computed before the join, once per tree
        trees = trees.select("gen", "locus", F.transform("cats", _tip_messages).alias("cats"))
    block = F.floor(F.col("pattern_id") / PATTERN_BLOCK)
    # pruning costs far more than its bytes suggest: keep all cores busy
    spark = patterns.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a locus with many sampled trees is cut by trees too: each of its pattern blocks meets them in several tasks
    sampled = gene_nodes.filter("parent_id IS NULL").groupBy("locus").agg(F.ceil(F.count(F.lit(1)) / TREE_BLOCK).cast("int").alias("_parts"))
    cut = patterns.withColumn("_block", block).join(sampled, "locus")
    cut = cut.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    cut = cut.repartition(width, "locus", "_block", "_part")
    blocks = patterns.select("locus", block.alias("_block")).distinct().join(sampled, "locus")
    trees = trees.join(blocks, "locus").withColumn("_part", F.pmod(F.xxhash64("gen"), F.col("_parts")).cast("int")).drop("_parts")
    # a merge join keeps that partitioning; broadcasting either side would not
    rows = cut.join(trees.hint("merge"), ["locus", "_block", "_part"])

    def tip(node):
        mask = states.code_mask(F.substring(F.col("column"), node["seq_idx"] + 1, F.lit(1)), dtype)
        if n == 4:
            return F.get(node["tips"], mask)
        return bind(
            mask.cast("long"),
            lambda m: F.array(*[F.call_function("getbit", m, F.lit(i)).cast("double") for i in range(n)], F.lit(0.0)),
        )

    root = F.transform("cats", lambda nodes: F.element_at(_prune(nodes, tip, n), -1))
    return rows.select("gen", "locus", "pattern_id", "weight", root.alias("root"))


def pattern_log_likelihood(root_cl: DataFrame, freqs: DataFrame, cat_weights: list[float] | None = None) -> DataFrame:
    """Add ``lnl``: log of the category-weighted root likelihood per pattern.

    ``freqs(locus, pi)`` holds the state frequencies.  Categories share the
    largest scale before they are added.
    """
    size = F.size("root")
    weights = F.array(*[F.lit(float(w)) for w in cat_weights]) if cat_weights else None
    rows = root_cl.join(freqs.select("locus", "pi"), "locus")
    n = F.size("pi")
    scale = F.array_max(F.transform("root", lambda v: F.element_at(v, -1)))
    rows = rows.withColumn("_scale", scale)

    def one(v, c):
        inner = F.aggregate(F.zip_with("pi", F.slice(v, F.lit(1), n), lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        w = F.get(weights, c) if weights is not None else 1 / size
        return w * inner * F.exp(F.element_at(v, -1) - F.col("_scale"))

    total = F.aggregate(F.transform("root", one), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("lnl", F.log(total) + F.col("_scale")).drop("_scale", "pi", "root")


def locus_log_likelihood(root_cl: DataFrame, freqs: DataFrame, cat_weights: list[float] | None = None, beta: float = 1.0) -> DataFrame:
    per_pattern = pattern_log_likelihood(root_cl, freqs, cat_weights)
    return per_pattern.groupBy("gen", "locus").agg((F.sum(F.col("weight") * F.col("lnl")) * float(beta)).alias("logl"))


def diploid_log_likelihood(pattern_lnl: DataFrame, phase_map: DataFrame, site_weights: DataFrame) -> DataFrame:
    """Mean likelihood over the phase resolutions of a site, then the weighted log sum.

    ``pattern_lnl(gen, locus, pattern_id, lnl)``, ``phase_map(locus, site,
    resolution_idx, pattern_id)``, ``site_weights(locus, site, weight)``.
    """
    rows = pattern_lnl.select("gen", "locus", "pattern_id", "lnl").join(phase_map, ["locus", "pattern_id"])
    # resolutions of one site that share a pattern are counted, then summed
    same = rows.groupBy("gen", "locus", "site", "pattern_id", "lnl").agg(F.count(F.lit(1)).alias("k"))
    packed = same.groupBy("gen", "locus", "site").agg(
        F.max("lnl").alias("top"), F.collect_list(F.struct("lnl", "k")).alias("r"), F.sum("k").alias("total")
    )
    mean = F.aggregate("r", F.lit(0.0), lambda s, x: s + x["k"] * F.exp(x["lnl"] - F.col("top"))) / F.col("total")
    sites = packed.withColumn("ln_mean", F.log(mean) + F.col("top"))
    return (
        sites.join(site_weights, ["locus", "site"])
        .groupBy("gen", "locus")
        .agg(F.sum(F.col("weight") * F.col("ln_mean")).alias("logl"))
    )
