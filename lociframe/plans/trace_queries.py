"""Queries over posterior traces, conditionals and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import mathfns as M
from lociframe.operators import conditionals as C
from lociframe.operators import label_switch as S
from lociframe.operators import trace as T
from lociframe.plans.registry import query, r
from lociframe.session import cut_lineage
from lociframe.sources import adapters as A



def _stored_trace(spark, sf):
    """The derived trace written once, as a log on disk would be."""
    return cut_lineage(A.trace(spark, sf))


def _stored_conditionals(spark, sf):
    return cut_lineage(A.conditionals(spark, sf))


TRACE = """trace AS (
  SELECT 'c1' AS chain, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gen, event_type AS param, value
  FROM events)"""
CHAINS = """chains AS (
  SELECT chain, row_number() OVER (PARTITION BY chain, event_type ORDER BY ts, event_id) AS gen, event_type AS param, value
  FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'c1' ELSE 'c2' END AS chain FROM events))"""
SORTED = TRACE + """, s AS (
  SELECT chain, param, value, row_number() OVER (PARTITION BY chain, param ORDER BY value) - 1 AS k,
         count(*) OVER (PARTITION BY chain, param) AS n FROM trace)"""
MOMENTS = """SELECT chain, param, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
  min(value) AS min, max(value) AS max FROM trace GROUP BY 1, 2"""
QUANTILES = """SELECT chain, param,
  round((max(value) FILTER (k = n // 2) + max(value) FILTER (k = CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE n // 2 END)) / 2, 6) AS median,
  max(value) FILTER (k = CAST(floor(n * 0.025) AS BIGINT)) AS q025,
  max(value) FILTER (k = CAST(floor(n * 0.975) AS BIGINT)) AS q975 FROM s GROUP BY 1, 2"""
HPD = """SELECT chain, param, CASE WHEN n > 2 AND w < w0 THEN lo ELSE lo0 END AS hpd_lo,
  CASE WHEN n > 2 AND w < w0 THEN hi ELSE hi0 END AS hpd_hi
FROM (SELECT a.chain, a.param, a.n, b.value - a.value AS w, a.value AS lo, b.value AS hi,
        row_number() OVER (PARTITION BY a.chain, a.param ORDER BY b.value - a.value, a.k) AS pick
      FROM s a JOIN s b ON a.chain = b.chain AND a.param = b.param
       AND b.k = a.k + CAST(floor(a.n * 0.975) AS BIGINT) - CAST(floor(a.n * 0.025) AS BIGINT))
JOIN (SELECT chain, param, max(value) FILTER (k = CAST(floor(n * 0.025) AS BIGINT)) AS lo0,
        max(value) FILTER (k = CAST(floor(n * 0.975) AS BIGINT)) AS hi0, hi0 - lo0 AS w0 FROM s GROUP BY 1, 2) USING (chain, param)
WHERE pick = 1"""


def acf_sql(source: str, sd: str = "stddev_samp", name: str = "acf", lags: int = 2000) -> str:
    """Lag table of ``source(chain, param, gen, value)`` with gens 1..n.

    ``lags`` below 2000 suffices where only the early stop is wanted.
    """
    return f"""{name}_c AS MATERIALIZED (SELECT chain, param, gen, value - avg(value) OVER p AS x, count(*) OVER p AS n, {sd}(value) OVER p AS sd
      FROM {source} WINDOW p AS (PARTITION BY chain, param)),
    {name}_l AS MATERIALIZED (SELECT chain, param, gen, x, n, sd, unnest(range(1, {lags})) AS lg FROM {name}_c),
    {name} AS MATERIALIZED (SELECT a.chain, a.param, a.lg AS lag, sum(a.x * b.x) / (max(a.n) - a.lg) / (max(a.sd) * max(a.sd)) AS rho
      FROM {name}_l a JOIN {name}_c b ON a.chain = b.chain AND a.param = b.param AND b.gen = a.gen + a.lg
      WHERE a.lg < a.n - 10 GROUP BY a.chain, a.param, a.lg)"""


def tau_sql(acf: str = "acf", name: str = "tau") -> str:
    return f"""{name}_p AS (SELECT chain, param, lag // 2 AS p, sum(rho) + CASE WHEN lag // 2 = 0 THEN 1 ELSE 0 END AS pair
      FROM {acf} GROUP BY 1, 2, 3 HAVING bool_or(lag % 2 = 1)),
    {name} AS (SELECT chain, param, 2 * sum(pair) - 1 AS tau FROM {name}_p x WHERE NOT EXISTS (
      SELECT 1 FROM {name}_p y WHERE x.chain = y.chain AND x.param = y.param AND y.p <= x.p AND y.p * 2 + 1 > 10 AND y.pair < 0)
      GROUP BY 1, 2)"""


ESS = """SELECT chain, param, round(tau, 4) AS tau, round(n / tau, 3) AS ess, round(1 / tau, 4) AS eff, round(rho1, 6) AS rho1
FROM tau JOIN (SELECT chain, param, count(*) AS n FROM trace GROUP BY 1, 2) USING (chain, param)
JOIN (SELECT chain, param, rho AS rho1 FROM acf WHERE lag = 1) USING (chain, param)"""


def _moments(df):
    return df.select(*[c if c not in ("mean", "sd") else r(c) for c in df.columns])


def _ess(df):
    return df.select("chain", "param", r("tau", 4), r("ess", 3), r("eff", 4), r("rho1"))


@query("trace_moments", f"WITH {TRACE} {MOMENTS}")
def trace_moments(spark, sf):
    return _moments(T.trace_moments(A.trace(spark, sf)))


@query("trace_quantiles", f"WITH {SORTED} {QUANTILES}")
def trace_quantiles(spark, sf):
    return T.trace_quantiles(_stored_trace(spark, sf)).select("chain", "param", r("median"), "q025", "q975")


@query("hpd_interval", f"WITH {SORTED} {HPD}")
def hpd_interval(spark, sf):
    return T.hpd_interval(_stored_trace(spark, sf))


@query("autocorrelation", f"WITH {TRACE}, {acf_sql('trace')} SELECT chain, param, lag, round(rho, 6) AS rho FROM acf")
def autocorrelation(spark, sf):
    return T.autocorrelation(_stored_trace(spark, sf)).select("chain", "param", "lag", r("rho"))


@query("ess", f"WITH {TRACE}, {acf_sql('trace')}, {tau_sql()} {ESS}")
def ess(spark, sf):
    return _ess(T.ess(_stored_trace(spark, sf)))


@query(
    "trace_summary",
    f"WITH {SORTED}, {acf_sql('trace')}, {tau_sql()}, m AS ({MOMENTS}), q AS ({QUANTILES}), h AS ({HPD}), e AS ({ESS}) "
    "SELECT chain, param, mean, median, sd, min, max, q025, q975, hpd_lo, hpd_hi, ess, eff, rho1 "
    "FROM m JOIN q USING (chain, param) JOIN h USING (chain, param) JOIN e USING (chain, param)",
)
def trace_summary(spark, sf):
    digits = {"mean": 6, "median": 6, "sd": 6, "ess": 3, "eff": 4, "rho1": 6}
    out = T.trace_summary(_stored_trace(spark, sf))
    return out.select(*[r(c, digits[c]) if c in digits else c for c in out.columns])


@query(
    "running_mean",
    f"WITH {TRACE} SELECT chain, param, gen, round(avg(ln(1 + value)) OVER (PARTITION BY chain, param ORDER BY gen ROWS UNBOUNDED PRECEDING), 6) AS rmean FROM trace",
)
def running_mean(spark, sf):
    logs = A.trace(spark, sf).withColumn("value", F.log1p("value"))
    return T.running_mean(logs).select("chain", "param", "gen", r("rmean"))


_U = "(o_orderkey * 7919) % 1000"


@query(
    "running_species_posterior",
    f"""WITH s AS (SELECT o_orderkey AS gen, {_U} % 4 + 1 AS n_species FROM orders)
    SELECT 'c1' AS chain, gen, CAST(k AS INTEGER) AS k, round(avg(CASE WHEN n_species = k THEN 1.0 ELSE 0.0 END)
      OVER (PARTITION BY k ORDER BY gen ROWS UNBOUNDED PRECEDING), 6) AS p FROM s, range(1, 5) t(k)""",
)
def running_species_posterior(spark, sf):
    u = (F.col("o_orderkey") * 7919) % 1000
    samples = A.table(spark, sf, "orders").select(
        F.lit("c1").alias("chain"), F.col("o_orderkey").alias("gen"), (u % 4 + 1).alias("n_species")
    )
    return T.running_species_posterior(samples, 4).select("chain", "gen", "k", r("p"))


@query("burnin_thin", f"WITH {TRACE} SELECT * FROM trace WHERE gen > 100 AND (gen - 100) % 5 = 0")
def burnin_thin(spark, sf):
    return T.burnin_thin(A.trace(spark, sf), 100, 5)


@query(
    "shorten_param_names",
    """SELECT 'theta:' || l_linenumber AS param, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1""",
)
def shorten_param_names(spark, sf):
    li = A.table(spark, sf, "lineitem")
    named = li.select(
        F.concat(F.lit("theta:"), "l_linenumber", F.lit(":pop"), "l_linenumber").alias("param"), F.col("l_extendedprice").alias("value")
    )
    short = T.shorten_param_names(named)
    return short.groupBy("param").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("total_loglik", "SELECT l_orderkey AS gen, round(sum(-l_extendedprice / 1000) / 0.5, 4) AS lnl FROM lineitem GROUP BY 1")
def total_loglik(spark, sf):
    logl = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gen"), (-F.col("l_extendedprice") / 1000).alias("logl"))
    return T.total_loglik(logl, 0.5).select("gen", r("lnl", 4))


_EVIDENCE = """w AS (SELECT o_orderkey % 8 AS b, 2.0 * count(*) / (SELECT count(*) FROM orders) AS weight FROM orders GROUP BY 1),
  e AS (SELECT o_orderkey % 8 AS b, avg(-o_totalprice / 1000) AS e1, avg(-o_totalprice / 900) AS e2 FROM orders GROUP BY 1),
  m AS (SELECT 0.5 * sum(weight * e1) AS m1, 0.5 * sum(weight * e2) AS m2 FROM w JOIN e USING (b))"""


@query("marginal_likelihood", f"WITH {_EVIDENCE} SELECT round(m1, 5) AS log_m FROM m")
def marginal_likelihood(spark, sf):
    return T.marginal_likelihood(A.power_posterior(spark, sf), A.beta_weights(spark, sf)).select(r("log_m", 5))


@query("bayes_factor", f"WITH {_EVIDENCE} SELECT round(m1 - m2, 5) AS log_bf FROM m")
def bayes_factor(spark, sf):
    post, weights = A.power_posterior(spark, sf), A.beta_weights(spark, sf)
    other = post.withColumn("lnl", F.col("lnl") * 1000 / 900)
    return T.bayes_factor(T.marginal_likelihood(post, weights), T.marginal_likelihood(other, weights)).select(r("log_bf", 5))


_POOLED = CHAINS + """, ends AS (SELECT param, max(gen) FILTER (chain = 'c1') + 1 AS first FROM chains GROUP BY 1),
  trace AS (SELECT chain, gen, param, value FROM chains
    UNION ALL SELECT 'pool', gen + CASE WHEN chain = 'c2' THEN first - 1 ELSE 0 END, param, value FROM chains JOIN ends USING (param))"""


@query(
    "multi_chain_summary",
    f"WITH {SORTED.replace(TRACE, _POOLED)}, {acf_sql('trace')}, {tau_sql()}, m AS ({MOMENTS}), q AS ({QUANTILES}), h AS ({HPD}), e AS ({ESS}) "
    "SELECT chain = 'pool' AS pooled, CASE WHEN chain <> 'pool' THEN chain END AS chain, param, n, mean, median, sd, min, max, q025, q975, hpd_lo, hpd_hi, "
    "ess, eff, rho1 FROM m JOIN q USING (chain, param) JOIN h USING (chain, param) JOIN e USING (chain, param)",
)
def multi_chain_summary(spark, sf):
    digits = {"mean": 6, "median": 6, "sd": 6, "ess": 3, "eff": 4, "rho1": 6}
    out = T.multi_chain_summary(cut_lineage(A.two_chains(spark, sf)))
    return out.select(*[r(c, digits[c]) if c in digits else c for c in out.columns])


def _wide_as_trace(spark, sf):
    """Line items as samples: rates, thetas, an age and a clock per sample."""
    li = A.table(spark, sf, "lineitem").select(
        F.lit("c1").alias("chain"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gen"),
        (F.col("l_quantity") / 10).alias("W:1->2"),
        (F.col("l_extendedprice") / 1e7).alias("theta:2"),
        (F.col("l_discount") + 0.01).alias("tau:3"),
        (F.col("l_tax") + 0.5).alias("mu_bar"),
        (F.col("l_quantity") / 20).alias("W:2->4"),
    )
    return li.unpivot(["chain", "gen"], ["W:1->2", "W:2->4", "theta:2", "tau:3", "mu_bar"], "param", "value")


_LAST = """li AS (SELECT l_orderkey * 8 + l_linenumber AS gen, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem)"""
_UNIQUE = """SELECT gen, max(q) AS q, max(p) AS p, max(d) AS d, max(t) AS t FROM li GROUP BY gen"""


@query(
    "w_to_m",
    f"""WITH {_LAST} SELECT 'c1' AS chain, a.gen, param, round(CASE param WHEN 'M:1->2' THEN a.q / 10 ELSE a.q / 20 END
      * b.p / 1e7 / 4, 14) AS value FROM li a JOIN li b ON a.gen = b.gen, (VALUES ('M:1->2'), ('M:2->4')) v(param)""",
)
def w_to_m(spark, sf):
    pops = spark.createDataFrame([("2", None), ("4", "2")], "node string, linked_to string")
    return T.w_to_m(_wide_as_trace(spark, sf), pops).select("chain", "gen", "param", r("value", 14))


@query(
    "scaled_tau",
    f"WITH {_LAST} SELECT 'c1' AS chain, a.gen, 'r_tau:3' AS param, round((a.d + 0.01) / (b.t + 0.5), 8) AS value FROM li a JOIN li b ON a.gen = b.gen",
)
def scaled_tau(spark, sf):
    return T.scaled_tau(_wide_as_trace(spark, sf)).select("chain", "gen", "param", r("value", 8))


@query(
    "node_annotation",
    f"""WITH {SORTED}, h AS ({HPD}), m AS (SELECT param, avg(value) AS mean FROM trace GROUP BY 1),
    x AS (SELECT m.param, mean, hpd_lo, hpd_hi FROM m JOIN h USING (param))
    SELECT node_id, label, round(age, 6) AS age, lo, hi, round(theta, 6) AS theta, round(CASE WHEN parent_age IS NULL THEN NULL ELSE parent_age - age END, 6) AS length FROM (
      SELECT 1 AS node_id, 'A' AS label, 0.0::DOUBLE AS age, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi,
        (SELECT mean FROM x WHERE param = 'signup') AS theta, (SELECT mean FROM x WHERE param = 'error') AS parent_age
      UNION ALL SELECT 2, 'B', 0.0::DOUBLE, NULL, NULL, (SELECT mean FROM x WHERE param = 'signup'), (SELECT mean FROM x WHERE param = 'error')
      UNION ALL SELECT 3, 'AB', mean, hpd_lo, hpd_hi, (SELECT mean FROM x WHERE param = 'purchase'), (SELECT mean FROM x WHERE param = 'click') FROM x WHERE param = 'error'
      UNION ALL SELECT 4, 'C', 0.0::DOUBLE, NULL, NULL, NULL, (SELECT mean FROM x WHERE param = 'click')
      UNION ALL SELECT 5, 'ABC', mean, hpd_lo, hpd_hi, (SELECT mean FROM x WHERE param = 'view'), NULL FROM x WHERE param = 'click')""",
)
def node_annotation(spark, sf):
    names = {"signup": "theta:1", "purchase": "theta:3", "view": "theta:5", "error": "tau:3", "click": "tau:5"}
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    trace = _stored_trace(spark, sf).withColumn("param", mapping[F.col("param")])
    pops = spark.createDataFrame(
        [(1, 3, "A", None), (2, 3, "B", 1), (3, 5, "AB", None), (4, 5, "C", None), (5, None, "ABC", None)],
        "node_id int, parent_id int, label string, linked_to int",
    )
    out = T.node_annotation(T.trace_summary(trace), pops)
    return out.select("node_id", "label", r("age"), "lo", "hi", r("theta"), r("length"))


@query(
    "union_traces",
    f"WITH {TRACE}, n AS (SELECT max(gen) AS last FROM trace WHERE gen <= 1000) SELECT * FROM trace",
)
def union_traces(spark, sf):
    """Two overlapping parts of one run give the run back."""
    trace = A.trace(spark, sf)
    last = trace.agg((F.max("gen") / 2).alias("m"))
    marked = trace.crossJoin(F.broadcast(last))
    earlier = marked.filter("gen <= m").drop("m")
    later = marked.filter("gen > m - 50").drop("m")
    return T.union_traces(earlier, later)


_LGAMMA_AT = "l_quantity / 7 + 0.5"


@query(
    "prior_log_density",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(2.5 * ln(30) - lgamma(2.5) + 1.5 * ln(l_extendedprice / 1e5) - 30 * l_extendedprice / 1e5, 6) AS g,
      round(3.0 * ln(0.2) - lgamma(3.0) - 4.0 * ln(l_extendedprice / 1e5) - 0.2 / (l_extendedprice / 1e5), 6) AS ig FROM lineitem""",
)
def prior_log_density(spark, sf):
    values = A.table(spark, sf, "lineitem").withColumn("value", F.col("l_extendedprice") / 1e5)
    g = T.prior_log_density(values, "gamma", 2.5, 30).withColumnRenamed("lnp", "g")
    both = T.prior_log_density(g, "invgamma", 3, 0.2).withColumnRenamed("lnp", "ig")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", r("g"), r("ig"))


@query(
    "log_pdfs",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(lgamma({_LGAMMA_AT}), 7) AS lg,
      round(lgamma({_LGAMMA_AT} + 2) - lgamma({_LGAMMA_AT}) - lgamma(2) + ({_LGAMMA_AT} - 1) * ln(l_discount + 0.1) + ln(0.9 - l_discount), 6) AS b FROM lineitem""",
)
def log_pdfs(spark, sf):
    """The beta density and the log gamma function behind all densities."""
    a = F.col("l_quantity") / 7 + 0.5
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(M.lgamma(a), 7).alias("lg"),
        r(M.log_pdf_beta(F.col("l_discount") + 0.1, a, F.lit(2.0))).alias("b"),
    )


@query(
    "moment_fits",
    """WITH m AS (SELECT l_suppkey, avg(l_discount * 5 + 0.1) AS m, nullif(var_samp(l_discount * 5 + 0.1), 0) AS v FROM lineitem GROUP BY 1),
    z AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN m * (1 - m) / v - 1 <= 0 THEN 0.01 ELSE m * (1 - m) / v - 1 END AS z FROM m)
    SELECT l_suppkey, round(m * z, 6) AS p, round((1 - m) * z, 6) AS q, round(m * m / v, 6) AS a, round(m / v, 6) AS b FROM z""",
)
def moment_fits(spark, sf):
    x = F.col("l_discount") * 5 + 0.1
    stats = A.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(x).alias("m"), F.nullif(F.var_samp(x), F.lit(0.0)).alias("v"))
    (p, q), (a, b) = M.beta_from_moments(F.col("m"), F.col("v")), M.gamma_from_moments(F.col("m"), F.col("v"))
    return stats.select("l_suppkey", r(p).alias("p"), r(q).alias("q"), r(a).alias("a"), r(b).alias("b"))


@query(
    "bit_functions",
    "SELECT l_orderkey % 1024 AS mask, CAST(max(bit_count(l_orderkey % 1024)) AS INTEGER) AS bits, max((l_orderkey % 1024) & (-(l_orderkey % 1024))) AS low, max((l_orderkey % 1024) & (l_orderkey % 1024 - 1)) AS others, count(*) AS n FROM lineitem GROUP BY 1",
)
def bit_functions(spark, sf):
    mask = F.col("l_orderkey") % 1024
    rows = A.table(spark, sf, "lineitem").groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    m = F.col("mask")
    return rows.select("mask", F.bit_count(m).alias("bits"), M.lowest_bit(m).alias("low"), M.drop_lowest_bit(m).alias("others"), "n")


# --- mixtures of conditionals ------------------------------------------------

COND = """cond AS (SELECT l_returnflag AS param, 3 + l_quantity AS a1, l_extendedprice / 1e4 AS b1,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1e4) AS gen FROM lineitem)"""


def _interval_sql(cells: str) -> str:
    """Limits from ``cells(chain, param, bin, y, pdf)`` by the two-pointer rule."""
    return f"""cum AS (SELECT *, sum(pdf) OVER (PARTITION BY chain, param ORDER BY bin) AS cdf, count(*) OVER (PARTITION BY chain, param) AS bins FROM {cells}),
    arr AS (SELECT chain, param, max(bins) AS bins, list(cdf ORDER BY bin) AS cdf, list(y ORDER BY bin) AS y, arg_max(bin, pdf) AS mode FROM cum GROUP BY 1, 2),
    brk AS (SELECT chain, param, l, greatest(1, len(list_filter(cdf, lambda c: c - cdf[l + 1] <= 0.95))) AS brk
      FROM (SELECT *, unnest(range(bins)) AS l FROM arr)),
    steps AS (SELECT *, lag(brk) OVER (PARTITION BY chain, param ORDER BY l) AS prev FROM brk),
    best AS (SELECT chain, param, min({{'w': prev - l, 'l': l, 'u': prev}}) AS b FROM steps JOIN arr USING (chain, param)
      WHERE l > 0 AND l <= mode AND l < bins - 1 AND prev < bins AND brk > prev GROUP BY 1, 2),
    zero AS (SELECT chain, param, CASE WHEN brk > 1 THEN brk - 1 ELSE bins - 1 END AS u0 FROM brk JOIN arr USING (chain, param) WHERE l = 0),
    lim AS (SELECT arr.chain, arr.param, y[CASE WHEN b IS NOT NULL AND b.w < u0 THEN b.l ELSE 0 END + 1] AS hpd_lo,
      y[CASE WHEN b IS NOT NULL AND b.w < u0 THEN b.u ELSE u0 END + 1] AS hpd_hi,
      y[least(len(list_filter(cdf, lambda c: c <= 0.025)), bins - 1) + 1] AS et_lo,
      y[greatest(len(list_filter(cdf, lambda c: c < 0.975)) - 1, 0) + 1] AS et_hi
      FROM arr JOIN zero USING (chain, param) LEFT JOIN best USING (chain, param))"""


def _mixture_sql(mean: str, var: str, const: str, kernel: str, top: str) -> str:
    return f"""WITH {COND}, u AS (SELECT 'c1' AS chain, param, gen, a1, b1, {mean} AS value, {var} AS v FROM cond),
    st AS (SELECT chain, param, count(*) AS n, avg(value) AS mean, var_pop(value) AS vm, avg(v) AS mv, sqrt(var_pop(value) + avg(v)) AS sd FROM u GROUP BY 1, 2),
    g AS (SELECT *, greatest(mean - 4 * sd, 0) AS lo, ({top} - greatest(mean - 4 * sd, 0)) / 1000 AS width FROM st),
    cells AS (SELECT g.chain, g.param, bin, lo + (bin + 0.5) * width AS y, sum(exp({const} + {kernel})) * max(width) / max(n) AS pdf
      FROM (SELECT *, {const} AS const FROM u) u JOIN g USING (chain, param), range(1000) t(bin) GROUP BY g.chain, g.param, bin, lo, width),
    {_interval_sql('cells')}, {acf_sql('u', 'stddev_pop', lags=120)}, {tau_sql()}
    SELECT chain, param, round(mean, 6) AS mean, round(sd, 6) AS sd, round(et_lo, 6) AS et_lo, round(et_hi, 6) AS et_hi,
      round(hpd_lo, 6) AS hpd_lo, round(hpd_hi, 6) AS hpd_hi, round((vm + mv) / vm, 5) AS c, round((vm + mv) / vm / tau, 5) AS eff_u,
      round(1 / (1 + (tau - 1) / ((vm + mv) / vm)), 5) AS eff_y FROM st JOIN lim USING (chain, param) JOIN tau USING (chain, param)"""


_Y = "(lo + (bin + 0.5) * width)"
_GAMMA_CONST = "a1 * ln(b1) - lgamma(a1)"
GAMMA_SQL = _mixture_sql("a1 / b1", "a1 / (b1 * b1)", _GAMMA_CONST, f"(a1 - 1) * ln({_Y}) - b1 * {_Y}", "(mean + 4 * sd)")
INVGAMMA_SQL = _mixture_sql(
    "b1 / (a1 - 1)", "b1 * b1 / ((a1 - 1) * (a1 - 1) * (a1 - 2))", _GAMMA_CONST, f"-(a1 + 1) * ln({_Y}) - b1 / {_Y}", "(mean + 4 * sd)"
)
BETA_SQL = _mixture_sql(
    "a1 / (a1 + b1)", "a1 * b1 / ((a1 + b1) * (a1 + b1) * (a1 + b1 + 1))", "lgamma(a1 + b1) - lgamma(a1) - lgamma(b1)",
    f"(a1 - 1) * ln({_Y}) + (b1 - 1) * ln(1 - {_Y})", "least(mean + 4 * sd, 1)",
)


def _marginal(df):
    six = ("mean", "sd", "w_mean", "w_sd", "et_lo", "et_hi", "hpd_lo", "hpd_hi")
    return df.select("chain", "param", *[r(c, 6 if c in six else 5) for c in df.columns if c not in ("chain", "param")])


@query("conditional_to_marginal", GAMMA_SQL)
def conditional_to_marginal(spark, sf):
    return _marginal(C.conditional_to_marginal(_stored_conditionals(spark, sf), "gamma"))


@query("conditional_to_marginal_invgamma", INVGAMMA_SQL)
def conditional_to_marginal_invgamma(spark, sf):
    return _marginal(C.conditional_to_marginal(_stored_conditionals(spark, sf), "invgamma"))


@query("conditional_to_marginal_beta", BETA_SQL)
def conditional_to_marginal_beta(spark, sf):
    return _marginal(C.conditional_to_marginal(_stored_conditionals(spark, sf), "beta"))


#: products of a theta and a w; together they use every flag
PRODUCTS = [("M:1->2", "A", "N"), ("M:3->2", "R", "N")]
_PAIRS_SQL = "pr(param, theta, w) AS (VALUES " + ", ".join(map(repr, PRODUCTS)) + ")"
_PRODUCT_SQL = f"""WITH {COND}, {_PAIRS_SQL}, u AS (SELECT 'c1' AS chain, pr.param, t.gen, t.a1 AS a, t.b1 AS b, w.a1 AS aw, w.b1 AS bw,
    t.a1 / t.b1 AS m1, t.a1 / (t.b1 * t.b1) AS v1, w.a1 / w.b1 AS m2, w.a1 / (w.b1 * w.b1) AS v2, m1 * m2 AS value
    FROM pr JOIN cond t ON t.param = pr.theta JOIN cond w ON t.gen = w.gen AND w.param = pr.w),
  st AS (SELECT chain, param, count(*) AS n, avg(m1) AS mean1, avg(m2) AS mean2, avg(value) AS my, var_pop(m1) + avg(v1) AS var1,
    var_pop(m2) + avg(v2) AS var2, var_pop(value) / 16 AS vmy, (avg((v1 + m1 * m1) * (v2 + m2 * m2)) - avg(value) * avg(value)) / 16 AS vy FROM u GROUP BY 1, 2),
  g AS (SELECT *, greatest(mean1 / 2 - 4 * sqrt(var1 / 4), 0) AS lo1, (mean1 / 2 + 4 * sqrt(var1 / 4) - lo1) / 60 AS width1,
    greatest(mean2 / 2 - 4 * sqrt(var2 / 4), 0) AS lo2, (mean2 / 2 + 4 * sqrt(var2 / 4) - lo2) / 60 AS width2 FROM st),
  d1 AS (SELECT chain, param, gen, k, exp(a * (ln(2) + ln(b)) - lgamma(a) + (a - 1) * ln(lo1 + (k + 0.5) * width1) - 2 * b * (lo1 + (k + 0.5) * width1)) AS p FROM u JOIN g USING (chain, param), range(60) t(k)),
  d2 AS (SELECT chain, param, gen, l, exp(aw * (ln(2) + ln(bw)) - lgamma(aw) + (aw - 1) * ln(lo2 + (l + 0.5) * width2) - 2 * bw * (lo2 + (l + 0.5) * width2)) AS q FROM u JOIN g USING (chain, param), range(60) t(l)),
  grid AS (SELECT chain, param, k, l, sum(p * q) AS s FROM d1 JOIN d2 USING (chain, param, gen) GROUP BY 1, 2, 3, 4),
  cells AS (SELECT chain, param, row_number() OVER (PARTITION BY chain, param ORDER BY (lo1 + (k + 0.5) * width1) * (lo2 + (l + 0.5) * width2), k, l) - 1 AS bin,
    (lo1 + (k + 0.5) * width1) * (lo2 + (l + 0.5) * width2) AS y, s * width1 * width2 / n AS pdf FROM grid JOIN g USING (chain, param)),
  {_interval_sql('cells')}, {acf_sql('u', 'stddev_pop', lags=120)}, {tau_sql()}
  SELECT chain, param, round(my / 4, 6) AS mean, round(sqrt(vy), 6) AS sd, round(mean2, 6) AS w_mean, round(sqrt(var2), 6) AS w_sd,
    round(et_lo, 6) AS et_lo, round(et_hi, 6) AS et_hi, round(hpd_lo, 6) AS hpd_lo, round(hpd_hi, 6) AS hpd_hi, round(vy / vmy, 5) AS c,
    round(vy / vmy / tau, 5) AS eff_u, round(1 / (1 + (tau - 1) / (vy / vmy)), 5) AS eff_y
  FROM st JOIN lim USING (chain, param) JOIN tau USING (chain, param)"""


def _products(spark, sf):
    cond = _stored_conditionals(spark, sf)
    return cond, cond, spark.createDataFrame(PRODUCTS, "param string, theta string, w string")


@query("conditional_to_marginal_product", _PRODUCT_SQL)
def conditional_to_marginal_product(spark, sf):
    return _marginal(C.conditional_to_marginal_product(*_products(spark, sf), "gamma"))


@query(
    "unmatched_iterations",
    f"""WITH {COND}, {_PAIRS_SQL}, t AS (SELECT pr.param, gen FROM cond c JOIN pr ON c.param = pr.theta), w AS (SELECT pr.param, gen FROM cond c JOIN pr ON c.param = pr.w)
    SELECT 'c1' AS chain, param, gen, 'theta' AS side FROM (SELECT * FROM t EXCEPT SELECT * FROM w) UNION ALL
    SELECT 'c1', param, gen, 'w' FROM (SELECT * FROM w EXCEPT SELECT * FROM t)""",
)
def unmatched_iterations(spark, sf):
    return C.unmatched_iterations(*_products(spark, sf))


_SWITCH = "phi_x string, phi_y string, theta_x string, theta_y string, event string"


def _mirrored(spark, sf, event, chain, flip, factors, thetas):
    """Samples of an event in which those with ``flip`` are written mirrored."""
    k = F.col("o_orderkey")
    part = lambda m: (k * m) % 1000 / 1000
    px, py = 0.1 + 0.3 * part(factors[0]), 0.2 + 0.2 * part(factors[1])
    cells = [("phi_x", px, 1 - px), ("phi_y", py, 1 - py)]
    if thetas:
        tx, ty = 0.01 + 0.01 * part(31), 0.05 + 0.01 * part(57)
        cells += [("theta_x", tx, ty), ("theta_y", ty, tx)]
    values = [F.struct(F.lit(f"{n}{event}").alias("param"), F.when(flip, m).otherwise(v).alias("value")) for n, v, m in cells]
    keyed = A.table(spark, sf, "orders").select(chain.alias("chain"), k.alias("gen"), F.explode(F.array(*values)).alias("c"))
    return keyed.select("chain", "gen", "c.param", "c.value")


def _switched(spark, sf):
    """Two events, one without thetas, in two chains; the operator must turn the mirrored samples back."""
    k = F.col("o_orderkey")
    chain = F.when(k % 2 == 0, "c1").otherwise("c2")
    one = _mirrored(spark, sf, "", chain, k % 3 == 0, (7919, 104729), True)
    two = _mirrored(spark, sf, "2", chain, k % 5 < 2, (3571, 2311), False)
    events = [("phi_x", "phi_y", "theta_x", "theta_y", "one"), ("phi_x2", "phi_y2", None, None, "two")]
    return S.label_switch(cut_lineage(one.unionByName(two)), spark.createDataFrame(events, _SWITCH))


_SIDES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c1' ELSE 'c2' END AS chain, o_orderkey AS gen, param, round(CASE param
      WHEN 'phi_x' THEN 0.1 + 0.3 * ((o_orderkey * 7919) % 1000) / 1000 WHEN 'phi_y' THEN 0.2 + 0.2 * ((o_orderkey * 104729) % 1000) / 1000
      WHEN 'theta_x' THEN 0.01 + 0.01 * ((o_orderkey * 31) % 1000) / 1000 WHEN 'theta_y' THEN 0.05 + 0.01 * ((o_orderkey * 57) % 1000) / 1000
      WHEN 'phi_x2' THEN 0.1 + 0.3 * ((o_orderkey * 3571) % 1000) / 1000 ELSE 0.2 + 0.2 * ((o_orderkey * 2311) % 1000) / 1000 END, 9) AS value
    FROM orders, (VALUES ('phi_x'), ('phi_y'), ('theta_x'), ('theta_y'), ('phi_x2'), ('phi_y2')) p(param)"""


@query("label_switch", _SIDES)
def label_switch(spark, sf):
    return _switched(spark, sf)[0].select("chain", "gen", "param", r("value", 9))


@query(
    "label_switch_counts",
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c1' ELSE 'c2' END AS chain, event, count(*) FILTER (CASE event WHEN 'one' THEN o_orderkey % 3 = 0 ELSE o_orderkey % 5 < 2 END) AS n_reflected
    FROM orders, (VALUES ('one'), ('two')) e(event) GROUP BY 1, 2""",
)
def label_switch_counts(spark, sf):
    return _switched(spark, sf)[1]


# --- migration ---------------------------------------------------------------

MIG = """mig AS (SELECT o_orderkey % 40 AS locus, CAST(c_nationkey % 4 AS BIGINT) AS source, (c_nationkey + o_orderkey) % 4 AS target,
  o_orderkey // 40 % 25 AS gen, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey % 4 <> (c_nationkey + o_orderkey) % 4 GROUP BY 1, 2, 3, 4)"""


@query(
    "migration_count_summary",
    f"""WITH {MIG} SELECT source || '->' || target AS pair, locus, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean
    FROM mig GROUP BY GROUPING SETS ((pair, locus), (pair))""",
)
def migration_count_summary(spark, sf):
    return T.migration_count_summary(A.migcounts(spark, sf)).select("pair", "locus", "total", r("mean"))


_ACTIVE = """active AS (SELECT gen, pair, avg(v) AS rate FROM (
    SELECT l_orderkey AS gen, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag || '->' || l_linestatus END AS pair, l_extendedprice / 1e4 AS v FROM lineitem) GROUP BY 1, 2),
  gens AS (SELECT gen, coalesce(string_agg(pair, ',' ORDER BY pair), '') AS model, count(pair) AS n_pairs FROM active GROUP BY 1)"""


def _active(spark, sf):
    li = A.table(spark, sf, "lineitem")
    pair = F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.lit("->"), "l_linestatus"))
    return li.groupBy(F.col("l_orderkey").alias("gen"), pair.alias("pair")).agg(F.avg(F.col("l_extendedprice") / 1e4).alias("rate"))


@query(
    "migration_model_posterior",
    f"WITH {_ACTIVE} SELECT model, n_pairs, count(*) AS n, round(count(*) / (SELECT count(*) FROM gens)::DOUBLE, 6) AS p FROM gens GROUP BY 1, 2",
)
def migration_model_posterior(spark, sf):
    return T.migration_model_posterior(_active(spark, sf))["models"].select("model", "n_pairs", "n", r("p"))


@query(
    "migration_model_rates",
    f"WITH {_ACTIVE} SELECT model, pair, round(avg(rate), 6) AS mean_rate FROM active JOIN gens USING (gen) WHERE pair IS NOT NULL GROUP BY 1, 2",
)
def migration_model_rates(spark, sf):
    return T.migration_model_posterior(_active(spark, sf))["rates"].select("model", "pair", r("mean_rate"))


@query(
    "migration_pair_counts",
    f"WITH {_ACTIVE} SELECT n_pairs, count(*) AS n, round(count(*) / (SELECT count(*) FROM gens)::DOUBLE, 6) AS p FROM gens GROUP BY 1",
)
def migration_pair_counts(spark, sf):
    return T.migration_model_posterior(_active(spark, sf))["sizes"].select("n_pairs", "n", r("p"))
