"""Queries over gene-tree events, species trees, likelihoods and traits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociframe.operators import coalescent as G
from lociframe.operators import likelihood as K
from lociframe.operators import phase as P
from lociframe.operators import pops as S
from lociframe.operators import traits as X
from lociframe.operators import trees as T
from lociframe.plans.align_queries import CHARS, patterns
from lociframe.plans.registry import query, r
from lociframe.session import cut_lineage
from lociframe.sources import adapters as A

#: species tree ((A,R)S,N)Z: node, parent, start, theta, linked master
POPS = [("A", "S", 0.0, 0.01, None), ("R", "S", 0.0, 0.02, None), ("N", "Z", 0.0, 0.015, "A"), ("S", "Z", 0.05, 0.03, None), ("Z", None, 0.12, 0.04, None)]
POPS_SQL = "pops(pop_id, parent, tau, theta, linked) AS (VALUES " + ", ".join(
    f"('{n}', {'NULL' if p is None else repr(p)}, {t}::DOUBLE, {th}::DOUBLE, {'NULL' if m is None else repr(m)})" for n, p, t, th, m in POPS
) + "), life AS (SELECT a.pop_id, a.tau, b.tau AS parent_tau, a.theta FROM pops a LEFT JOIN pops b ON a.parent = b.pop_id)"
MIG_SPEC = [("A", "R", 0.5, 2.0, 4.0), ("R", "A", 0.7, 2.0, 4.0), ("A", "N", 0.2, 2.0, 4.0)]
SPEC_SQL = "spec(source, target, rate) AS (VALUES " + ", ".join(f"('{s}', '{t}', {w}::DOUBLE)" for s, t, w, _, _ in MIG_SPEC) + ")"

_BASE = """base AS (SELECT l_orderkey AS gen, l_orderkey % 40 AS locus, l_returnflag AS flag, l_extendedprice / 2.5e6 AS time,
  l_returnflag <> 'N' AND l_linenumber % 3 = 0 AS mig FROM lineitem)"""
_FLOW = """ltt AS (SELECT gen, locus, pop_id, lag(time) OVER w AS t0, time AS t1, kind,
    CAST(sum(delta) OVER (PARTITION BY gen, locus, pop_id ORDER BY time, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS n
  FROM (SELECT gen, locus, pop_id, time, kind, delta, 1 AS rk FROM ev
    UNION ALL SELECT gen, locus, pop_id, tau, 'START', seqin, 0 FROM si
    UNION ALL SELECT gen, locus, pop_id, parent_tau, 'TAU', 0, 2 FROM si WHERE parent_tau IS NOT NULL) WINDOW w AS (PARTITION BY gen, locus, pop_id ORDER BY time, rk)),
  wait AS (SELECT gen, locus, pop_id, sum(n * (n - 1) * (t1 - t0)) AS c2, sum(n * (t1 - t0)) AS lt, count(*) FILTER (kind = 'COAL') AS k FROM ltt WHERE kind <> 'START' GROUP BY 1, 2, 3)"""
_SI = "si AS (SELECT gen, locus, e.pop_id, count(*) FILTER (delta = -1) + 1 AS seqin, max(tau) AS tau, max(parent_tau) AS parent_tau FROM ev e JOIN life USING (pop_id) GROUP BY 1, 2, 3)"
COAL = f"{_BASE}, {POPS_SQL}, ev AS (SELECT gen, locus, flag AS pop_id, time, 'COAL' AS kind, -1 AS delta FROM base), {_SI}, {_FLOW}"
FLOW = f"""{_BASE}, {POPS_SQL}, {SPEC_SQL}, ev AS (SELECT gen, locus, flag AS pop_id, time, CASE WHEN mig THEN 'MIG_SOURCE' ELSE 'COAL' END AS kind, -1 AS delta FROM base
    UNION ALL SELECT gen, locus, CASE WHEN flag = 'A' THEN 'R' ELSE 'A' END, time, 'MIG_TARGET', 1 FROM base WHERE mig), {_SI}, {_FLOW},
  mc AS (SELECT gen, locus, CASE WHEN flag = 'A' THEN 'R' ELSE 'A' END AS source, flag AS target, count(*) AS m FROM base WHERE mig GROUP BY 1, 2, 3, 4),
  expo AS (SELECT gen, locus, source, target, sum(n * greatest(0, least(t1, d.parent_tau) - greatest(t0, d.tau))) AS w
    FROM ltt JOIN spec ON pop_id = target JOIN life d ON d.pop_id = source WHERE kind <> 'START' GROUP BY 1, 2, 3, 4)"""


def pops_table(spark):
    return spark.createDataFrame(POPS, "node_id string, parent_id string, tau double, theta double, linked_to string")


def _by_pop(df):
    return df.withColumnRenamed("node_id", "pop_id")


def _events(spark, sf, flow=False):
    li = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("gen"), (F.col("l_orderkey") % 40).alias("locus"), F.col("l_returnflag").alias("pop_id"),
        (F.col("l_extendedprice") / 2.5e6).alias("time"),
        (F.lit(flow) & (F.col("l_returnflag") != "N") & (F.col("l_linenumber") % 3 == 0)).alias("mig"),
    )
    kind = lambda name, pop, delta: F.struct(F.lit(name).alias("kind"), pop.alias("pop"), F.lit(delta).alias("delta_n"))
    own = F.col("pop_id")
    other = F.when(own == "A", "R").otherwise("A")
    what = F.when(F.col("mig"), F.array(kind("MIG_SOURCE", own, -1), kind("MIG_TARGET", other, 1))).otherwise(F.array(kind("COAL", own, -1)))
    return li.select("gen", "locus", "time", F.explode(what).alias("e")).select(
        "gen", "locus", F.col("e.pop").alias("pop_id"), "time", "e.kind", "e.delta_n"
    )


def _seqin(spark, events):
    life = _by_pop(S.pop_lifetimes(pops_table(spark), [])).drop("parent_id")
    n = events.groupBy("gen", "locus", "pop_id").agg((F.count_if(F.col("delta_n") == -1) + 1).alias("seqin"))
    return n.join(F.broadcast(life), "pop_id")


def _ltt(spark, sf, flow=False):
    ev = _events(spark, sf, flow)
    return G.lineages_through_time(ev, _seqin(spark, ev))


def _waiting(spark, sf, flow=False):
    return G.coalescent_waiting(_ltt(spark, sf, flow))


def _migcounts(spark, sf):
    out = _events(spark, sf, True).filter("kind = 'MIG_SOURCE'")
    donor = F.when(F.col("pop_id") == "A", "R").otherwise("A")
    return out.groupBy("gen", "locus", donor.alias("source"), F.col("pop_id").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def _spec(spark):
    return spark.createDataFrame(MIG_SPEC, "source string, target string, rate double, alpha double, beta double")


@query("sort_events", f"WITH {_BASE} SELECT gen, locus, flag AS pop_id, time, CAST(row_number() OVER (PARTITION BY gen, flag ORDER BY time) AS INTEGER) AS event_no FROM base")
def sort_events(spark, sf):
    return G.sort_events(_events(spark, sf)).select("gen", "locus", "pop_id", "time", "event_no")


@query("lineages_through_time", f"WITH {FLOW} SELECT gen, locus, pop_id, round(t0, 9) AS t0, round(t1, 9) AS t1, sum(n)::BIGINT AS n, count(*) AS c FROM ltt WHERE kind <> 'START' GROUP BY 1, 2, 3, 4, 5")
def lineages_through_time(spark, sf):
    out = _ltt(spark, sf, True)
    return out.groupBy("gen", "locus", "pop_id", r("t0", 9), r("t1", 9)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))


@query("coalescent_waiting", f"WITH {COAL} SELECT gen, locus, pop_id, round(c2, 8) AS c2, round(lt, 8) AS lineage_time, k AS coal_count FROM wait")
def coalescent_waiting(spark, sf):
    return _waiting(spark, sf).select("gen", "locus", "pop_id", r("c2", 8), r("lineage_time", 8), "coal_count")


@query(
    "msc_log_density",
    f"""WITH {COAL} SELECT gen, locus, pop_id, round(k * ln(2 / (0.75 * theta)) - c2 / (theta * 0.75) + CASE WHEN pop_id = 'R' THEN (seqin - 1) * ln(0.3) ELSE 0 END, 5) AS logpr
    FROM wait JOIN life USING (pop_id) JOIN (SELECT gen, locus, pop_id, seqin FROM si) USING (gen, locus, pop_id)""",
)
def msc_log_density(spark, sf):
    ev = _events(spark, sf)
    seqin = _seqin(spark, ev)
    waiting = G.coalescent_waiting(G.lineages_through_time(ev, seqin)).join(seqin.select("gen", "locus", "pop_id", "seqin"), ["gen", "locus", "pop_id"])
    pops = _by_pop(pops_table(spark)).select("pop_id", "theta", F.when(F.col("pop_id") == "R", 0.3).alias("phi"))
    return G.msc_log_density(waiting.withColumn("right_seqin", F.lit(1)), pops, 0.75).select("gen", "locus", "pop_id", r("logpr", 5))


@query(
    "locus_log_density",
    f"WITH {COAL} SELECT gen, locus, round(sum(k * ln(2 / theta) - c2 / theta), 5) AS logpr FROM wait JOIN life USING (pop_id) GROUP BY 1, 2",
)
def locus_log_density(spark, sf):
    pops = _by_pop(pops_table(spark)).select("pop_id", "theta")
    return G.locus_log_density(G.msc_log_density(_waiting(spark, sf), pops)).select("gen", "locus", r("logpr", 5))


@query(
    "msc_migration_log_density",
    f"""WITH {FLOW}, t AS (SELECT gen, locus, target AS pop_id, sum(coalesce(m, 0) * ln(rate) - rate * coalesce(w, 0)) AS term
      FROM expo FULL JOIN mc USING (gen, locus, source, target) JOIN spec USING (source, target) GROUP BY 1, 2, 3)
    SELECT gen, locus, pop_id, round(k * ln(2 / theta) - c2 / theta + coalesce(term, 0), 5) AS logpr FROM wait JOIN life USING (pop_id) LEFT JOIN t USING (gen, locus, pop_id)""",
)
def msc_migration_log_density(spark, sf):
    table = pops_table(spark)
    out = G.msc_migration_log_density(
        _ltt(spark, sf, True), _by_pop(table).select("pop_id", "theta"), _spec(spark).select("source", "target", "rate"),
        _migcounts(spark, sf), S.pop_lifetimes(table, []),
    )
    return out.select("gen", "locus", "pop_id", r("logpr", 5))


@query("migration_exposure", f"WITH {FLOW} SELECT gen, locus, source, target, round(w, 9) AS w_time FROM expo")
def migration_exposure(spark, sf):
    out = G.migration_exposure(_ltt(spark, sf, True), S.pop_lifetimes(pops_table(spark), []), _spec(spark).select("source", "target"))
    return out.select("gen", "locus", "source", "target", r("w_time", 9))


@query(
    "migration_conditional",
    f"""WITH {FLOW}, t AS (SELECT gen, source, target, sum(coalesce(m, 0)) AS m, sum(coalesce(w, 0)) AS w FROM expo FULL JOIN mc USING (gen, locus, source, target) GROUP BY 1, 2, 3)
    SELECT gen, source, target, CASE WHEN target <> 'N' THEN 2.0 + m END::DOUBLE AS a1, CASE WHEN target <> 'N' THEN round(4 + w, 8) END AS b1 FROM t""",
)
def migration_conditional(spark, sf):
    ltt, spec = _ltt(spark, sf, True), _spec(spark)
    expo = G.migration_exposure(ltt, S.pop_lifetimes(pops_table(spark), []), spec.select("source", "target"))
    gens = expo.select("gen").distinct()
    pairs = spec.select("source", "target", (F.col("target") != "N").alias("valid"))
    possible = gens.crossJoin(F.broadcast(pairs))
    return G.migration_conditional(_migcounts(spark, sf), expo, spec, possible).select("gen", "source", "target", "a1", r("b1", 8))


@query(
    "dated_tip_density",
    f"""WITH {_BASE}, {POPS_SQL}, ev AS (SELECT gen, locus, flag AS pop_id, time, 'COAL' AS kind, -1 AS delta FROM base
      UNION ALL SELECT gen, locus, flag, 0.0101 + (gen % 7) * 0.0013, 'SAMPLE', 2 FROM base GROUP BY gen, locus, flag),
    {_SI}, {_FLOW} SELECT gen, locus, pop_id, round(c2, 8) AS c2, round(lt, 8) AS lineage_time, k AS coal_count FROM wait""",
)
def dated_tip_density(spark, sf):
    ev = _events(spark, sf)
    groups = ev.select("gen", "locus", "pop_id").distinct()
    dates = groups.select("*", (0.0101 + (F.col("gen") % 7) * 0.0013).alias("age"), F.lit(2).alias("k"))
    out = G.dated_tip_density(ev, dates, _seqin(spark, ev))
    return out.select("gen", "locus", "pop_id", r("c2", 8), r("lineage_time", 8), "coal_count")


_POOLED = "pooled AS (SELECT gen % 100 AS gen, coalesce(linked, pop_id) AS pop_id, sum(k) AS k, sum(c2 / 0.75) AS c2 FROM wait JOIN pops USING (pop_id) GROUP BY 1, 2)"


def _pool_args(spark, sf):
    """A hundred samples of many loci each, with one linked population."""
    waiting = _waiting(spark, sf).withColumn("locus", F.col("gen")).withColumn("gen", F.col("gen") % 100)
    masters = pops_table(spark).select(F.col("node_id").alias("pop_id"), F.col("linked_to").alias("master"))
    return waiting, masters


@query(
    "integrated_theta_density",
    f"WITH {COAL}, {_POOLED} SELECT gen, pop_id, round(CASE WHEN k > 0 THEN 3 * ln(0.02) - lgamma(3) - (3 + k) * ln(0.02 + c2) + lgamma(3 + k) ELSE -3 * ln(1 + c2 / 0.02) END, 5) AS logpr FROM pooled",
)
def integrated_theta_density(spark, sf):
    waiting, masters = _pool_args(spark, sf)
    return G.integrated_theta_density(waiting, 3.0, 0.02, masters, 0.75).select("gen", "pop_id", r("logpr", 5))


@query("theta_conditional", f"WITH {COAL}, {_POOLED} SELECT gen, pop_id, 3.0::DOUBLE + k AS a1, round(0.02 + c2, 7) AS b1 FROM pooled")
def theta_conditional(spark, sf):
    waiting, masters = _pool_args(spark, sf)
    return G.theta_conditional(waiting, 3.0, 0.02, masters, 0.75).select("gen", "pop_id", "a1", r("b1", 7))


@query(
    "theta_conditional_gamma_approx",
    f"""WITH {COAL}, {_POOLED}, m AS (SELECT *, 2 - k AS c, (c + sqrt(c * c + 4 * 150 * c2)) / 300 AS mode, c + 2 * c2 / mode AS q FROM pooled)
    SELECT gen, pop_id, round(1 + q / 2 + sqrt(q + q * q / 4), 4) AS a1, round((q / 2 + sqrt(q + q * q / 4)) / mode, 4) AS b1 FROM m""",
)
def theta_conditional_gamma_approx(spark, sf):
    waiting, masters = _pool_args(spark, sf)
    return G.theta_conditional_gamma_approx(waiting, 3.0, 150.0, masters, 0.75).select("gen", "pop_id", r("a1", 4), r("b1", 4))


@query(
    "theta_conditional_invgamma_approx",
    f"""WITH {COAL}, {_POOLED}, m AS (SELECT *, 2 - k AS c, (c + sqrt(c * c + 4 * 150 * c2)) / 300 AS mode, c + 2 * c2 / mode AS q FROM pooled),
    d AS (SELECT *, (4 + q) / 3 AS third, (5 - 2 * q) / 3 - third * third AS w, third * (third * third - (5 - 2 * q) / 2) + (2 + q) / 2 AS h FROM m),
    x AS (SELECT *, cbrt(h + sqrt(h * h + w * w * w)) AS u FROM d)
    SELECT gen, pop_id, round(third + u - w / u, 4) AS a1, round(mode * (third + u - w / u + 1), 4) AS b1 FROM x""",
)
def theta_conditional_invgamma_approx(spark, sf):
    waiting, masters = _pool_args(spark, sf)
    out = G.theta_conditional_gamma_approx(waiting, 3.0, 150.0, masters, 0.75, family="invgamma")
    return out.select("gen", "pop_id", r("a1", 4), r("b1", 4))


# --- species trees -----------------------------------------------------------

_UP = {1: [1], 2: [2, 1], 3: [3, 2, 1], 4: [4, 3, 2, 1], 5: [5, 3, 2, 1], 6: [6, 2, 1], 7: [7, 1]}
_UP_SQL = "up(node_id, anc_id, dist) AS (VALUES " + ", ".join(f"({n}, {a}, {i})" for n, ups in _UP.items() for i, a in enumerate(ups)) + ")"


@query("ancestor_closure", f"WITH {_UP_SQL} SELECT o_orderkey AS gen, CAST(node_id AS BIGINT) AS node_id, CAST(anc_id AS BIGINT) AS anc_id, dist FROM orders, up")
def ancestor_closure(spark, sf):
    nodes = T.newick_nodes(A.timed_trees(spark, sf), ["gen"]).select("gen", "node_id", "parent_id")
    out = S.ancestor_closure(nodes, ["gen"])
    return out.select("gen", F.col("node_id").cast("long").alias("node_id"), F.col("anc_id").cast("long").alias("anc_id"), "dist")


def _sampled_pops(spark, sf):
    """The fixed tree with ages scaled by every order: one tree per sample."""
    scale = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("gen"), (F.col("o_totalprice") / 1e5).alias("f"))
    return scale.crossJoin(F.broadcast(pops_table(spark))).select(
        "gen", "node_id", "parent_id", (F.col("tau") * F.col("f")).alias("tau"), (F.col("theta") * F.col("f")).alias("theta"), "linked_to"
    )


_SAMPLED = f"{POPS_SQL}, sp AS (SELECT o_orderkey AS gen, pop_id, parent, tau * (o_totalprice / 1e5) AS tau, theta * (o_totalprice / 1e5) AS theta, linked FROM orders, pops)"


@query(
    "linked_theta_master",
    f"WITH {_SAMPLED} SELECT a.gen, a.pop_id AS node_id, b.pop_id AS master, round(b.theta, 9) AS theta FROM sp a JOIN sp b ON a.gen = b.gen AND b.pop_id = coalesce(a.linked, a.pop_id)",
)
def linked_theta_master(spark, sf):
    return S.linked_theta_master(_sampled_pops(spark, sf), ["gen"]).select("gen", "node_id", "master", r("theta", 9))


@query("pop_lifetimes", f"WITH {_SAMPLED} SELECT a.gen, a.pop_id AS node_id, round(a.tau, 9) AS tau, round(b.tau, 9) AS parent_tau FROM sp a LEFT JOIN sp b ON a.gen = b.gen AND a.parent = b.pop_id")
def pop_lifetimes(spark, sf):
    return S.pop_lifetimes(_sampled_pops(spark, sf), ["gen"]).select("gen", "node_id", r("tau", 9), r("parent_tau", 9))


_ALL_PAIRS = [(s, t) for s in "ARNSZ" for t in "ARNSZ" if s != t]


@query(
    "migration_possible",
    f"""WITH {_SAMPLED}, lf AS (SELECT a.gen, a.pop_id, a.tau, b.tau AS ptau FROM sp a LEFT JOIN sp b ON a.gen = b.gen AND a.parent = b.pop_id)
    SELECT s.gen, s.pop_id AS source, t.pop_id AS target, s.ptau IS NOT NULL AND t.ptau IS NOT NULL AND
      coalesce((s.tau <= t.tau AND t.tau < s.ptau) OR (s.tau >= t.tau AND s.tau <= t.ptau), FALSE) AS valid FROM lf s JOIN lf t ON s.gen = t.gen AND s.pop_id <> t.pop_id""",
)
def migration_possible(spark, sf):
    spec = spark.createDataFrame(_ALL_PAIRS, "source string, target string")
    return S.migration_possible(_sampled_pops(spark, sf), spec, ["gen"])


@query(
    "gene_leaves",
    """WITH c AS (SELECT l_suppkey AS locus, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), m(f, node_id) AS (VALUES ('A', 'A'), ('R', 'R'), ('N', 'N'), ('A', 'S'), ('R', 'S'), ('A', 'Z'), ('R', 'Z'), ('N', 'Z'))
    SELECT locus, node_id, CAST(sum(n) AS BIGINT) AS n_leaves FROM c JOIN m USING (f) GROUP BY 1, 2""",
)
def gene_leaves(spark, sf):
    counts = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("locus"), F.col("l_returnflag").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return S.gene_leaves(counts, S.ancestor_closure(pops_table(spark), []))


@query(
    "lineages_entering",
    f"""WITH {FLOW}, k AS (SELECT gen, locus, coalesce(sum(k) FILTER (pop_id <> 'N'), 0) AS ar, sum(k) AS every FROM wait GROUP BY 1, 2)
    SELECT gen, locus, 'S' AS node_id, CAST(20 - ar AS BIGINT) AS seqin FROM k UNION ALL SELECT gen, locus, 'Z', CAST(30 - every AS BIGINT) FROM k
    UNION ALL SELECT gen, locus, t, 10 FROM k, (VALUES ('A'), ('R'), ('N')) v(t)""",
)
def lineages_entering(spark, sf):
    waiting = _by_node(_waiting(spark, sf, True))
    counts = waiting.select("locus").distinct().select("locus", F.explode(F.array(*map(F.lit, "ARN"))).alias("node_id"), F.lit(10).cast("long").alias("n"))
    return S.lineages_entering(waiting, counts, S.ancestor_closure(pops_table(spark), []), _migcounts(spark, sf))


def _by_node(df):
    return df.withColumnRenamed("pop_id", "node_id")


@query(
    "dated_node_bounds",
    """WITH d AS (SELECT substr('ARNSZ', CAST(o_orderkey % 5 + 1 AS INTEGER), 1) AS node_id, o_totalprice AS age FROM orders)
    SELECT 'S' AS node_id, (SELECT max(age) FROM d WHERE node_id IN ('A', 'R')) AS lower, (SELECT min(age) FROM d WHERE node_id IN ('S', 'Z')) AS upper
    UNION ALL SELECT 'Z', (SELECT max(age) FROM d WHERE node_id <> 'Z'), (SELECT min(age) FROM d WHERE node_id = 'Z')""",
)
def dated_node_bounds(spark, sf):
    dates = A.table(spark, sf, "orders").select(
        F.substring(F.lit("ARNSZ"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1)).alias("node_id"), F.col("o_totalprice").alias("age")
    )
    return S.dated_node_bounds(dates, S.ancestor_closure(pops_table(spark), []))


# --- gene trees as node tables -----------------------------------------------


def _gene_nodes(spark, sf):
    """One caterpillar tree per order: line i joins at its price."""
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")
    li = A.table(spark, sf, "lineitem")
    m = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    ranked = li.select("l_orderkey", (F.col("l_extendedprice") / 1e6).alias("t"), F.row_number().over(w).alias("i"), m.cast("int").alias("m"))
    i, n = F.col("i"), F.col("m")
    tip = F.struct(i.alias("node_id"), F.when(n > 1, n + F.greatest(i - 1, F.lit(1))).alias("parent_id"), F.lit(0.0).alias("time"), F.concat(F.lit("t"), i).alias("label"))
    inner = F.struct((n + i - 1).alias("node_id"), F.when(i < n, n + i).alias("parent_id"), F.col("t").alias("time"), F.lit(None).cast("string").alias("label"))
    both = F.explode(F.when(i > 1, F.array(tip, inner)).otherwise(F.array(tip))).alias("x")
    nodes = ranked.select(F.col("l_orderkey").alias("gen"), (F.col("l_orderkey") % 40).alias("locus"), both).select("gen", "locus", "x.*")
    pop = F.when(F.col("time") < 0.05, "A").when(F.col("time") < 0.12, "S").otherwise("Z")
    return nodes.withColumn("pop_id", pop)


_CAT = """rk AS (SELECT l_orderkey AS gen, l_orderkey % 40 AS locus, l_extendedprice / 1e6 AS t,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
  br AS (SELECT gen, locus, i AS node_id, 0.0::DOUBLE AS t0, t AS t1 FROM rk WHERE i > 1 UNION ALL
    SELECT gen, locus, 1, 0.0, t FROM rk WHERE i = 2 UNION ALL
    SELECT a.gen, a.locus, a.m + a.i - 1, a.t, b.t FROM rk a JOIN rk b ON a.gen = b.gen AND b.i = a.i + 1 WHERE a.i > 1),
  bands(segment_pop, lo, hi, rate) AS (VALUES ('A', 0.0::DOUBLE, 0.05::DOUBLE, 1.0::DOUBLE), ('S', 0.05, 0.12, 1.5), ('Z', 0.12, 1e9, 0.5)),
  seg AS (SELECT gen, locus, node_id, segment_pop, greatest(t0, lo) AS t0, least(t1, hi) AS t1, rate FROM br, bands WHERE least(t1, hi) > greatest(t0, lo))"""


@query("gene_tree_height_length", f"WITH {_CAT} SELECT gen, locus, max(CASE WHEN i > 1 THEN t ELSE 0 END) AS th, round(CASE WHEN max(m) > 1 THEN sum(CASE WHEN i > 1 THEN t ELSE 0 END) + max(t) ELSE 0 END, 9) AS tl FROM rk GROUP BY 1, 2")
def gene_tree_height_length(spark, sf):
    return G.gene_tree_height_length(_gene_nodes(spark, sf)).select("gen", "locus", "th", r("tl", 9))


@query("pairwise_coalescence_time", f"WITH {_CAT} SELECT 't' || a AS label1, 't' || b AS label2, gen, locus, t FROM rk, (VALUES (1, 2), (1, 3), (2, 4)) p(a, b) WHERE i = b")
def pairwise_coalescence_time(spark, sf):
    nodes = _gene_nodes(spark, sf)
    pairs = spark.createDataFrame([("t1", "t2"), ("t1", "t3"), ("t2", "t4")], "label1 string, label2 string")
    return G.pairwise_coalescence_time(nodes, pairs)


def _segments(spark, sf):
    return G.branch_population_segments(_gene_nodes(spark, sf), pops_table(spark))


@query("branch_population_segments", f"WITH {_CAT} SELECT gen, locus, CAST(node_id AS INTEGER) AS node_id, segment_pop, t0, t1 FROM seg")
def branch_population_segments(spark, sf):
    return _segments(spark, sf)


@query("relaxed_branch_lengths", f"WITH {_CAT} SELECT gen, locus, CAST(node_id AS INTEGER) AS node_id, round(sum((t1 - t0) * rate), 9) AS length FROM seg GROUP BY 1, 2, 3")
def relaxed_branch_lengths(spark, sf):
    rates = spark.createDataFrame([("A", 1.0), ("S", 1.5), ("Z", 0.5)], "segment_pop string, rate double")
    return G.relaxed_branch_lengths(_segments(spark, sf), rates).select("gen", "locus", "node_id", r("length", 9))


# --- a species tree of each sample, and a network of each sample ---------------

#: a sample's ages are these times its scale
_SCALED = "SELECT o_orderkey AS gen, 1 + (o_orderkey % 7) / 10.0::DOUBLE AS f FROM orders"
#: network: population, parent, start, hybridization, second population, horizontal.  Above H (event 0) a lineage goes
#: by S or by T; above K (event 1) directly or by the horizontal edge Km to U.
NETWORK = [
    ("A", "H", 0.0, None, None, False), ("H", "S", 0.02, 0, "Hm", False), ("Hm", "T", 0.02, 0, None, False), ("S", "K", 0.04, None, None, False),
    ("T", "K", 0.03, None, None, False), ("K", "Z", 0.06, 1, "Km", False), ("Km", "U", 0.06, 1, None, True), ("U", "Z", 0.06, None, None, False),
    ("Z", None, 0.09, None, None, False),
]
#: (bit of event 0, bit of event 1, population, from, to)
_PATHS = [
    (None, None, "A", 0.0, 0.02), (0, None, "H", 0.02, 0.04), (0, None, "S", 0.04, 0.06), (1, None, "Hm", 0.02, 0.03), (1, None, "T", 0.03, 0.06),
    (None, 0, "K", 0.06, 0.09), (None, 1, "U", 0.06, 0.09), (None, None, "Z", 0.09, 1e9),
]


def _null(v):
    return "NULL" if v is None else repr(v)


_BY_SAMPLE = f"""{_CAT}, scale AS ({_SCALED}),
  own AS (SELECT br.gen, locus, node_id, segment_pop, greatest(t0, lo * f) AS t0, least(t1, hi * f) AS t1, rate
    FROM br JOIN scale USING (gen), bands WHERE least(t1, hi * f) > greatest(t0, lo * f))"""
_BY_PATH = f"""{_CAT}, scale AS ({_SCALED}),
  paths(b0, b1, segment_pop, lo, hi) AS (VALUES {", ".join(f"({_null(a)}, {_null(b)}, '{p}', {lo}::DOUBLE, {hi}::DOUBLE)" for a, b, p, lo, hi in _PATHS)}),
  own AS (SELECT br.gen, locus, node_id, segment_pop, greatest(t0, lo * f) AS t0, least(t1, hi * f) AS t1
    FROM br JOIN scale USING (gen), paths
    WHERE least(t1, hi * f) > greatest(t0, lo * f) AND coalesce(b0 = br.gen % 2, TRUE) AND coalesce(b1 = br.gen // 2 % 2, TRUE))"""


def _scaled(spark, sf, rows, schema):
    """The populations of ``rows`` once for each order, ages times the order's scale."""
    pops = F.broadcast(spark.createDataFrame(rows, schema))
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("gen"), (1 + (F.col("o_orderkey") % 7) / 10.0).alias("f"))
    return orders.crossJoin(pops).withColumn("tau", F.col("tau") * F.col("f"))


def _aged_pops(spark, sf):
    return _scaled(spark, sf, [p[:3] for p in POPS], "node_id string, parent_id string, tau double").drop("f")


def _sampled_network(spark, sf):
    schema = "node_id string, parent_id string, tau double, event int, mirror_id string, horizontal boolean"
    return _scaled(spark, sf, NETWORK, schema).drop("f")


def _placed_nodes(spark, sf, pop):
    """Gene trees whose nodes lie in the populations of their sample; ``pop`` gives one from the unscaled time."""
    f = 1 + (F.col("gen") % 7) / 10.0
    return _gene_nodes(spark, sf).withColumn("hpath", F.col("gen") % 4).withColumn("pop_id", pop(lambda age: F.col("time") < age * f))


def _sampled_segments(spark, sf):
    pop = lambda before: F.when(before(0.05), "A").when(before(0.12), "S").otherwise("Z")
    return G.branch_population_segments(_placed_nodes(spark, sf, pop), _aged_pops(spark, sf))


def _network_segments(spark, sf):
    def pop(before):
        one, two = F.col("hpath") % 2 == 1, F.col("hpath") >= 2
        low = F.when(one, F.when(before(0.03), "Hm").otherwise("T")).otherwise(F.when(before(0.04), "H").otherwise("S"))
        high = F.when(two, "U").otherwise("K")
        return F.when(before(0.02), "A").when(before(0.06), low).when(before(0.09), high).otherwise("Z")

    return G.branch_population_segments(_placed_nodes(spark, sf, pop), _sampled_network(spark, sf))


_SEGMENT = "gen, locus, CAST(node_id AS INTEGER) AS node_id, segment_pop, round(t0, 9) AS t0, round(t1, 9) AS t1"


def _rounded(segments):
    return segments.select("gen", "locus", "node_id", "segment_pop", r("t0", 9), r("t1", 9))


@query("branch_population_segments_by_sample", f"WITH {_BY_SAMPLE} SELECT {_SEGMENT} FROM own")
def branch_population_segments_by_sample(spark, sf):
    return _rounded(_sampled_segments(spark, sf))


@query("branch_population_segments_network", f"WITH {_BY_PATH} SELECT {_SEGMENT} FROM own")
def branch_population_segments_network(spark, sf):
    return _rounded(_network_segments(spark, sf))


def _population_rates(spark, sf, names):
    """A rate of each sample and population."""
    cells = [F.struct(F.lit(p).alias("segment_pop"), (0.5 + (F.col("o_orderkey") * (i + 1)) % 10 / 10.0).alias("rate")) for i, p in enumerate(names)]
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("gen"), F.explode(F.array(*cells)).alias("x")).select("gen", "x.*")


def _rate_sql(names):
    return "CASE segment_pop " + " ".join(f"WHEN '{p}' THEN 0.5 + (gen * {i + 1}) % 10 / 10.0" for i, p in enumerate(names)) + " END"


_TREE_POPS, _NET_POPS = [p[0] for p in POPS], [p[0] for p in NETWORK]
_LENGTH = "SELECT gen, locus, CAST(node_id AS INTEGER) AS node_id, round(sum((t1 - t0) * ({rate})), 9) AS length FROM own GROUP BY 1, 2, 3"


@query("relaxed_branch_lengths_by_sample", f"WITH {_BY_SAMPLE} {_LENGTH.format(rate=_rate_sql(_TREE_POPS))}")
def relaxed_branch_lengths_by_sample(spark, sf):
    rates = _population_rates(spark, sf, _TREE_POPS)
    return G.relaxed_branch_lengths(_sampled_segments(spark, sf), rates).select("gen", "locus", "node_id", r("length", 9))


@query("relaxed_branch_lengths_network", f"WITH {_BY_PATH} {_LENGTH.format(rate=_rate_sql(_NET_POPS))}")
def relaxed_branch_lengths_network(spark, sf):
    rates = _population_rates(spark, sf, _NET_POPS).filter("segment_pop <> 'Km'")  # a horizontal edge has no rate
    return G.relaxed_branch_lengths(_network_segments(spark, sf), rates).select("gen", "locus", "node_id", r("length", 9))


_RATE = "0.5 + (o_orderkey * {k} * 31) % 1000 / 1000.0"


def _drift_sql(scale: str = "1.0", extra: str = "") -> str:
    rates = ", ".join(f"({_RATE.format(k=k)})::DOUBLE AS r{k}" for k in range(1, 6))
    lg = lambda x, a, b: f"({a} * ln({b}) - lgamma({a}) + ({a} - 1) * ln({x}) - {b} * {x})"
    gamma = " + ".join(lg(f"r{k}", "(1.1 * 1.1 / 0.2)", "(1.1 / 0.2)") for k in range(1, 6))
    logn = " + ".join(f"(-pow(ln(r{k}) - ln(1.1) + 0.1, 2) / 0.4 - ln(r{k}) - 0.5 * ln(2 * pi() * 0.2))" for k in range(1, 6))
    corr_g = " + ".join(f"{lg(c, f'({p} * {p} / 0.2)', f'({p} / 0.2)')}" for c, p in (("r1", "r4"), ("r2", "r4"), ("r4", "r5"), ("r3", "r5")))

    def drift(ra, r1, r2, ta, t1, t2):
        det = f"({t1} * {t2} + {ta} * ({t1} + {t2}))"
        y1, y2 = f"(ln({r1} / {ra}) + ({ta} + {t1}) * 0.1)", f"(ln({r2} / {ra}) + ({ta} + {t2}) * 0.1)"
        z = f"(({y1} * {y1} * ({ta} + {t2}) - 2 * {y1} * {y2} * {ta} + {y2} * {y2} * ({ta} + {t1})) / {det})"
        return f"(-{z} / 0.4 - ln({det} * 0.04) / 2 - ln({r1} * {r2}) - ln(2 * pi()))"

    half = lambda age: f"({age} * {scale})"
    corr_l = drift("r4", "r1", "r2", half("0.035"), half("0.025"), half("0.025")) + " + " + drift("1.1", "r3", "r4", "0.0", half("0.06"), half("0.035"))
    cols = {"gamma": gamma, "lognormal": logn, "corr_gamma": corr_g, "corr_lognormal": corr_l}
    return (
        f"WITH t AS (SELECT o_orderkey AS gen, {rates} FROM orders) SELECT gen, CAST(1 AS INTEGER) AS locus, "
        + ", ".join(f"round({e}, 6) AS {n}" for n, e in cols.items())
        + " FROM t"
    )


def _drift_rates(spark, sf, count=5):
    k = F.col("o_orderkey")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("node_id"), (0.5 + (k * i * 31) % 1000 / 1000.0).alias("rate")) for i in range(1, count + 1)])).alias("x")
    return A.table(spark, sf, "orders").select(k.alias("gen"), F.lit(1).alias("locus"), cells).select(
        "gen", "locus", "x.*", F.lit(1.1).alias("mu"), F.lit(0.2).alias("nu")
    )


def _priors(rates, pops, models):
    out = None
    for model in models:
        one = G.branch_rate_log_prior(rates, pops, model).select("gen", "locus", r("lnp").alias(model))
        out = one if out is None else out.join(one, ["gen", "locus"])
    return out


_DRIFT_POPS = [(1, 4, 0.0), (2, 4, 0.0), (3, 5, 0.0), (4, 5, 0.05), (5, None, 0.12)]
_MODELS = ("gamma", "lognormal", "corr_gamma", "corr_lognormal")


@query("branch_rate_log_prior", _drift_sql())
def branch_rate_log_prior(spark, sf):
    pops = spark.createDataFrame(_DRIFT_POPS, "node_id int, parent_id int, tau double")
    return _priors(_drift_rates(spark, sf), pops, _MODELS)


@query("branch_rate_log_prior_by_sample", _drift_sql("(1 + (gen % 7) / 10.0::DOUBLE)"))
def branch_rate_log_prior_by_sample(spark, sf):
    pops = _scaled(spark, sf, _DRIFT_POPS, "node_id int, parent_id int, tau double").drop("f")
    return _priors(_drift_rates(spark, sf), pops, _MODELS)


def _network_prior_sql() -> str:
    """Of nine populations the seventh is a horizontal edge and has no rate."""
    kept = [k for k in range(1, 10) if k != 7]
    rates = ", ".join(f"({_RATE.format(k=k)})::DOUBLE AS r{k}" for k in kept)
    a, b = "(1.1 * 1.1 / 0.2)", "(1.1 / 0.2)"
    gamma = " + ".join(f"({a} * ln({b}) - lgamma({a}) + ({a} - 1) * ln(r{k}) - {b} * r{k})" for k in kept)
    logn = " + ".join(f"(-pow(ln(r{k}) - ln(1.1) + 0.1, 2) / 0.4 - ln(r{k}) - 0.5 * ln(2 * pi() * 0.2))" for k in kept)
    return f"""WITH t AS (SELECT o_orderkey AS gen, {rates} FROM orders)
      SELECT gen, CAST(1 AS INTEGER) AS locus, round({gamma}, 6) AS gamma, round({logn}, 6) AS lognormal FROM t"""


@query("branch_rate_log_prior_network", _network_prior_sql())
def branch_rate_log_prior_network(spark, sf):
    names = [p[0] for p in NETWORK]
    number = lambda c: F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    pops = _sampled_network(spark, sf)
    pops = pops.withColumns({"node_id": number(F.col("node_id")), "parent_id": number(F.col("parent_id")), "mirror_id": number(F.col("mirror_id"))})
    return _priors(_drift_rates(spark, sf, len(names)), pops, ("gamma", "lognormal"))


# --- likelihood --------------------------------------------------------------

FREQS = (0.3, 0.2, 0.15, 0.35)
_A, _C, _G, _T = FREQS
_R, _Y = _A + _G, _C + _T


def _two_rate_sql(scale, pyr, pur):
    bt = f"(t * {scale})"
    e1, e2, e3 = f"(exp(-{bt}) - 1)", f"(exp(-{bt} * ({_R} * {pur} + {_Y})) - 1)", f"(exp(-{bt} * ({_Y} * {pyr} + {_R})) - 1)"
    return [f"1 + {_Y * _A / _R} * {e1} + {_G / _R} * {e2}", f"-{_C} * {e1}", f"{_Y * _G / _R} * {e1} - {_G / _R} * {e2}",
            f"1 + ({_R * _C} * {e1} + {_T} * {e3}) / {_Y}", f"({_R} * {e1} - {e3}) * {_T / _Y}"]


def _t92_sql(gc):
    at, cg, e1, e2 = (1 - gc) / 2, gc / 2, "exp(-t)", "exp(-1.5 * t)"
    same = lambda p: f"{p} * (1 + {e1}) + {1 - 2 * p} * {e2}"
    transition = lambda p: f"{p} * (1 + {e1} - 2 * {e2})"
    return [same(at), f"{cg} * (1 - {e1})", transition(cg), same(cg), transition(at)]


_MEAN = lambda pyr, pur: 1 / (2 * _T * _C * pyr + 2 * _A * _G * pur + 2 * _Y * _R)
_F81 = f"exp(-t / {1 - sum(p * p for p in FREQS)})"
MODEL_SQL = {
    "JC69": ["0.25 + 0.75 * exp(-4 * t / 3)", "0.25 - 0.25 * exp(-4 * t / 3)", "0.25 - 0.25 * exp(-4 * t / 3)", "0.25 + 0.75 * exp(-4 * t / 3)", "0.25 - 0.25 * exp(-4 * t / 3)"],
    "K80": ["0.25 + exp(-t) / 4 + exp(-1.5 * t) / 2", "0.25 - exp(-t) / 4", "0.25 + exp(-t) / 4 - exp(-1.5 * t) / 2", "0.25 + exp(-t) / 4 + exp(-1.5 * t) / 2", "0.25 + exp(-t) / 4 - exp(-1.5 * t) / 2"],
    "F81": [f"{_F81} + {_A} * (1 - {_F81})", f"{_C} * (1 - {_F81})", f"{_G} * (1 - {_F81})", f"{_F81} + {_C} * (1 - {_F81})", f"{_T} * (1 - {_F81})"],
    "HKY": _two_rate_sql(_MEAN(2.0, 2.0), 2.0, 2.0),
    "F84": _two_rate_sql(_MEAN(2.0, 2.0), 1 + 2.0 / _Y, 1 + 2.0 / _R),
    "TN93": _two_rate_sql(_MEAN(1.8, 2.4), 1.8 / 1.2, 2.4 / 1.2),
    "T92": _t92_sql(_C + _G),
}
_ENTRIES = {"p_aa": 0, "p_ac": 1, "p_ag": 2, "p_cc": 5, "p_ct": 7}
_P_SQL = ", ".join(
    f"round(CASE model {' '.join(f'WHEN {m!r} THEN {v[i]}' for m, v in MODEL_SQL.items())} END, 8) AS {n}" for i, n in enumerate(_ENTRIES)
)
_BRANCH = f"branch AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1e5 AS t, {list(MODEL_SQL)}[CAST(l_partkey % {len(MODEL_SQL)} AS INTEGER) + 1] AS model FROM lineitem)"


def _branches(spark, sf):
    models = F.array(*[F.lit(m) for m in MODEL_SQL])
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1e5).alias("t"), F.get(models, (F.col("l_partkey") % len(MODEL_SQL)).cast("int")).alias("model")
    )


def _entries(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "model", *[r(F.get(F.col("p"), F.lit(i)), 8).alias(n) for n, i in _ENTRIES.items()])


@query("transition_probs", f"WITH {_BRANCH} SELECT l_orderkey, l_linenumber, l_partkey, model, {_P_SQL} FROM branch")
def transition_probs(spark, sf):
    rows = _branches(spark, sf).withColumn("kappa", F.lit(2.0)).withColumn("freqs", F.array(*map(F.lit, FREQS)))
    return _entries(K.transition_probs(rows.withColumn("qrates", F.array(F.lit(1.8), F.lit(2.4), F.lit(1.2)))))


@query(
    "transition_probs_general",
    f"WITH branch AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1e5 AS t, CASE l_partkey % 2 WHEN 0 THEN 'F81' ELSE 'HKY' END AS model FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, model, {_P_SQL} FROM branch",
)
def transition_probs_general(spark, sf):
    """General reversible matrices whose rates have closed forms."""
    rows = _branches(spark, sf).withColumn("model", F.when(F.col("l_partkey") % 2 == 0, "F81").otherwise("HKY"))
    models = spark.createDataFrame(
        [("F81", [1.0] * 6, list(FREQS)), ("HKY", [1.0, 2.0, 1.0, 1.0, 2.0, 1.0], list(FREQS))],
        "model_id string, rates array<double>, freqs array<double>",
    )
    return _entries(K.transition_probs_general(rows.withColumn("model_id", F.col("model")), models))


@query("gamma_categories")
def gamma_categories(spark, sf):
    alphas = A.table(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("alpha"))
    return K.gamma_categories(alphas, 4)


def _locus_trees(spark, sf):
    """(((0,1),2),3) per locus with ages from the document number."""
    d = F.col("doc_id")
    t1 = 0.01 * (1 + d % 5)
    t2 = t1 + 0.01 * (1 + d % 7)
    t3 = t2 + 0.02 * (1 + d % 3)
    rows = [(0, 4, F.lit(0.0), 0), (1, 4, F.lit(0.0), 1), (2, 5, F.lit(0.0), 2), (3, 6, F.lit(0.0), 3), (4, 5, t1, None), (5, 6, t2, None), (6, None, t3, None)]
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("node_id"), F.lit(p).cast("int").alias("parent_id"), t.alias("time"), F.lit(s).cast("int").alias("seq_idx")) for n, p, t, s in rows
    ])).alias("x")
    return A.table(spark, sf, "documents").select(F.lit(1).alias("gen"), d.alias("locus"), cells).select("gen", "locus", "x.*")


def _root(spark, sf, pats=None, nodes=None):
    nodes = _locus_trees(spark, sf) if nodes is None else nodes
    branches = G.branches(nodes).select("gen", "locus", "node_id", (F.col("parent_time") - F.col("time")).alias("t"), F.lit("JC69").alias("model"))
    pmats = K.transition_probs(branches).select("gen", "locus", "node_id", F.lit(0).alias("cat"), "p")
    return K.conditional_likelihoods(nodes, cut_lineage(patterns(spark, sf)) if pats is None else pats, pmats)


def _equal(spark, sf):
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"), F.array(*[F.lit(0.25)] * 4).alias("pi"))


def _likelihood_sql() -> str:
    ps, pd = lambda t: f"(0.25 + 0.75 * exp(-4 * ({t}) / 3))", lambda t: f"(0.25 - 0.25 * exp(-4 * ({t}) / 3))"
    tip = lambda m, t, i: f"({pd(t)} * bit_count({m}) + ({ps(t)} - {pd(t)}) * (({m} >> {i}) & 1))"
    up = lambda name, t, i: f"({pd(t)} * ({' + '.join(f'{name}{j}' for j in range(4))}) + ({ps(t)} - {pd(t)}) * {name}{i})"
    l4 = ", ".join(f"{tip('m0', 't1', i)} * {tip('m1', 't1', i)} AS x{i}" for i in range(4))
    l5 = ", ".join(f"{up('x', 't2 - t1', i)} * {tip('m2', 't2', i)} AS y{i}" for i in range(4))
    l6 = ", ".join(f"{up('y', 't3 - t2', i)} * {tip('m3', 't3', i)} AS z{i}" for i in range(4))
    masks = ", ".join(f"CAST(instr('0123456789abcdef', substr(col, {i + 1}, 1)) - 1 AS INTEGER) AS m{i}" for i in range(4))
    return f"""{CHARS}, l3 AS (SELECT locus, pattern_id, weight, {masks}, 0.01 * (1 + locus % 5) AS t1, t1 + 0.01 * (1 + locus % 7) AS t2,
      t2 + 0.02 * (1 + locus % 3) AS t3 FROM pats), l4 AS (SELECT *, {l4} FROM l3), l5 AS (SELECT *, {l5} FROM l4), l6 AS (SELECT *, {l6} FROM l5)"""


@query("conditional_likelihoods", f"WITH {_likelihood_sql()} SELECT locus, pattern_id, weight, round(ln((z0 + z1 + z2 + z3) / 4), 6) AS lnl FROM l6")
def conditional_likelihoods(spark, sf):
    out = K.pattern_log_likelihood(_root(spark, sf), _equal(spark, sf))
    return out.select("locus", "pattern_id", "weight", r("lnl"))


@query("locus_log_likelihood", f"WITH {_likelihood_sql()} SELECT locus, round(sum(weight * ln((z0 + z1 + z2 + z3) / 4)), 4) AS logl FROM l6 GROUP BY 1")
def locus_log_likelihood(spark, sf):
    return K.locus_log_likelihood(_root(spark, sf), _equal(spark, sf)).select("locus", r("logl", 4))


def _diploid_pairs(spark, sf):
    """Patterns of two diploids each: sequences 0 and 1, then 2 and 3, as loci 2d and 2d + 1."""
    halves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("column", 2 * k + 1, 2).alias("column")) for k in (0, 1)])).alias("x")
    each = patterns(spark, sf).select("locus", "pattern_id", "weight", halves)
    keyed = each.select((2 * F.col("locus") + F.col("x.k")).alias("locus"), F.col("x.column").alias("column"), "pattern_id", "weight")
    return cut_lineage(keyed.groupBy("locus", "column").agg(F.min("pattern_id").alias("pattern_id"), F.sum("weight").alias("weight")))


def _diploid_lnl(spark, sf, fixed):
    """Log likelihoods over the phase resolutions; four halves are the tips of the document's tree."""
    pairs = _diploid_pairs(spark, sf)
    both = lambda df: df.withColumn("locus", F.explode(F.array(2 * F.col("locus"), 2 * F.col("locus") + 1)))
    docs = both(A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus")))
    dips = docs.withColumn("seq_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    expanded = P.diploid_expand(pairs, dips, fixed(pairs, dips)).columns
    phased = P.phase_patterns(expanded)
    ids = phased.select("locus", "column", F.substring_index("pattern_id", ".", 1).cast("long").alias("pattern_id"), F.col("pattern_id").alias("weight"))
    # the text key of a phased pattern rides in the weight column
    nodes = both(_locus_trees(spark, sf))
    lnl = K.pattern_log_likelihood(_root(spark, sf, ids, nodes), both(_equal(spark, sf)))
    named = lnl.select("gen", "locus", F.col("weight").alias("pattern_id"), "lnl")
    phase_map = P.phase_pattern_map(expanded, phased)
    weights = pairs.select("locus", F.col("pattern_id").alias("site"), "weight")
    out = K.diploid_log_likelihood(named, phase_map, weights)
    return out.select(F.floor(F.col("locus") / 2).alias("locus"), (F.col("locus") % 2).cast("int").alias("pair"), r("logl", 4))


@query("diploid_log_likelihood")
def diploid_log_likelihood(spark, sf):
    """Phases fixed by the greedy rule, which has no SQL form; the others averaged."""
    return _diploid_lnl(spark, sf, P.diploid_phase_fix)


def _averaged_sql() -> str:
    """Every resolution of a pair of diploids on the four tips of the tree, no phase fixed."""
    code = lambda i, which: f"CAST(CASE WHEN bit_count(d{i}) = 2 THEN {which} ELSE d{i} END AS INTEGER)"
    one = lambda i: f"(d{i} & (-d{i}))"
    two = lambda i: f"(d{i} & (d{i} - 1))"
    half = lambda i, first: code(i, f"CASE WHEN s{i} = {first} THEN {one(i)} ELSE {two(i)} END")
    inner = _likelihood_sql().split("FROM pats)", 1)[1]
    return f"""{CHARS}, q AS (SELECT locus, pattern_id, weight, k, CAST(instr('0123456789abcdef', substr(col, CAST(2 * k + 1 AS INTEGER), 1)) - 1 AS INTEGER) AS d0,
        CAST(instr('0123456789abcdef', substr(col, CAST(2 * k + 2 AS INTEGER), 1)) - 1 AS INTEGER) AS d1 FROM pats, range(2) t(k)),
      site AS (SELECT *, unnest(CASE WHEN bit_count(d0) = 2 THEN [0, 1] ELSE [0] END) AS s0 FROM q),
      res AS (SELECT *, unnest(CASE WHEN bit_count(d1) = 2 THEN [0, 1] ELSE [0] END) AS s1 FROM site),
      l3 AS (SELECT locus, pattern_id, k, weight, {half(0, 0)} AS m0, {half(0, 1)} AS m1, {half(1, 0)} AS m2, {half(1, 1)} AS m3,
        0.01 * (1 + locus % 5) AS t1, t1 + 0.01 * (1 + locus % 7) AS t2, t2 + 0.02 * (1 + locus % 3) AS t3 FROM res){inner},
      mean AS (SELECT locus, k, pattern_id, weight, ln(avg((z0 + z1 + z2 + z3) / 4)) AS lnl FROM l6 GROUP BY 1, 2, 3, 4)"""


@query("diploid_log_likelihood_averaged", f"WITH {_averaged_sql()} SELECT locus, CAST(k AS INTEGER) AS pair, round(sum(weight * lnl), 4) AS logl FROM mean GROUP BY 1, 2")
def diploid_log_likelihood_averaged(spark, sf):
    """No phase fixed: the mean over all resolutions of every site."""
    nothing = spark.createDataFrame([], "locus long, pattern_id long, seq_idx long")
    return _diploid_lnl(spark, sf, lambda pairs, dips: nothing)


# --- traits ------------------------------------------------------------------


def _trait_pops(spark, sf):
    """(((A,B),C),D) per region, ages scaled by the region number."""
    f = F.col("r_regionkey") + 1
    rows = [(1, 5, "A", 0.0), (2, 5, "B", 0.0), (3, 6, "C", 0.0), (4, 7, "D", 0.0), (5, 6, None, 0.1), (6, 7, None, 0.25), (7, None, None, 0.45)]
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("node_id"), F.lit(p).cast("int").alias("parent_id"), F.lit(l).cast("string").alias("label"), (F.lit(t) * f).alias("tau")) for n, p, l, t in rows
    ])).alias("x")
    return A.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("tree_id"), cells).select("tree_id", "x.*")


def _traits(spark, sf):
    c = A.table(spark, sf, "customer")
    label = F.substring(F.lit("ABCD"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1))
    tip, v = F.col("c_custkey") % 4, F.col("c_nationkey")
    state = F.when(tip == 0, 0).when(tip == 1, 1).when(tip == 2, v % 3).otherwise(F.floor(v / 7) % 4)
    return c.select(
        F.lit(0).alias("partition"), label.alias("label"), F.floor(F.col("c_custkey") / 4).cast("int").alias("char_idx"),
        (F.col("c_acctbal") / 1000).alias("value"), F.call_function("shiftleft", F.lit(1), state.cast("int")).alias("state_mask"), F.lit(0.5).alias("v_pop"),
    )


def _rates(spark):
    return spark.createDataFrame([(0, 1, 1.5), (0, 5, 0.8)], "partition int, node_id int, rate double")


_TRAIT = """ch AS (SELECT c_custkey // 4 AS c, max(c_acctbal / 1000) FILTER (c_custkey % 4 = 0) AS a, max(c_acctbal / 1000) FILTER (c_custkey % 4 = 1) AS b,
    max(c_acctbal / 1000) FILTER (c_custkey % 4 = 2) AS cc, max(c_acctbal / 1000) FILTER (c_custkey % 4 = 3) AS d FROM customer GROUP BY 1),
  v AS (SELECT r_regionkey AS tree_id, (r_regionkey + 1) AS f, 0.1 * f * 1.5 + 0.5 AS v1, 0.1 * f + 0.5 AS v2, 0.25 * f + 0.5 AS v3, 0.45 * f + 0.5 AS v4,
    0.15 * f * 0.8 + v1 * v2 / (v1 + v2) AS v5, 0.2 * f + v5 * v3 / (v5 + v3) AS v6 FROM region),
  m AS (SELECT *, (v2 * a + v1 * b) / (v1 + v2) AS m5, (v3 * m5 + v5 * cc) / (v5 + v3) AS m6 FROM ch, v),
  con AS (SELECT tree_id, c, 5 AS node_id, a - b AS x, v1 + v2 AS s FROM m UNION ALL SELECT tree_id, c, 6, cc - m5, v3 + v5 FROM m UNION ALL SELECT tree_id, c, 7, d - m6, v4 + v6 FROM m)"""


@query("independent_contrasts", f"WITH {_TRAIT} SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(c AS INTEGER) AS char_idx, node_id, round(abs(x), 8) AS contrast, round(s, 8) AS total_v FROM con")
def independent_contrasts(spark, sf):
    out = X.independent_contrasts(_trait_pops(spark, sf), _traits(spark, sf), _rates(spark))
    return out.select("tree_id", "char_idx", "node_id", r(F.abs("contrast"), 8).alias("contrast"), r("total_v", 8))


@query(
    "trait_bm_log_likelihood",
    f"WITH {_TRAIT}, n AS (SELECT tree_id, node_id, count(*) AS p, sum(x * x) AS zz, max(s) AS s FROM con GROUP BY 1, 2) "
    "SELECT CAST(tree_id AS BIGINT) AS tree_id, round(-0.5 * sum(p * ln(2 * pi() * s) + 1.25 + zz / s), 4) AS logl FROM n GROUP BY 1",
)
def trait_bm_log_likelihood(spark, sf):
    con = X.independent_contrasts(_trait_pops(spark, sf), _traits(spark, sf), _rates(spark))
    dets = spark.createDataFrame([(0, 1.25)], "partition int, ldet double")
    return X.trait_bm_log_likelihood(con, dets).select("tree_id", r("logl", 4))


def _mkv_sql() -> str:
    def send(vec, t):
        ch = f"((1 - exp(-({t}) * k / (k - 1.0))) / k)"
        return f"list_transform({vec}, lambda q: {ch} * list_sum({vec}) + (1 - k * {ch}) * q)"

    def tip(state, t):
        return send(f"list_transform(range(k), lambda j: CASE WHEN {state} IS NULL OR j = {state} THEN 1.0::DOUBLE ELSE 0.0 END)", t)

    mul = lambda x, y: f"list_transform(list_zip({x}, {y}), lambda e: e[1] * e[2])"
    return f"""WITH st AS (SELECT c_custkey // 4 AS c, max(c_nationkey % 3) FILTER (c_custkey % 4 = 2) AS s2, max(c_nationkey // 7 % 4) FILTER (c_custkey % 4 = 3) AS s3 FROM customer GROUP BY 1),
      ch AS (SELECT count(*) AS n, 0 AS s0, 1 AS s1, s2, s3, greatest(2, s2 + 1, s3 + 1) AS k FROM st GROUP BY 3, 4, 5, 6
        UNION ALL SELECT 0, 0, 0, 0, 0, k FROM (VALUES (2), (3), (4)) g(k)),
      t AS (SELECT ch.*, r_regionkey AS tree_id, (r_regionkey + 1) AS f FROM ch, region),
      a AS (SELECT *, {tip('s0', '0.1 * f * 1.5')} AS m1, {tip('s1', '0.1 * f')} AS m2, {tip('s2', '0.25 * f')} AS m3, {tip('s3', '0.45 * f')} AS m4 FROM t),
      b AS (SELECT *, {mul('m1', 'm2')} AS l5 FROM a), c AS (SELECT *, {send('l5', '0.15 * f * 0.8')} AS m5 FROM b),
      d AS (SELECT *, {mul('m5', 'm3')} AS l6 FROM c), e AS (SELECT *, {send('l6', '0.2 * f')} AS m6 FROM d),
      g AS (SELECT tree_id, n, k, list_sum({mul('m6', 'm4')}) / k AS prob FROM e)
    SELECT CAST(x.tree_id AS BIGINT) AS tree_id, round(sum(x.n * (ln(x.prob) - ln(1 - y.prob * y.k))), 4) AS logl FROM g x JOIN g y ON x.tree_id = y.tree_id AND x.k = y.k AND y.n = 0 AND x.n > 0 GROUP BY 1"""


@query("trait_mkv_log_likelihood", _mkv_sql())
def trait_mkv_log_likelihood(spark, sf):
    out = X.trait_mkv_log_likelihood(_trait_pops(spark, sf), _traits(spark, sf), _rates(spark))
    return out.select("tree_id", r("logl", 4))
