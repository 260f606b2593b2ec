"""Queries over tree and delimitation samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import delimit as D
from lociframe.operators import trees as T
from lociframe.plans.registry import query, r
from lociframe.sources import adapters as A

U = "(o_orderkey * 7919) % 1000"
SHAPES = ("(((A,B),C),D);", "(((A,C),B),D);", "((A,B),(C,D));", "((A,(B,C)),D);")
SWAPPED = ("(D,(C,(A,B)));", "(D,(B,(A,C)));", "((C,D),(B,A));", "(D,(A,(B,C)));")
PLAIN = ("(((A,B),C),D);", "(((A,C),B),D);", "((A,B),(C,D));", "(((B,C),A),D);")
CLADES = (("A,B", "A,B,C"), ("A,C", "A,B,C"), ("A,B", "C,D"), ("B,C", "A,B,C"))


def _case(values) -> str:
    q = [f"'{v}'" for v in values]
    return f"CASE WHEN u < 550 THEN {q[0]} WHEN u < 750 THEN {q[1]} WHEN u < 900 THEN {q[2]} ELSE {q[3]} END"


SAMPLE = f"""sample AS (SELECT o_orderkey AS gen, {U} AS u FROM orders),
  topo AS (SELECT gen, u, {_case(SHAPES)} AS topology,
    CASE WHEN gen % 2 = 1 THEN {_case(SWAPPED)} ELSE {_case(PLAIN)} END AS newick FROM sample),
  clade AS (SELECT gen, unnest(string_split({_case(["|".join(c) for c in CLADES])}, '|')) AS clade FROM sample),
  tp AS (SELECT topology, count(*) AS n, count(*) / (SELECT count(*) FROM sample)::DOUBLE AS p FROM topo GROUP BY 1),
  cp AS (SELECT clade, count(*) AS n, count(*) / (SELECT count(*) FROM sample)::DOUBLE AS freq FROM clade GROUP BY 1)"""

TIMED = f"""timed AS (SELECT *, y0 + k % 13 + 1 AS z0 FROM (SELECT *, x0 + CASE WHEN k % 5 = 0 THEN 0 ELSE k % 11 + 1 END AS y0 FROM (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 + 1 END AS x0,
      CASE WHEN {U} < 700 THEN ['A', 'B', 'C', 'D'] ELSE ['B', 'C', 'A', 'D'] END AS nm FROM orders))),
  nodes AS (SELECT k, x0 / 1000.0 AS x, y0 / 1000.0 AS y, z0 / 1000.0 AS z, nm, v.* FROM timed, (VALUES
    (1, NULL, 0, NULL, 4, 7), (2, 1, 1, NULL, 3, 5), (3, 2, 2, NULL, 2, 3), (4, 3, 3, 1, 1, 1), (5, 3, 3, 2, 1, 1), (6, 2, 2, 3, 1, 1), (7, 1, 1, 4, 1, 1))
    v(node_id, parent_id, depth, tip, n_leaves, n_nodes)),
  delim AS (SELECT k, CASE WHEN y0 = 0 THEN ['ABC', 'D'] WHEN x0 = 0 THEN list_sort([list_aggregate(list_sort(nm[1:2]), 'string_agg', ''), nm[3], 'D'])
      ELSE ['A', 'B', 'C', 'D'] END AS species,
    CASE WHEN y0 = 0 THEN '(ABC,D);' WHEN x0 = 0 AND nm[1] = 'A' THEN '((AB,C),D);' WHEN x0 = 0 THEN '((A,BC),D);'
      WHEN nm[1] = 'A' THEN '(((A,B),C),D);' ELSE '((A,(B,C)),D);' END AS tree FROM timed),
  total AS (SELECT count(*)::DOUBLE AS t FROM timed)"""


@query(
    "newick_nodes",
    f"""WITH {TIMED} SELECT k AS gen, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, nm[tip] AS label,
      round(CASE node_id WHEN 2 THEN z - y WHEN 3 THEN y - x WHEN 4 THEN x WHEN 5 THEN x WHEN 6 THEN y WHEN 7 THEN z END, 6) AS length,
      tip IS NOT NULL AS is_tip, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(depth AS BIGINT) AS depth FROM nodes""",
)
def newick_nodes(spark, sf):
    nodes = T.newick_nodes(A.timed_trees(spark, sf), ["gen"])
    long = lambda c: F.col(c).cast("long").alias(c)
    return nodes.select(
        "gen", long("node_id"), long("parent_id"), "label", r("length"), "is_tip", long("n_leaves"), long("n_nodes"), long("depth")
    )


@query("strip_tree_attributes", f"WITH {SAMPLE} SELECT newick, count(*) AS n FROM topo GROUP BY 1")
def strip_tree_attributes(spark, sf):
    noisy = A.tree_sample(spark, sf).withColumn(
        "newick", F.regexp_replace("newick", r"([ABCD)])", F.lit(" $1 #0.01:0.25[&rate=1.5]"))
    )
    stripped = T.strip_tree_attributes(noisy)
    return stripped.groupBy("newick").agg(F.count(F.lit(1)).alias("n"))


@query("strip_tree_thetas", f"WITH {SAMPLE} SELECT regexp_replace(newick, '([ABCD)])', '\\1:0.25', 'g') AS newick, count(*) AS n FROM topo GROUP BY 1")
def strip_tree_thetas(spark, sf):
    noisy = A.tree_sample(spark, sf).withColumn("newick", F.regexp_replace("newick", r"([ABCD)])", F.lit("$1 #0.01:0.25")))
    return T.strip_tree_attributes(noisy, keep_lengths=True).groupBy("newick").agg(F.count(F.lit(1)).alias("n"))


def _key(df):
    return df.withColumn("clade", T.clade_key(F.col("clade")))


def _support(spark, sf):
    trees = A.tree_sample(spark, sf)
    return T.clade_posterior(T.clade_counts(trees), trees)


@query("clades", f"WITH {SAMPLE} SELECT gen, clade FROM clade")
def clades(spark, sf):
    return _key(T.tree_taxa(A.tree_sample(spark, sf), ["gen"], proper=True)).select("gen", "clade")


@query("canonical_topology", f"WITH {SAMPLE} SELECT gen, topology FROM topo")
def canonical_topology(spark, sf):
    return T.tree_topologies(A.tree_sample(spark, sf), ["gen"])


@query(
    "topology_posterior",
    f"WITH {SAMPLE} SELECT topology, n, round(p, 6) AS p, round(sum(p) OVER (ORDER BY n DESC, md5(topology) ROWS UNBOUNDED PRECEDING), 6) AS cum_p FROM tp",
)
def topology_posterior(spark, sf):
    out = T.topology_posterior(T.topology_counts(A.tree_sample(spark, sf)))
    return out.select("topology", "n", r("p"), r("cum_p"))


_BITS = "CASE WHEN contains(clade, 'A') THEN '1' ELSE '0' END || CASE WHEN contains(clade, 'B') THEN '1' ELSE '0' END || CASE WHEN contains(clade, 'C') THEN '1' ELSE '0' END || CASE WHEN contains(clade, 'D') THEN '1' ELSE '0' END"


@query("clade_posterior", f"WITH {SAMPLE} SELECT clade, n, round(freq, 6) AS freq, {_BITS} AS bits FROM cp")
def clade_posterior(spark, sf):
    return _key(_support(spark, sf)).select("clade", "n", r("freq"), "bits")


@query("majority_clades", f"WITH {SAMPLE} SELECT clade, round(freq, 6) AS freq FROM cp WHERE freq >= 0.5 UNION ALL SELECT 'A,B,C,D', 1.0")
def majority_clades(spark, sf):
    return _key(T.majority_clades(_support(spark, sf))).select("clade", r("freq"))


@query(
    "majority_consensus",
    f"""WITH {SAMPLE}, m AS (SELECT clade, freq, len(string_split(clade, ',')) AS size FROM cp WHERE freq >= 0.5 UNION ALL SELECT 'A,B,C,D', 1.0, 4)
    SELECT a.clade AS key, (SELECT arg_min(b.clade, b.size) FROM m b WHERE b.size > a.size
      AND list_has_all(string_split(b.clade, ','), string_split(a.clade, ','))) AS parent, round(a.freq, 6) AS freq FROM m a""",
)
def majority_consensus(spark, sf):
    return T.majority_consensus(T.majority_clades(_support(spark, sf)))[0].select("key", "parent", r("freq"))


@query("canonical_topology_of_nodes", f"WITH {SAMPLE} SELECT gen, topology FROM topo")
def canonical_topology_of_nodes(spark, sf):
    """The same from a node table, which need not come from a text."""
    return T.canonical_topology(T.newick_nodes(A.tree_sample(spark, sf), ["gen"]), ["gen"])


@query("clades_of_nodes", f"WITH {SAMPLE} SELECT gen, clade FROM clade")
def clades_of_nodes(spark, sf):
    return _key(T.clades(T.newick_nodes(A.tree_sample(spark, sf), ["gen"]), ["gen"])).select("gen", "clade")


def _halves(spark, sf):
    """Two trees an order, one with A and B together and one with A and C: clades in exactly half of the trees."""
    even = F.col("o_orderkey") % 2 == 0
    one = F.when(even, "((((A,B),C),D),E);").otherwise("(((A,B),(C,D)),E);")
    two = F.when(even, "((((A,C),B),D),E);").otherwise("(((A,C),(B,D)),E);")
    keyed = A.table(spark, sf, "orders").select("o_orderkey", F.posexplode(F.array(one, two)).alias("half", "newick"))
    return keyed.select(F.lit("c1").alias("chain"), (F.col("o_orderkey") * 2 + F.col("half")).alias("gen"), "newick")


_HALVES = """h(clade, n) AS (SELECT c, sum(CASE WHEN odd IS NULL THEN 1 WHEN odd = (o_orderkey % 2 <> 0) THEN 1 ELSE 0 END * w) FROM orders,
    (VALUES ('A,B', NULL, 1), ('A,C', NULL, 1), ('A,B,C', FALSE, 2), ('C,D', TRUE, 1), ('B,D', TRUE, 1), ('A,B,C,D', NULL, 2)) v(c, odd, w) GROUP BY 1),
  m AS (SELECT clade, string_split(clade, ',') AS s, n / (2.0 * (SELECT count(*) FROM orders)) AS freq FROM h
    WHERE n >= (SELECT count(*) FROM orders) UNION ALL SELECT 'A,B,C,D,E', ['A', 'B', 'C', 'D', 'E'], 1.0)"""


@query(
    "consensus_conflicts",
    f"""WITH {SAMPLE} SELECT a.clade AS key, b.clade AS key2, CAST(len(list_intersect(string_split(a.clade, ','), string_split(b.clade, ','))) AS BIGINT) AS common
    FROM cp a JOIN cp b ON a.clade < b.clade AND len(list_intersect(string_split(a.clade, ','), string_split(b.clade, ','))) BETWEEN 1
      AND least(len(string_split(a.clade, ',')), len(string_split(b.clade, ','))) - 1""",
)
def consensus_conflicts(spark, sf):
    """Overlapping clades when every clade is admitted."""
    return T.clade_conflicts(_support(spark, sf))


@query(
    "consensus_conflicts_at_half",
    f"""WITH {_HALVES} SELECT a.clade AS key, b.clade AS key2, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS common
    FROM m a JOIN m b ON a.clade < b.clade AND len(list_intersect(a.s, b.s)) BETWEEN 1 AND least(len(a.s), len(b.s)) - 1""",
)
def consensus_conflicts_at_half(spark, sf):
    """Clades in exactly half of the trees that overlap without nesting."""
    trees = _halves(spark, sf)
    return T.majority_consensus(T.majority_clades(T.clade_posterior(T.clade_counts(trees), trees)))[1]


@query(
    "consensus_with_conflicts",
    f"""WITH {_HALVES} SELECT a.clade AS key, (SELECT arg_min(b.clade, len(b.s)) FROM m b WHERE len(b.s) > len(a.s) AND list_has_all(b.s, a.s)) AS parent,
    round(a.freq, 6) AS freq FROM m a""",
)
def consensus_with_conflicts(spark, sf):
    trees = _halves(spark, sf)
    return T.majority_consensus(T.majority_clades(T.clade_posterior(T.clade_counts(trees), trees)))[0].select("key", "parent", r("freq"))


@query(
    "map_trees",
    f"""WITH {SAMPLE} SELECT DISTINCT topology, tp.n, round(tp.p, 6) AS p, clade, round(freq, 6) AS freq FROM tp JOIN topo USING (topology) JOIN clade USING (gen) JOIN cp USING (clade)
    WHERE tp.n = (SELECT max(n) FROM tp)""",
)
def map_trees(spark, sf):
    trees = A.tree_sample(spark, sf)
    out = T.map_trees(T.topology_posterior(T.topology_counts(trees)), _support(spark, sf))
    return _key(out).select("topology", "n", r("p"), "clade", r("freq"))


@query("tree_clade_support", f"WITH {SAMPLE} SELECT gen, clade, round(freq, 6) AS freq FROM clade JOIN cp USING (clade)")
def tree_clade_support(spark, sf):
    found = T.tree_taxa(A.tree_sample(spark, sf), ["gen"], proper=True)
    return _key(T.tree_clade_support(found, _support(spark, sf))).select("gen", "clade", r("freq"))


@query("best_models", f"WITH {SAMPLE} SELECT topology, n FROM tp ORDER BY n DESC, topology LIMIT 3")
def best_models(spark, sf):
    return T.best_models(T.topology_counts(A.tree_sample(spark, sf)), "topology", 3)


@query("order_by_size", f"WITH {SAMPLE} SELECT clade, CAST(len(string_split(clade, ',')) AS INTEGER) AS size, n FROM cp")
def order_by_size(spark, sf):
    return _key(T.order_by_size(_support(spark, sf))).select("clade", "size", "n")


@query("clade_union", f"WITH {SAMPLE} SELECT gen, string_agg(DISTINCT t, ',' ORDER BY t) AS clade FROM (SELECT gen, unnest(string_split(clade, ',')) AS t FROM clade) GROUP BY 1")
def clade_union(spark, sf):
    found = T.tree_taxa(A.tree_sample(spark, sf), ["gen"], proper=True)
    return _key(T.clade_union(found, ["gen"]))


@query(
    "taxon_complement",
    f"WITH {SAMPLE} SELECT gen, array_to_string(list_filter(['A', 'B', 'C', 'D'], lambda t: NOT contains(clade, t)), ',') AS clade FROM clade",
)
def taxon_complement(spark, sf):
    trees = A.tree_sample(spark, sf)
    found = T.tree_taxa(trees, ["gen"], proper=True).select("gen", "clade")
    taxa = T.distinct_newicks(trees).select(F.explode(F.expr("regexp_extract_all(newick, '[A-Z]', 0)")).alias("taxon"))
    return _key(T.taxon_complement(found, taxa))


@query("distinct_topologies", f"WITH {SAMPLE} SELECT DISTINCT topology FROM topo")
def distinct_topologies(spark, sf):
    return T.distinct_topologies(A.tree_sample(spark, sf))


@query(
    "clade_intersection",
    f"WITH {SAMPLE} SELECT DISTINCT clade FROM clade JOIN sample USING (gen) WHERE u < 550 INTERSECT SELECT DISTINCT clade FROM clade JOIN sample USING (gen) WHERE u >= 550",
)
def clade_intersection(spark, sf):
    trees = A.tree_sample(spark, sf).withColumn("u", (F.col("gen") * 7919) % 1000)
    one, two = T.clade_counts(trees.filter("u < 550")), T.clade_counts(trees.filter("u >= 550"))
    return _key(T.clade_intersection(one, two))


@query("classify_trees", f"WITH {SAMPLE} SELECT gen, CASE gen % 3 WHEN 0 THEN 'rooted binary' WHEN 1 THEN 'unrooted binary' ELSE 'n-ary' END AS kind FROM sample")
def classify_trees(spark, sf):
    shape = F.when(F.col("gen") % 3 == 0, F.col("newick")).when(F.col("gen") % 3 == 1, F.concat(F.lit("(X,Y,"), F.expr("substr(newick, 1, length(newick) - 1)"), F.lit(");")))
    other = F.concat(F.lit("((W,X,Y),"), F.expr("substr(newick, 1, length(newick) - 1)"), F.lit(");"))
    return T.classify_trees(A.tree_sample(spark, sf).withColumn("newick", F.coalesce(shape, other)), ["gen"])


@query("comply", f"WITH {SAMPLE} SELECT newick, count(*) AS n, bool_and(u < 550) AS complies FROM topo GROUP BY 1")
def comply(spark, sf):
    """Constraint tree ((A,B),C) and the alias X = all but D."""
    constraints = spark.createDataFrame([("c1", "((A,B),C);")], "constraint_id string, newick string")
    taxa = spark.createDataFrame([(t,) for t in "ABCD"], "taxon string")
    aliases = spark.createDataFrame([("X", ["D"], True)], "name string, clade array<string>, negated boolean")
    named = spark.createDataFrame([("c2", ["X"])], "constraint_id string, clade array<string>")
    required = T.constraint_clades(constraints).unionByName(T.expand_definitions(named, aliases, taxa))
    outgroup = T.outgroup_constraint(spark.createDataFrame([("D",)], "taxon string"), taxa)
    return T.comply(A.tree_sample(spark, sf), required.unionByName(outgroup.select("constraint_id", "clade")))


@query("labelled_histories", f"WITH {SAMPLE} SELECT gen, CASE WHEN u >= 750 AND u < 900 THEN 2.0 ELSE 1.0 END::DOUBLE AS histories FROM sample")
def labelled_histories(spark, sf):
    trees = T.strip_tree_attributes(A.tree_sample(spark, sf))
    texts = T.distinct_newicks(trees)
    counted = T.labelled_histories(T.newick_nodes(texts, ["newick"]), ["newick"])
    return trees.join(counted, "newick").select("gen", "histories")


_DELIM = f"""d AS (SELECT a || (a * b) || (a * b * c) AS model FROM (SELECT CASE WHEN u % 10 < 8 THEN 1 ELSE 0 END AS a,
  CASE WHEN u // 10 % 10 < 6 THEN 1 ELSE 0 END AS b, CASE WHEN u // 100 % 10 < 5 THEN 1 ELSE 0 END AS c FROM (SELECT {U} AS u FROM orders))),
  post AS (SELECT m.model, count(d.model) AS n, count(d.model) / (SELECT count(*) FROM orders)::DOUBLE AS p
    FROM (VALUES ('000'), ('100'), ('110'), ('111'), ('101')) m(model) LEFT JOIN d ON d.model = m.model GROUP BY 1)"""


def _delim_post(spark, sf):
    models = spark.createDataFrame([(m,) for m in ("000", "100", "110", "111", "101")], "model string")
    return D.delimitation_posterior(A.delim_sample(spark, sf), models)


@query("delimitation_posterior", f"WITH {_DELIM} SELECT model, n, round(p, 6) AS p FROM post")
def delimitation_posterior(spark, sf):
    return _delim_post(spark, sf).select("model", "n", r("p"))


@query("guide_node_support", f"WITH {_DELIM} SELECT CAST(j AS INTEGER) AS node, round(sum(CASE WHEN substr(model, CAST(j + 1 AS INTEGER), 1) = '1' THEN p ELSE 0 END), 6) AS support FROM post, range(3) t(j) GROUP BY 1")
def guide_node_support(spark, sf):
    return D.guide_node_support(_delim_post(spark, sf)).select("node", r("support"))


@query("posterior_vs_prior", f"WITH {_DELIM} SELECT model, n, round(p, 6) AS p, CASE WHEN model <> '101' THEN 0.25 END::DOUBLE AS prior FROM post")
def posterior_vs_prior(spark, sf):
    from lociframe.operators.trace import posterior_vs_prior as join_prior

    prior = spark.createDataFrame([(m, 0.25) for m in ("000", "100", "110", "111")], "model string, prior double")
    return join_prior(_delim_post(spark, sf), prior, "model").select("model", "n", r("p"), "prior")


def _models(spark, sf):
    return D.delimited_models(D.collapse_zero_branches(A.timed_trees(spark, sf), ["gen"], 4))


@query("collapse_zero_branches", f"WITH {TIMED} SELECT k AS gen, array_to_string(species, ' ') AS species, tree, CAST(len(species) AS INTEGER) AS n_species FROM delim")
def collapse_zero_branches(spark, sf):
    out = D.collapse_zero_branches(A.timed_trees(spark, sf), ["gen"], 4)
    return out.select("gen", F.array_join("species", " ").alias("species"), "tree", "n_species")


@query(
    "joint_model_posterior",
    f"""WITH {TIMED}, j AS (SELECT tree, array_to_string(species, ' ') AS species, CAST(len(species) AS INTEGER) AS n_species, count(*) AS n FROM delim GROUP BY 1, 2, 3)
    SELECT n_species, species, tree, n, round(n / t, 6) AS p, round(sum(n) OVER (ORDER BY n DESC, md5(tree) ROWS UNBOUNDED PRECEDING) / t, 6) AS cum_p FROM j, total""",
)
def joint_model_posterior(spark, sf):
    out = D.joint_model_posterior(_models(spark, sf))
    return out.select("n_species", "species", "tree", "n", r("p"), r("cum_p"))


@query("delimitation_set_posterior", f"WITH {TIMED} SELECT array_to_string(species, ' ') AS species, CAST(len(species) AS INTEGER) AS n_species, count(*) AS n, round(count(*) / max(t), 6) AS p FROM delim, total GROUP BY 1, 2")
def delimitation_set_posterior(spark, sf):
    return D.delimitation_set_posterior(_models(spark, sf)).select("species", "n_species", "n", r("p"))


@query("species_posterior", f"WITH {TIMED} SELECT s AS species, count(*) AS n, round(count(*) / max(t), 6) AS p FROM (SELECT unnest(species) AS s FROM delim), total GROUP BY 1")
def species_posterior(spark, sf):
    return D.species_posterior(_models(spark, sf)).select("species", "n", r("p"))


@query("species_count_posterior", f"WITH {TIMED} SELECT k2 AS k, count(d.k) AS n, round(count(d.k) / max(t), 6) AS p FROM range(1, 5) g(k2) CROSS JOIN total LEFT JOIN delim d ON len(d.species) = k2 GROUP BY 1")
def species_count_posterior(spark, sf):
    return D.species_count_posterior(_models(spark, sf), 4).select("k", "n", r("p"))
