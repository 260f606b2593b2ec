"""Tree samples: bulk parsing, topologies, clades and consensus.

Posterior trees repeat: branch lengths differ but topologies are few.  The
topology and clade operators therefore strip attributes, collapse equal strings
to one row with a count, and parse only those, each to one row (``newick.py``).
Functions that take ``nodes`` work on any node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import mathfns as M
from lociframe.functions.blocks import cumulative_by_count
from lociframe.operators.newick import newick_nodes, tree_taxa, tree_topologies

def strip_tree_attributes(trees: DataFrame, keep_lengths: bool = False) -> DataFrame:
    """Remove whitespace and the ``#...`` / ``:...`` / ``[...]`` parts of nodes.

    With ``keep_lengths`` only whitespace and ``#...`` go.
    """
    text = F.regexp_replace("newick", r"\s+", "")
    if keep_lengths:
        return trees.withColumn("newick", F.regexp_replace(text, r"#[^,();:]*", ""))
    text = F.regexp_replace(text, r"\[[^\]]*\]", "")
    return trees.withColumn("newick", F.regexp_replace(text, r"[#:][^,();]*", ""))


def with_taxa(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``taxa``, the sorted leaf labels below each node."""
    everywhere = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tips = F.sort_array(F.collect_list(F.when(F.col("is_tip"), F.struct("first_tip", "label"))).over(everywhere))
    labels = F.transform(tips, lambda t: t["label"])
    return nodes.withColumn("_labels", labels).withColumn(
        "taxa", F.sort_array(F.slice("_labels", F.col("first_tip").cast("int"), F.col("n_leaves").cast("int")))
    ).drop("_labels")


def clade_key(taxa: Column) -> Column:
    return F.array_join(taxa, ",")


def clades(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Inner nodes except the root, as sorted taxon arrays."""
    return (
        with_taxa(nodes, keys)
        .filter("not is_tip and parent_id is not null")
        .select(*keys, "node_id", F.col("taxa").alias("clade"), "n_leaves")
    )


def canonical_topology(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topology): a Newick text that is equal for equal rooted trees.

    Sibling order follows the sorted leaf labels below each sibling.  A tip's
    place is fixed by the chain of clades above it; brackets open and close
    where consecutive tips stop sharing ancestors.
    """
    inner = with_taxa(nodes, keys).filter("not is_tip")
    above = inner.select(
        *keys,
        F.explode("taxa").alias("tip"),
        F.struct((-F.col("n_leaves")).alias("size"), F.array_join("taxa", "").alias("name"), "node_id").alias("a"),
    )
    chains = above.groupBy(*keys, "tip").agg(F.sort_array(F.collect_list("a")).alias("chain")).select(
        *keys,
        "tip",
        F.concat(F.transform("chain", lambda a: a["name"]), F.array("tip")).alias("place"),
        F.transform("chain", lambda a: a["node_id"]).alias("ancestors"),
    )
    w = Window.partitionBy(*keys).orderBy("place")
    none = F.array().cast("array<int>")
    gap = lambda other: F.size(F.array_except("ancestors", F.coalesce(other, none)))
    piece = F.concat(
        F.repeat(F.lit("("), gap(F.lag("ancestors").over(w))), "tip", F.repeat(F.lit(")"), gap(F.lead("ancestors").over(w)))
    )
    pieces = chains.withColumn("piece", piece).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("t")
    )
    return pieces.select(*keys, F.concat(F.array_join(F.transform("t", lambda x: x["piece"]), ","), F.lit(";")).alias("topology"))


def distinct_newicks(trees: DataFrame) -> DataFrame:
    """(newick, n): attribute-free trees with their number of samples."""
    return strip_tree_attributes(trees).groupBy("newick").agg(F.count(F.lit(1)).alias("n"))


def topology_counts(trees: DataFrame) -> DataFrame:
    """(topology, n) over a tree sample."""
    return tree_topologies(distinct_newicks(trees), ["n"]).groupBy("topology").agg(F.sum("n").alias("n"))


def clade_counts(trees: DataFrame) -> DataFrame:
    """(clade, n) over a tree sample."""
    return tree_taxa(distinct_newicks(trees), ["n"], proper=True).groupBy("clade").agg(F.sum("n").alias("n"))


def topology_posterior(counts: DataFrame) -> DataFrame:
    """Share and cumulative share, by descending count."""
    total = counts.agg(F.sum("n").alias("_total"))
    ranked = cumulative_by_count(counts, [], "n", "topology", "_cum").crossJoin(F.broadcast(total))
    return ranked.select(
        "topology", "n", (F.col("n") / F.col("_total")).alias("p"), (F.col("_cum") / F.col("_total")).alias("cum_p")
    )


def clade_posterior(counts: DataFrame, trees: DataFrame) -> DataFrame:
    """Clade frequency with a 0/1 string over the sorted species."""
    total = trees.agg(F.count(F.lit(1)).alias("_total"))
    # one row holding each species name once
    tips = distinct_newicks(trees).select(
        F.explode(F.expr(r"regexp_extract_all(newick, r'[^(),;]+', 0)")).alias("s")
    ).agg(F.array_sort(F.collect_set("s")).alias("_species"))
    both = counts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(tips))
    bits = F.array_join(F.transform("_species", lambda s: F.array_contains("clade", s).cast("int").cast("string")), "")
    return both.select(
        "clade",
        "n",
        (F.col("n") / F.col("_total")).alias("freq"),
        bits.alias("bits"),
        F.size("clade").alias("size"),
        F.col("_species").alias("species"),
    )


def majority_clades(posterior: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Clades with frequency >= threshold, at least 0.5, then the full species set."""
    if threshold < 0.5:
        raise ValueError("clades of frequency below 0.5 need not nest")
    kept = posterior.filter(F.col("freq") >= threshold).select("clade", "freq", "size")
    return kept.unionByName(species_set(posterior)).orderBy("size", clade_key(F.col("clade")))


def species_set(posterior: DataFrame) -> DataFrame:
    """One row: all species of the clade table, present in every tree."""
    whole = posterior.select(F.explode("species").alias("s")).agg(F.array_sort(F.collect_set("s")).alias("clade"))
    return whole.select("clade", F.lit(1.0).alias("freq"), F.size("clade").alias("size"))


def majority_consensus(majority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, parent, freq, size): each majority clade below its smallest strict superset; and (key, key2, common): the
    pairs that overlap without nesting.

    For every taxon its clades are put in order of size, and each clade names the one after it.  Two clades that both
    are in more than half of the trees stand together in one of them, so they nest: all taxa of a clade then name the
    same next clade, and as many as the clade has, which is the proof that it is a superset.  Only where taxa disagree
    clades are compared with each other, and these are clades of frequency exactly 0.5.
    """
    keyed = majority.select("clade", "freq", "size", clade_key(F.col("clade")).alias("key"))
    members = keyed.select("key", "size", "freq", F.explode("clade").alias("taxon"))
    chain = Window.partitionBy("taxon").orderBy("size", "key")
    steps = members.withColumn("next", F.lead("key").over(chain))
    named = steps.groupBy("key", "size", "next").agg(F.count(F.lit(1)).alias("taxa")).filter("next is not null")
    nested = named.filter("taxa = size").select("key", F.col("next").alias("parent"))
    broken = named.filter("taxa < size").select("key").distinct()

    one = members.join(broken, "key", "left_semi").select("key", "size", "taxon")
    other = members.select(F.col("key").alias("key2"), F.col("size").alias("size2"), "taxon")
    shared = one.join(other, "taxon").filter("size2 > size").groupBy("key", "size", "key2", "size2").agg(F.count(F.lit(1)).alias("common"))
    found = shared.filter("common = size").groupBy("key").agg(F.min(F.struct("size2", "key2")).alias("up"))
    parents = nested.unionByName(found.select("key", F.col("up.key2").alias("parent")))

    # a clade in conflict shares a taxon with a broken one, and both have frequency 0.5
    ties = members.filter("freq = 0.5").select("key", "size", "taxon")
    touched = members.join(broken, "key", "left_semi").select("taxon").distinct()
    suspects = ties.join(ties.join(touched, "taxon", "left_semi").select("key").distinct(), "key", "left_semi")
    second = suspects.select(F.col("key").alias("key2"), F.col("size").alias("size2"), "taxon")
    pairs = suspects.join(second, "taxon").filter("key < key2").groupBy("key", "size", "key2", "size2").agg(F.count(F.lit(1)).alias("common"))
    conflicts = pairs.filter("common < least(size, size2)").select("key", "key2", "common")
    return keyed.join(parents, "key", "left").select("key", "parent", "freq", "size"), conflicts


def clade_conflicts(clade_table: DataFrame) -> DataFrame:
    """(key, key2, common): all pairs of clades that overlap without nesting, whatever their frequencies.

    Two clades meet at each taxon that both have and are compared at the first of these, so no row but the result's
    leaves the join.
    """
    one = clade_table.select(clade_key(F.col("clade")).alias("key"), "clade", F.explode("clade").alias("taxon"))
    two = one.select(F.col("key").alias("key2"), F.col("clade").alias("clade2"), "taxon")
    common = F.array_intersect("clade", "clade2")
    met = one.join(two, "taxon").filter("key < key2").withColumn("_both", common).filter(F.col("taxon") == F.array_min("_both"))
    overlap = F.size("_both") < F.least(F.size("clade"), F.size("clade2"))
    return met.filter(overlap).select("key", "key2", F.size("_both").cast("long").alias("common"))


def tree_clade_support(tree_clades: DataFrame, posterior: DataFrame) -> DataFrame:
    """Annotate clades with their frequency; an unseen clade is an error."""
    joined = tree_clades.join(posterior.select("clade", "freq"), "clade", "left")
    missing = F.raise_error(F.concat(F.lit("no frequency for clade "), clade_key(F.col("clade")))).cast("double")
    return joined.withColumn("freq", F.coalesce("freq", missing))


def map_trees(topologies: DataFrame, posterior: DataFrame) -> DataFrame:
    """The topologies tied for the highest count, one row per supported clade."""
    top = topologies.agg(F.max("n").alias("_top"))
    best = topologies.crossJoin(F.broadcast(top)).filter("n = _top").drop("_top")
    found = tree_taxa(best.withColumn("newick", F.col("topology")), ["topology", "n", "p"], proper=True)
    return tree_clade_support(found, posterior).select("topology", "n", "p", "clade", "freq")


def best_models(posterior: DataFrame, item: str, k: int) -> DataFrame:
    """The k most frequent models; ties by text."""
    return posterior.orderBy(F.desc("n"), item).limit(k)


def order_by_size(clade_table: DataFrame) -> DataFrame:
    return clade_table.orderBy(F.size("clade"), clade_key(F.col("clade")))


def clade_union(child_clades: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the taxa of all rows with equal ``keys``."""
    return child_clades.select(*keys, F.explode("clade").alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("clade"))


def taxon_complement(definitions: DataFrame, taxa: DataFrame) -> DataFrame:
    """All taxa minus each definition; ``taxa`` is the analysis' species list."""
    everything = taxa.agg(F.array_sort(F.collect_set("taxon")).alias("_all"))
    return definitions.crossJoin(F.broadcast(everything)).withColumn("clade", F.array_except("_all", "clade")).drop("_all")


def distinct_topologies(trees: DataFrame) -> DataFrame:
    return topology_counts(trees).select("topology")


def clade_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """Clades seen in both tree samples."""
    return first.select("clade").join(second.select("clade"), "clade", "left_semi").distinct()


def classify_trees(trees: DataFrame, keys: list[str]) -> DataFrame:
    """Rooted binary, unrooted binary (three root children) or n-ary.

    Rows without a bracket are not trees and are dropped.
    """
    nodes = newick_nodes(trees.filter(F.col("newick").contains("(")), keys)
    arity = nodes.filter("parent_id is not null").groupBy(*keys, "parent_id").agg(F.count(F.lit(1)).alias("k"))
    root, inner = F.col("parent_id") == 1, F.col("parent_id") != 1
    per_tree = arity.groupBy(*keys).agg(
        F.max(F.when(root, F.col("k"))).alias("root_k"),
        F.coalesce(F.min(F.when(inner, F.col("k") == 2)), F.lit(True)).alias("binary"),
    )
    return per_tree.select(
        *keys,
        F.when(F.col("binary") & (F.col("root_k") == 2), "rooted binary")
        .when(F.col("binary") & (F.col("root_k") == 3), "unrooted binary")
        .otherwise("n-ary")
        .alias("kind"),
    )


def expand_definitions(constraints: DataFrame, definitions: DataFrame, taxa: DataFrame) -> DataFrame:
    """Replace alias names in constraint clades by the taxa they stand for.

    ``constraints(constraint_id, clade)``; ``definitions(name, clade,
    negated)``, negated meaning all taxa except the listed ones.
    """
    positive = definitions.filter("not negated").select("name", "clade")
    negative = taxon_complement(definitions.filter("negated").select("name", "clade"), taxa)
    named = positive.unionByName(negative)
    members = constraints.select("constraint_id", F.col("clade").alias("_original"), F.explode("clade").alias("name"))
    full = members.join(named, "name", "left").withColumn("t", F.explode(F.coalesce("clade", F.array("name"))))
    return full.groupBy("constraint_id", "_original").agg(F.array_sort(F.collect_set("t")).alias("clade")).drop("_original")


def outgroup_constraint(outgroup: DataFrame, taxa: DataFrame) -> DataFrame:
    """An outgroup is the constraint that all other taxa form a clade."""
    listed = outgroup.agg(F.array_sort(F.collect_set("taxon")).alias("clade"))
    return taxon_complement(listed.withColumn("constraint_id", F.lit("outgroup")), taxa)


def constraint_clades(constraint_trees: DataFrame) -> DataFrame:
    """Inner nodes (the root included) of constraint trees as required clades."""
    return tree_taxa(strip_tree_attributes(constraint_trees), ["constraint_id"]).filter("not is_tip").select("constraint_id", "clade")


def comply(trees: DataFrame, required: DataFrame) -> DataFrame:
    """(newick, n, complies): does a tree contain every required clade?

    The whole taxon set of a tree counts as one of its clades.
    """
    texts = distinct_newicks(trees)
    need = required.select(clade_key(F.array_sort("clade")).alias("key")).distinct()
    total = need.agg(F.count(F.lit(1)).alias("_need"))
    matched = (
        tree_taxa(texts, ["newick"]).select("newick", clade_key(F.col("clade")).alias("key"))
        .join(need, "key", "left_semi")
        .groupBy("newick")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    return (
        texts.join(matched, "newick", "left")
        .crossJoin(F.broadcast(total))
        .select("newick", "n", (F.coalesce("m", F.lit(0)) == F.col("_need")).alias("complies"))
    )


def node_ages(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``age``: the length of the leftmost path down to a tip.

    Nodes on one leftmost path share their first tip, so the path sum is a
    running sum by depth over them.
    """
    below = Window.partitionBy(*keys, "first_tip").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("age", F.coalesce(F.sum("length").over(below), F.lit(0.0)))


def labelled_histories(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Number of ranked histories of each tree.

    Product over inner nodes with two inner children of C(l+r, l), where l and
    r count the inner nodes below either child.  Nodes of age 0 do not count;
    trees without lengths count all inner nodes.
    """
    has_length = F.max(F.col("length").isNotNull()).over(Window.partitionBy(*keys))
    aged = node_ages(nodes, keys).withColumn("ranked", ~F.col("is_tip") & ((F.col("age") > 0) | ~has_length))
    preorder = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flags = F.transform(
        F.sort_array(F.collect_list(F.struct("node_id", "ranked")).over(preorder)), lambda x: x["ranked"].cast("int")
    )
    inside = F.aggregate(
        F.slice("_flags", F.col("node_id").cast("int"), F.col("n_nodes").cast("int")), F.lit(0), lambda a, x: a + x
    )
    counted = aged.withColumn("_flags", flags).withColumn("below", inside)
    children = counted.filter("parent_id is not null and ranked").groupBy(*keys, "parent_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("below").alias("total"), F.min("below").alias("part")
    )
    log_choose = (
        M.log_factorial(F.col("total")) - M.log_factorial(F.col("part")) - M.log_factorial(F.col("total") - F.col("part"))
    )
    products = children.filter("k = 2").groupBy(*keys).agg(F.round(F.exp(F.sum(log_choose)), 0).alias("histories"))
    return nodes.select(*keys).distinct().join(products, keys, "left").na.fill(1.0, ["histories"])
