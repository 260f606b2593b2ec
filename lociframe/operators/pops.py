"""Species trees as node tables ``pops(keys, node_id, parent_id, ...)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.arrays import ancestor_tables, bisect, let


def ancestor_closure(pops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, anc_id, dist): every node with each ancestor and itself.

    A tree is one row of parent indices.  Depths come from doubling, then each node climbs as many steps as it is
    deep, so the work is that of writing the result; nodes leave their tree's row only as result rows.
    """
    kind = pops.schema["node_id"].dataType
    node = F.struct("node_id", F.col("parent_id").cast(kind).alias("parent_id"))
    rows = pops.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
    up = let(F.col("_nodes.node_id"), lambda ids: F.transform("_nodes.parent_id", lambda p, i: F.coalesce(bisect(ids, p), i)))
    rows = rows.select(*keys, F.col("_nodes.node_id").alias("_ids"), up.alias("_up"))
    each = rows.select(*keys, "_ids", "_up", F.posexplode(ancestor_tables(F.col("_up"))["depth"]).alias("_at", "_deep"))
    step = lambda path, _: F.array_append(path, F.get("_up", F.element_at(path, -1)))
    path = F.when(F.col("_deep") == 0, F.array("_at")).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("_deep")), F.array("_at"), step))
    climbed = each.select(*keys, F.get("_ids", F.col("_at")).alias("node_id"), "_ids", F.posexplode(path).alias("dist", "_anc"))
    return climbed.select(*keys, "node_id", F.get("_ids", F.col("_anc")).alias("anc_id"), "dist")


def place(own: np.ndarray, wanted: np.ndarray, last: bool = True) -> np.ndarray:
    """Index of each wanted number among ``own``, the last (or first) of equal ones; -1 if it is absent."""
    if not len(own):
        return np.full(len(wanted), -1)
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], wanted, "right") - 1 if last else np.searchsorted(own[order], wanted, "left")
    at = order[np.clip(at, 0, len(own) - 1)]
    return np.where(own[at] == wanted, at, -1)


def linked_theta_master(pops: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each population's theta by its linked master's; adds ``master``."""
    masters = pops.select(*keys, F.col("node_id").alias("master"), F.col("theta").alias("_theta"))
    linked = pops.withColumn("master", F.coalesce("linked_to", "node_id")).join(masters, [*keys, "master"], "left")
    return linked.withColumn("theta", F.col("_theta")).drop("_theta")


def pop_lifetimes(pops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, tau, parent_tau); the root's parent_tau is NULL."""
    parents = pops.select(*keys, F.col("node_id").alias("parent_id"), F.col("tau").alias("parent_tau"))
    return pops.join(parents, [*keys, "parent_id"], "left").select(*keys, "node_id", "parent_id", "tau", "parent_tau")


def migration_possible(pops: DataFrame, mig_spec: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target, valid) for each configured pair and sample.

    Both need parents and overlapping lifetimes.  A source that starts no later
    than the target must end after the target's start; a source that starts no
    earlier may start up to and at the target's end.
    """
    life = pop_lifetimes(pops, keys)
    side = lambda name: life.select(
        *keys, F.col("node_id").alias(name), F.col("tau").alias(f"{name}_tau"), F.col("parent_tau").alias(f"{name}_end")
    )
    pairs = side("source").join(mig_spec.select("source", "target"), "source").join(side("target"), [*keys, "target"])
    s, t = F.col("source_tau"), F.col("target_tau")
    overlap = ((s <= t) & (t < F.col("source_end"))) | ((s >= t) & (s <= F.col("target_end")))
    both = F.col("source_end").isNotNull() & F.col("target_end").isNotNull()
    return pairs.select(*keys, "source", "target", (both & F.coalesce(overlap, F.lit(False))).alias("valid"))


def gene_leaves(seqcount: DataFrame, closure: DataFrame) -> DataFrame:
    """Sequences at or below each population, per locus.

    ``seqcount(locus, node_id, n)`` holds the sequences sampled in a population;
    ``closure`` belongs to one species tree.
    """
    up = F.broadcast(closure.select("node_id", "anc_id"))
    return seqcount.join(up, "node_id").groupBy("locus", F.col("anc_id").alias("node_id")).agg(F.sum("n").alias("n_leaves"))


def lineages_entering(
    waiting: DataFrame, seqcount: DataFrame, closure: DataFrame, migcounts: DataFrame | None = None, dated: DataFrame | None = None
) -> DataFrame:
    """(gen, locus, node_id, seqin): lineages present at the start of a population.

    All changes below a population are added at once through the closure:
    sampled sequences, minus coalescences, plus lineages that migrate (backward
    in time) into a descendant, minus those that leave one.  ``seqcount(locus,
    node_id, n)`` covers tips; ``waiting(gen, locus, node_id, coal_count)``;
    ``migcounts(gen, locus, source, target, n)`` counts forward from source to
    target; ``dated(locus, node_id, n)`` are sequences first sampled inside an
    inner population.
    """
    gens = waiting.select("gen", "locus").distinct()
    strict = F.broadcast(closure.filter("dist > 0").select("node_id", "anc_id"))  # of one species tree
    at_tips = gens.join(seqcount, "locus").select("gen", "locus", "node_id", "n")
    changes = at_tips.unionByName(waiting.select("gen", "locus", "node_id", (-F.col("coal_count")).alias("n")))
    if migcounts is not None:
        changes = changes.unionByName(migcounts.select("gen", "locus", F.col("source").alias("node_id"), "n"))
        changes = changes.unionByName(migcounts.select("gen", "locus", F.col("target").alias("node_id"), (-F.col("n")).alias("n")))
    if dated is not None:
        changes = changes.unionByName(gens.join(dated, "locus").select("gen", "locus", "node_id", "n"))
    inner = (
        changes.join(strict, "node_id")
        .groupBy("gen", "locus", F.col("anc_id").alias("node_id"))
        .agg(F.sum("n").alias("seqin"))
    )
    return inner.unionByName(at_tips.withColumnRenamed("n", "seqin"))


def dated_node_bounds(dates: DataFrame, closure: DataFrame) -> DataFrame:
    """(node_id, lower, upper) for the age of each inner node.

    ``dates(node_id, age)`` are the samples' ages in their populations.  The
    node must be older than every sample below it and younger than every sample
    taken at or above it.
    """
    down = closure.filter("dist > 0")
    inner = down.select(F.col("anc_id").alias("node_id")).distinct()
    lower = down.join(dates, "node_id").groupBy(F.col("anc_id").alias("node_id")).agg(F.max("age").alias("lower"))
    above = closure.join(dates.select(F.col("node_id").alias("anc_id"), "age"), "anc_id")
    upper = above.groupBy("node_id").agg(F.min("age").alias("upper"))
    return inner.join(lower, "node_id", "left").join(upper, "node_id", "left")
