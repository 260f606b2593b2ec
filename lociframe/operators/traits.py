"""Trait likelihoods on given species trees.

A tree is one row with its nodes ordered children first; a character's tip
values are a map.  Both algorithms fold over the nodes, one row per (tree,
character), so characters and trees spread freely.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.likelihood import bind

#: shortest branch used by the discrete model
BRANCH_FLOOR = 1e-8
MISSING_STATES = 1023


def trait_trees(pops: DataFrame, rates: DataFrame) -> DataFrame:
    """(tree_id, partition, nodes): node structs ordered children first.

    ``pops(tree_id, node_id, parent_id, label, tau)``; ``rates(partition,
    node_id, rate)`` are branch rates, 1 where absent.  Equal ages are ordered
    by ``node_id``, which must then be larger for the parent.
    """
    parents = pops.select("tree_id", F.col("node_id").alias("parent_id"), F.col("tau").alias("top"))
    is_parent = pops.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    base = pops.join(parents, ["tree_id", "parent_id"], "left").join(is_parent, ["tree_id", "node_id"], "left")
    parts = rates.select("partition").distinct()
    # partitions are the few trait blocks of one analysis
    rows = base.join(F.broadcast(parts)).join(rates, ["partition", "node_id"], "left")
    v = F.coalesce((F.col("top") - F.col("tau")) * F.coalesce("rate", F.lit(1.0)), F.lit(0.0))
    item = F.struct(
        F.when(F.col("inner"), F.col("tau")).otherwise(F.lit(-1.0)).alias("age"), "node_id", "parent_id", "label",
        F.coalesce("inner", F.lit(False)).alias("inner"), v.alias("v"),
    )
    trees = rows.groupBy("tree_id", "partition").agg(F.sort_array(F.collect_list(item)).alias("t"))
    trees = trees.withColumn("ids", F.transform("t", lambda x: x["node_id"]))
    trees = trees.withColumn("up", F.transform("t", lambda x: F.array_position("ids", x["parent_id"]) - 1))
    kids = lambda i: F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda j: F.get(F.col("up"), j) == i)
    nodes = F.transform(
        F.col("t"),
        lambda x, i: F.struct(x["node_id"].alias("node_id"), x["label"].alias("label"), x["inner"].alias("inner"), x["v"].alias("v"), kids(i).alias("kids")),
    )
    return trees.select("tree_id", "partition", nodes.alias("nodes"))


def independent_contrasts(pops: DataFrame, traits: DataFrame, rates: DataFrame) -> DataFrame:
    """(tree_id, partition, char_idx, node_id, contrast, total_v) of inner nodes.

    ``traits(partition, label, char_idx, value, v_pop)``; ``total_v`` is the
    sum of the two daughters' adjusted branch lengths.
    """
    chars = traits.groupBy("partition", "char_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("values"), F.max("v_pop").alias("v_pop")
    )
    rows = trait_trees(pops, rates).join(chars, "partition")

    def step(acc, node):
        left, right = F.get(acc, node["kids"][0]), F.get(acc, node["kids"][1])
        vl, vr = left["v"], right["v"]
        inner = F.struct(
            ((vr * left["m"] + vl * right["m"]) / (vl + vr)).alias("m"),
            (node["v"] + vl * vr / (vl + vr)).alias("v"),
            (left["m"] - right["m"]).alias("x"),
            (vl + vr).alias("s"),
        )
        tip = F.struct(
            F.element_at("values", node["label"]).alias("m"),
            (node["v"] + F.col("v_pop")).alias("v"),
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("s"),
        )
        return F.concat(acc, F.array(F.when(node["inner"], inner).otherwise(tip)))

    start = F.array().cast("array<struct<m:double,v:double,x:double,s:double>>")
    folded = rows.withColumn("f", F.aggregate("nodes", start, step))
    return (
        folded.select("tree_id", "partition", "char_idx", F.explode(F.arrays_zip("nodes", "f")).alias("z"))
        .filter("z.nodes.inner")
        .select("tree_id", "partition", "char_idx", F.col("z.nodes.node_id").alias("node_id"), F.col("z.f.x").alias("contrast"), F.col("z.f.s").alias("total_v"))
    )


def trait_bm_log_likelihood(contrasts: DataFrame, log_dets: DataFrame) -> DataFrame:
    """Brownian-motion log likelihood per (tree, partition).

    ``log_dets(partition, ldet)``: log determinant of the correlation matrix,
    added once per inner node.
    """
    per_node = contrasts.groupBy("tree_id", "partition", "node_id").agg(
        F.count(F.lit(1)).alias("p"), F.sum(F.col("contrast") * F.col("contrast")).alias("zz"), F.max("total_v").alias("s")
    )
    term = F.col("p") * F.log(2 * math.pi * F.col("s")) + F.col("ldet") + F.col("zz") / F.col("s")
    return per_node.join(log_dets, "partition").groupBy("tree_id", "partition").agg((-0.5 * F.sum(term)).alias("logl"))


def character_states(traits: DataFrame) -> DataFrame:
    """(partition, char_idx, masks, k): tip masks and the number of states.

    The highest observed state sets k (at least 2).  A character that shows
    the same mask in all known tips is an error, as it carries no information
    under the variable-characters model.
    """
    known = F.col("state_mask") < MISSING_STATES
    chars = traits.groupBy("partition", "char_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "state_mask"))).alias("masks"),
        F.max(F.when(known, F.col("state_mask"))).alias("top"),
        F.min(F.when(known, F.col("state_mask"))).alias("low"),
    )
    varied = F.when(F.col("top") == F.col("low"), F.raise_error(F.lit("constant character")).cast("int")).otherwise(F.col("top"))
    bits = F.length(F.bin(varied.cast("long")))
    return chars.select("partition", "char_idx", "masks", F.greatest(bits, F.lit(2)).alias("k"))


def trait_mkv_log_likelihood(pops: DataFrame, traits: DataFrame, rates: DataFrame) -> DataFrame:
    """Mk log likelihood per (tree, partition), corrected for unseen constant characters.

    ``traits(partition, label, char_idx, state_mask)``.  The constant characters
    of k states are alike by symmetry, so one per k is pruned and counted k
    times.
    """
    chars = character_states(traits)
    labels = traits.groupBy("partition").agg(F.collect_set("label").alias("labels"))
    sizes = chars.select("partition", "k").distinct().join(labels, "partition")
    constant = sizes.select(
        "partition",
        F.lit(None).cast("int").alias("char_idx"),
        F.map_from_entries(F.transform("labels", lambda x: F.struct(x.alias("label"), F.lit(1).alias("state_mask")))).alias("masks"),
        "k",
    )
    rows = trait_trees(pops, rates).join(chars.select("partition", F.col("char_idx").cast("int"), "masks", "k").unionByName(constant), "partition")
    k = F.col("k").cast("double")
    every = F.sequence(F.lit(0), F.col("k") - 1)

    def step(acc, node):
        tip_mask = F.coalesce(F.element_at("masks", node["label"]), F.lit(MISSING_STATES))  # unlisted: unknown
        tip = F.transform(every, lambda i: F.call_function("getbit", tip_mask.cast("long"), i).cast("double"))
        both = F.zip_with(F.get(acc, node["kids"][0]), F.get(acc, node["kids"][1]), lambda x, y: x * y)
        vector = F.when(node["inner"], both).otherwise(tip)
        # change and no-change probabilities of the Mk model
        v = F.greatest(node["v"], F.lit(BRANCH_FLOOR))
        change = (1 - F.exp(-v * k / (k - 1))) / k

        def send(vec):
            total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)
            flow = lambda c: F.transform(vec, lambda x: c["change"] * c["total"] + (1 - k * c["change"]) * x)
            return bind(F.struct(change.alias("change"), total.alias("total")), flow)

        # the root is last and its vector is needed without a branch
        return F.concat(acc, F.array(bind(vector, lambda vec: F.when(node["v"].isNull(), vec).otherwise(send(vec)))))

    marked = rows.withColumn(
        "nodes",
        F.transform(
            "nodes",
            lambda x, i: F.struct(
                x["label"].alias("label"), x["inner"].alias("inner"), x["kids"].alias("kids"),
                F.when(i < F.size("nodes") - 1, x["v"]).alias("v"),
            ),
        ),
    )
    root = F.element_at(F.aggregate("nodes", F.array().cast("array<array<double>>"), step), -1)
    probs = marked.withColumn("prob", F.aggregate(root, F.lit(0.0), lambda s, x: s + x) / k).select(
        "tree_id", "partition", "char_idx", "k", "prob"
    )
    unseen = probs.filter("char_idx is null").select("tree_id", "partition", "k", (F.col("prob") * F.col("k")).alias("constant"))
    return (
        probs.filter("char_idx is not null")
        .join(unseen, ["tree_id", "partition", "k"])
        .groupBy("tree_id", "partition")
        .agg(F.sum(F.log("prob") - F.log(1 - F.col("constant"))).alias("logl"))
    )
