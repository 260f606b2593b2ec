"""Species-delimitation samples: model, species and count posteriors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.blocks import cumulative_by_count
from lociframe.operators.newick import delimited

#: added to tip branches when every putative species is kept apart
TIP_GUARD = 0.1


def delimitation_posterior(delim_sample: DataFrame, models: DataFrame) -> DataFrame:
    """Share of every model of the dimension, zero for unseen ones."""
    counts = delim_sample.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    total = delim_sample.agg(F.count(F.lit(1)).alias("_total"))
    return (
        models.select("model")
        .join(counts, "model", "left")
        .na.fill(0, ["n"])
        .crossJoin(F.broadcast(total))
        .select("model", "n", (F.col("n") / F.col("_total")).alias("p"))
    )


def guide_node_support(posterior: DataFrame) -> DataFrame:
    """Support of guide-tree node j: total share of models with a 1 at j."""
    bits = posterior.select("p", F.posexplode(F.split("model", "")).alias("node", "bit"))
    return bits.groupBy("node").agg(F.sum(F.when(F.col("bit") == "1", F.col("p")).otherwise(0.0)).alias("support"))


def collapse_zero_branches(trees: DataFrame, keys: list[str], total_species: int) -> DataFrame:
    """(keys, species, tree, n_species) of each sampled tree: nodes of age 0 become one species.

    A species is named by its sorted leaf labels; the tree above the species is written canonically.  When the logged
    count says that no node collapsed, tips are lengthened first so that truncated ages cannot collapse by rounding.
    """
    return delimited(trees, keys, total_species, TIP_GUARD)


def delimited_models(outcomes: DataFrame) -> DataFrame:
    """(species, tree, n_species, n) of the distinct outcomes of ``collapse_zero_branches``."""
    return outcomes.groupBy("species", "tree", "n_species").agg(F.count(F.lit(1)).alias("n"))


def _with_share(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("_total"))


def joint_model_posterior(models: DataFrame) -> DataFrame:
    """Delimitation-and-tree models with share and cumulative share."""
    counts = models.groupBy("n_species", "tree", F.array_join("species", " ").alias("species")).agg(F.sum("n").alias("n"))
    shares = _with_share(cumulative_by_count(counts, [], "n", "tree", "_cum"))
    return shares.select("n_species", "species", "tree", "n", "p", (F.col("_cum") / F.col("_total")).alias("cum_p"))


def delimitation_set_posterior(models: DataFrame) -> DataFrame:
    counts = models.groupBy("n_species", F.array_join("species", " ").alias("species")).agg(F.sum("n").alias("n"))
    return _with_share(counts).select("species", "n_species", "n", "p")


def species_posterior(models: DataFrame) -> DataFrame:
    """Share of samples in which a putative species occurs."""
    total = models.agg(F.sum("n").alias("_total"))
    each = models.select("n", F.explode("species").alias("species")).groupBy("species").agg(F.sum("n").alias("n"))
    return each.crossJoin(F.broadcast(total)).select("species", "n", (F.col("n") / F.col("_total")).alias("p"))


def species_count_posterior(models: DataFrame, max_species: int, prior: DataFrame | None = None) -> DataFrame:
    """P(#species = k) for k = 1..max, zeros included, beside an optional prior."""
    counts = models.groupBy(F.col("n_species").cast("long").alias("k")).agg(F.sum("n").alias("n"))
    total = models.agg(F.sum("n").alias("_total"))
    grid = models.sparkSession.range(1, max_species + 1).select(F.col("id").alias("k"))
    out = grid.join(counts, "k", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))
    out = out.select("k", "n", (F.col("n") / F.col("_total")).alias("p"))
    return out if prior is None else out.join(prior.select("k", "prior"), "k", "left")
