"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Expected copies are counted in units of 2**-24.
UNIT = 1 << 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``target`` of each source of ``sizes`` (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights``, repeating.  Together they get the sum of all sizes; a
    source gets at most ``most`` times its own, and what exceeds that is shared out by weight among the rest.  With
    the sources sorted by size over weight, those at their limit come first: the level is what is left over divided
    by the weight left over, at the first source that it does not fill, where it is largest.  The windows span one row
    per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long"))
    below = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    filled = most * F.col("source_size") <= F.col("weight") * F.col("level")
    open_level = F.max(F.when(~F.col("filled"), F.col("level"))).over(everything)
    first_level = (
        weighed.withColumn("level", level)
        .withColumn("filled", filled)
        .withColumn("open_level", open_level)
    )
    full = (most * F.col("source_size")).cast("double")
    share = F.col("weight") * F.col("open_level")
    return first_level.select("source", "source_size", F.when(F.col("filled"), full).otherwise(F.least(full, share)).alias("target"))


def size_class(size: Column) -> Column:
    """Sizes with the same number of digits and the same two leading digits share a class; classes ascend with size."""
    text = size.cast("string")
    return (F.length(text) * 100 + F.substring(text, 1, 2).cast("int")).cast("int")


def offset(source: Column) -> Column:
    """The source's one random offset in units: the first digits of a digest of its name."""
    name = F.concat(F.when(source.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("long")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, rows_a_task: int = 2_000) -> DataFrame:
    """Copies of each document of ``df`` (doc_id, source, text): doc_id, source, text_key, size, source_size, target,
    copies.

    A document of a source with target t and size s is expected t/s times.  In each source, ordered by class of size
    and then by a digest of doc_id, the expected copies are summed up from one random offset, and a document is taken
    once per integer boundary that the sum crosses at it: never more than ``most`` times.  The order by size keeps
    the words taken near the target as well.

    Running numbers are a number within (source, class, slice) plus the sizes of the slices before; the slices of a
    class follow from its number of rows, so a source with most of the rows is many windows.  Null and wordless
    texts have size 0; a source of size 0 has target 0 and is not taken.  Rows of one doc_id are ordered by size and text; equal rows
    are interchangeable.  Reruns agree.  ``text_key`` is a digest of the text for finding the row again.
    """
    size = word_count(F.col("text"))
    base = stored(
        df.select(
            "doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size"), size_class(size).alias("class"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"),
        ),
        "mix",
    )
    classes = base.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    slices = classes.select("source", "class", (F.floor(F.col("n") / rows_a_task) + 1).alias("slices"))
    cut = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)).cast("int")
    same = lambda a, b, *on: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in on))
    cutted = base.alias("b").join(slices.alias("s"), same("b", "s", "source", "class")).select("b.*", cut.alias("slice"))
    ahead = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cutted.groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
        .select("source", "class", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    )
    plan = starts.alias("a").join(wanted.alias("w"), same("a", "w", "source")).select("a.*", "source_size", "target")
    within = Window.partitionBy("source", "class", "slice").orderBy("digest", "doc_id", "size", "text_key")
    numbered = cutted.withColumn("number", F.row_number().over(within))
    placed = numbered.alias("d").join(plan.alias("p"), same("d", "p", "source", "class", "slice")).select(
        "d.*", "p.source_size", "p.target", (F.col("p.start") + F.col("d.number")).alias("k")
    )
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    crossed = lambda k: F.shiftright(offset(F.col("source")) + each * k, 24)
    copies = F.least(crossed(F.col("k")) - crossed(F.col("k") - 1), F.lit(most).cast("long"))
    return placed.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.alias("copies"))
