"""Running totals, ranks and as-of lookups that never need one task per group.

A window over a whole group puts that group into one task.  A chain, parameter
or locus may hold a large share of all rows, so every ordered computation here
is split into *blocks*: contiguous pieces of the group's order.  Totals per
block are pre-aggregated, accumulated over the short block table, and added to
a window that spans one block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

#: iterations per block when rows are ordered by the sampled iteration
GEN_BLOCK = 65536
#: value buckets are delimited by 2**BOUND_STEPS - 1 approximate quantiles
BOUND_STEPS = 6
#: copies of a per-group row when it is joined to the group's detail rows
SALTS = 16
#: rank blocks per group in ``values_at_ranks``
RANK_BLOCKS = 1024


def gen_block(gen: str | Column = "gen", size: int = GEN_BLOCK) -> Column:
    gen = F.col(gen) if isinstance(gen, str) else gen
    return F.floor(gen / F.lit(size)).cast("long")


def attach_group_row(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Join one row per group to the group's detail rows.

    The detail side is salted on ``spread`` and each group row is repeated once
    per salt, so a hot group is divided between tasks even when the group table
    is too large for Catalyst to broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``totals`` within ``keys`` by ``order``.

    ``block`` must not decrease along ``order``; each (keys, block) is one unit
    of work.
    """
    part = [*keys, "_block"]
    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*part).agg(*[F.sum(e).alias(f"_sum_{n}") for n, e in totals.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *part, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals]
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, part)
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(e).over(inside) + F.col(f"_off_{n}")).alias(n) for n, e in totals.items()],
    )
    return out


def value_bucket(value: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` are <= ``value``: a binary search."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(BOUND_STEPS))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(bounds, at + step) <= value, at + step).otherwise(at),
    )


def value_ranks(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, cnt, start): distinct values with the 0-based rank of the first copy.

    Rows collapse to distinct values before any ordered work, so ties (logs
    print 6 decimals) shrink the shuffle instead of skewing it.  Buckets of
    roughly equal depth come from approximate quantiles; the ranks themselves
    are exact for any one set of bounds.  Approximate quantiles depend on the
    order in which parts are merged, so the bounds (a row per group) are stored:
    a second evaluation or a retried stage sees the same ones.
    """
    distinct = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    n = 2**BOUND_STEPS
    bounds = cut_lineage(
        distinct.groupBy(*keys).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("_bounds"))
    )
    bucketed = (
        attach_group_row(distinct, bounds, keys, [value])
        .withColumn("_bucket", value_bucket(F.col(value), F.col("_bounds")))
        .drop("_bounds")
    )
    ranked = running_totals(bucketed, keys, [value], F.col("_bucket"), {"_end": F.col("cnt")})
    return ranked.select(*keys, value, "cnt", (F.col("_end") - F.col("cnt")).alias("start"))


def values_at_ranks(ranked: DataFrame, wanted: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Look up the value at each row's 0-based ``rank``; adds column ``at_rank``.

    ``ranked`` is the output of :func:`value_ranks` with the group size in
    column ``n``; ``wanted`` carries ``rank`` and ``n``.  A merge of both sides
    inside blocks of ranks replaces a range join.
    """
    width = F.greatest(F.ceil(F.col(n) / F.lit(RANK_BLOCKS)), F.lit(1)).cast("long")
    first = F.floor(F.col("start") / width).cast("long")
    last = F.floor((F.col("start") + F.col("cnt") - 1) / width).cast("long")
    points = ranked.select(
        *keys, F.col(value).alias("_point"), "start", width.alias("_width"), F.explode(F.sequence(first, last)).alias("_block")
    ).select(*keys, "_block", F.greatest(F.col("start"), F.col("_block") * F.col("_width")).alias("_pos"), "_point")
    others = [c for c in wanted.columns if c not in keys]
    queries = wanted.select(
        *keys,
        F.floor(F.col("rank") / width).cast("long").alias("_block"),
        F.col("rank").alias("_pos"),
        F.struct(*others).alias("_query"),
    )
    both = points.unionByName(queries, allowMissingColumns=True)
    w = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_pos", F.col("_point").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("at_rank", F.last("_point", ignorenulls=True).over(w))
        .filter(F.col("_query").isNotNull())
        .select(*keys, "_query.*", "at_rank")
    )


def cumulative_by_count(df: DataFrame, keys: list[str], count: str, item: str, out: str) -> DataFrame:
    """Running sum of ``count`` by descending count, ties by md5 of ``item``.

    The accumulation over distinct counts is short (their sum is the sample
    size); inside one count the md5 prefix gives evenly filled, ordered blocks.
    """
    rows = df.withColumn("_tie", F.md5(F.col(item)))
    per_count = rows.groupBy(*keys, count).agg(F.sum(count).alias("_total"))
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_count.select(*keys, count, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = running_totals(
        rows, [*keys, count], ["_tie"], F.conv(F.substring("_tie", 1, 3), 16, 10).cast("int"), {"_part": F.col(count)}
    )
    return attach_group_row(inside, starts, [*keys, count], ["_tie"]).select(
        *df.columns, (F.col("_start") + F.col("_part")).alias(out)
    )
