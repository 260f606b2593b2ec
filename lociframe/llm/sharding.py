"""Balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A group over 1/(shards * LARGE) of all bytes is an item of its own; the others are dealt by hash into
#: shards * BUNDLES items.  Both bound what reaches the driver, whatever the input.
LARGE, BUNDLES = 64, 256
#: Rows about that one window numbers.
ROWS_A_TASK = 2_000


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each item: the two partial partitions of largest spread are combined, oppositely ordered, until one
    is left."""
    heap = []
    for i, size in enumerate(sizes):
        bins = [(0, None)] * (parts - 1) + [(size, i)]
        heap.append((-size if parts > 1 else 0, i, bins))
    heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heappop(heap)
        _, _, b = heappop(heap)
        both = [(x + y, (s, t)) for (x, s), (y, t) in zip(a, reversed(b))]
        both.sort(key=lambda bin: bin[0])
        least = both[0][0]
        both = [(size - least, tree) for size, tree in both]
        heappush(heap, (-both[-1][0], serial, both))
        serial += 1
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                out[x] = part
    return out


def shard(df: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null under this law) of each row of ``df``
    (doc_id, text).

    Rows of equal text stay in one shard; null counts as the empty text in this and in text_crc32.  A group too large
    for a fair share gets the emptiest place that differencing leaves it.  Slots number the rows of a shard from 0 by
    slices of doc_id hashes, so that no shard is one window; equal rows take neighbouring slots in any order.  An
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stored(
        df.select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
        ),
        "shard",
    )
    spark = df.sparkSession
    groups = base.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    total = base.agg(F.sum("size")).collect()[0][0] or 0
    large = groups.where(F.col("bytes") * (shards * LARGE) > total).collect()
    bundle = F.pmod(F.col("text_key"), F.lit(shards * BUNDLES)).alias("bundle")
    bundles = (
        groups.where(F.col("bytes") * (shards * LARGE) <= total).groupBy(bundle).agg(F.sum("bytes").alias("bytes")).collect()
    )
    items = sorted([(-r.bytes, 0, r.text_key) for r in large] + [(-r.bytes, 1, r.bundle) for r in bundles])
    parts = difference([-b for b, _, _ in items], shards)
    alone = spark.createDataFrame([(k, p) for (_, kind, k), p in zip(items, parts) if kind == 0], "text_key long, own int")
    dealt = spark.createDataFrame([(k, p) for (_, kind, k), p in zip(items, parts) if kind], "bundle long, dealt int")
    placed = (
        base.withColumn("bundle", bundle)
        .join(F.broadcast(alone), "text_key", "left")
        .join(F.broadcast(dealt), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "dealt"))
        .drop("own", "dealt", "bundle")
    )
    slices = placed.groupBy("shard").agg((F.floor(F.count("*") / ROWS_A_TASK) + 1).alias("slices"))
    sliced = (
        placed.join(F.broadcast(slices), "shard")
        .withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")))
        .drop("slices")
    )
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_key")
    numbered = sliced.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
