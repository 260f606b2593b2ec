"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is assigned to a leaf.  A query keeps the tree's open branches in a
priority queue, most similar first, and visits leaves in that order; how many is calibrated on the sample, widening
until the recall asked for is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a leaf that meet its queries in one block.
BLOCK = 4096
#: Rows and queries about, copies counted, of one group of blocks.
GROUP_ROWS = 50_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """A k-means tree over unit vectors."""

    def __init__(self, sample: np.ndarray, branches: int, leaf_rows: int, seed: int = 17) -> None:
        self.leaves = 0
        self.random = np.random.default_rng(seed)
        self.branches, self.leaf_rows = branches, leaf_rows
        self.root = self._grow(sample)

    def _grow(self, rows: np.ndarray) -> Node:
        near = self._split(rows) if len(rows) > self.leaf_rows else None
        if near is None:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        centres, label = near
        return Node(centres, [self._grow(rows[label == k]) for k in range(len(centres))])

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        different = np.unique(rows, axis=0)
        if len(different) < 2:
            return None
        centres = different[self.random.choice(len(different), min(self.branches, len(different)), replace=False)]
        for _ in range(12):
            label = (rows @ centres.T).argmax(axis=1)
            used = np.unique(label)
            means = np.stack([rows[label == k].mean(axis=0) for k in used])
            length = np.sqrt((means * means).sum(axis=1, keepdims=True))
            centres = np.where(length > 0, means / np.where(length > 0, length, 1), centres[used])
        label = (rows @ centres.T).argmax(axis=1)
        used, label = np.unique(label, return_inverse=True)
        return (centres[used], label) if len(used) > 1 else None

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the most similar centre at each level."""
        out = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, which = stack.pop()
            if node.centres is None:
                out[which] = node.leaf
                continue
            label = (rows[which] @ node.centres.T).argmax(axis=1)
            stack += [(child, which[label == k]) for k, child in enumerate(node.children)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        out, queue, serial = [], [(-1.0, 0, self.root)], 1
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node.centres is None:
                out.append(node.leaf)
                continue
            for likeness, child in zip((node.centres @ query).tolist(), node.children):
                heapq.heappush(queue, (-likeness, serial, child))
                serial += 1
        return out


def calibrate(tree: Tree, sample: np.ndarray, recall: float, k: int, queries: int = 300) -> int:
    """The least number of leaves to visit that finds ``recall`` of the sample's true ``k`` neighbours."""
    leaf = tree.assign(sample)
    needed = []
    for i in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        likeness = sample @ sample[i]
        likeness[i] = -np.inf
        rank = {x: n for n, x in enumerate(tree.visits(sample[i], tree.leaves))}
        needed += [rank[x] + 1 for x in leaf[np.argsort(-likeness, kind="stable")[: min(k, len(sample) - 1)]]]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, key, vec) of the rows that take part, vec as doubles: one row for each id and vector, ``key`` telling
    apart the rows that share an id.  Vectors shorter than the longest are filled up with zeros."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0.0))
    shortest, longest = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if shortest != longest:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vec"))))
    return rows.select("vec_id", F.xxhash64("vec_id", "vec").alias("key"), "vec").dropDuplicates(["vec_id", "vec"])


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(query: np.ndarray, asking: pd.DataFrame, rows: np.ndarray, row_id: np.ndarray, row_key: np.ndarray, k: int) -> Iterator[tuple]:
    """The ``k`` nearest rows of each query, scored in double precision; all ties at the end take part."""
    query_id, query_key = asking["query_id"].to_numpy(), asking["query_key"].to_numpy()
    unit_rows = unit(rows)
    row_length = np.sqrt((rows * rows).sum(axis=1))
    for at in range(0, len(query), 512):
        part = query[at : at + 512]
        rough = unit(part) @ unit_rows.T
        rough[query_key[at : at + 512, None] == row_key[None, :]] = -np.inf
        last = np.partition(rough, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
        for i in range(len(part)):
            near = np.flatnonzero((rough[i] >= last[i] - 1e-9) & (rough[i] > -np.inf))
            score = (rows[near] * part[i]).sum(axis=1) / (row_length[near] * np.sqrt((part[i] * part[i]).sum()))
            for j in np.lexsort((row_key[near], row_id[near], -score))[:k]:
                yield int(query_id[at + i]), int(query_key[at + i]), int(row_id[near[j]]), int(row_key[near[j]]), float(score[j])


def search(
    df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
    sample_rows: int = 20_000, branches: int = 8, leaf_rows: int = 64, recall: float = 0.98,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``df`` that fulfils ``is_query`` (a condition on
    vec_id) its ``k`` nearest other rows by cosine, ties to the smaller vec_id.

    ``sample_rows`` bounds the rows that the tree is fitted and calibrated on (about so many, by the hash of the id);
    all rows are indexed.  Rows whose vector is null, empty, zero or has null or non-finite components take no part.
    Rows that share an id and differ in the vector are rows of their own, which find each other; repeats of both are
    one row.  Vectors shorter than the longest are compared as if they ended in zeros.  A leaf with many rows or many
    queries, equal vectors for example, is searched in blocks.  With no other row a query has no result.  Other
    columns are not read.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector)
    rows = stored(rows, "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = rows.where(F.pmod(F.col("key"), F.lit(total)) < sample_rows).select("vec").toPandas()
    if drawn.empty:
        drawn = rows.limit(1).select("vec").toPandas()
    sample = unit(_matrix(drawn["vec"]))
    tree = Tree(sample, branches, leaf_rows)
    visits = calibrate(tree, sample, recall, k)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(unit(_matrix(batch.column("vec"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "key", "vec", "leaf"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [shared.value.visits(q, visits) for q in unit(_matrix(batch.column("vec")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "query_key", "vec", "leaves"])

    indexed = rows.select("vec_id", "key", "vec").mapInArrow(index, "vec_id long, key long, vec array<double>, leaf long")
    queries = rows.where(is_query).select("vec_id", "key", "vec").mapInArrow(
        plan, "query_id long, query_key long, vec array<double>, leaves array<bigint>"
    )
    queries = stored(queries.select("query_id", "query_key", "vec", F.explode("leaves").alias("leaf")), "queries")
    indexed = stored(indexed, "leaves")
    in_leaf = indexed.groupBy("leaf").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).alias("row_blocks"))
    asked = queries.groupBy("leaf").agg(F.count("*").alias("queries"), F.ceil(F.count("*") / BLOCK).alias("query_blocks"))
    blocks = stored(in_leaf.join(asked, "leaf"), "blocks")
    count = F.lit(0).cast("long")
    each = lambda n: F.explode(F.sequence(count, F.col(n) - 1))
    cell = F.xxhash64("leaf", "row_block", "query_block").alias("cell")
    left = (
        indexed.join(blocks, "leaf").withColumn("row_block", F.pmod("key", "row_blocks"))
        .withColumn("query_block", each("query_blocks")).select(cell, "vec_id", "key", "vec")
    )
    right = (
        queries.join(blocks, "leaf").withColumn("query_block", F.pmod("query_key", "query_blocks"))
        .withColumn("row_block", each("row_blocks")).select(cell, "query_id", "query_key", "vec")
    )
    # a group's size follows from the copies that it holds, not from the rows of the table
    copies = blocks.agg(F.sum(F.col("rows") * F.col("query_blocks") + F.col("queries") * F.col("row_blocks"))).first()[0]
    parts = F.lit(max(8, (copies or 0) // GROUP_ROWS))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found, by_cell = [], dict(tuple(rows.groupby("cell")))
        for cell, q in asked.groupby("cell"):
            if cell in by_cell:
                r = by_cell[cell]
                found += _best(_matrix(q["vec"]), q, _matrix(r["vec"]), r["vec_id"].to_numpy(), r["key"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "query_key", "vec_id", "key", "score"])

    def grouped(side: DataFrame):
        return side.withColumn("part", F.pmod("cell", parts)).groupBy("part")

    met = grouped(left).cogroup(grouped(right)).applyInPandas(meet, "query_id long, query_key long, vec_id long, key long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
