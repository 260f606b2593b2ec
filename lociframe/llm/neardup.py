"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has SYMBOLS minima of permuted shingle hashes, B bits of each.  It is split into chunks; of two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols some chunk differs in at most ERRORS (pigeonhole).
All errors allowed in a chunk are enumerated as keys with those symbols masked, so any such pair meets at an equal key.
At the similarity threshold itself a pair is missed (every chunk has two errors or more) with probability 3e-7 for a
threshold of 0.85 and 2e-5 for 0.8.

Pairs are never written out.  Where signatures meet at a key, a block of them is compared inside a task, which returns
at most one edge for each; the families these edges make are then confirmed on full shingle sets, again in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, stored
from .graph import components

WORDS = 5
CHUNKS, CHUNK, ERRORS = 10, 6, 1
SYMBOLS = CHUNKS * CHUNK
#: Signatures further apart than the mean distance of two sets at the threshold and so many standard deviations are no
#: candidates.
DEVIATIONS = 5.4
#: Members of one block; larger groups meet block by block.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def farthest(percent: int) -> int:
    """The number of differing symbols up to which two signatures are near."""
    unlike = 1 - percent / 100
    return min(SYMBOLS, math.ceil(SYMBOLS * unlike + DEVIATIONS * (SYMBOLS * unlike * (1 - unlike)) ** 0.5))


@lru_cache(1)
def _random() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, and the masks and factors of the permutations."""
    seed = mix64(np.arange(1, 257 + 2 * SYMBOLS, dtype=np.uint64) * _ODD)
    return seed[:256], seed[256 : 256 + SYMBOLS, None], seed[256 + SYMBOLS :, None] | np.uint64(1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; empty without words."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_random()[0][data] * up[: len(data)], dtype=np.uint64)])
    word = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.cumsum([1] + [len(p) + 1 for p in parts]))
    run = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        run += word[j : j + len(run)] * up[j + 1]
    run = mix64(run)
    out = []
    for lo, hi in zip(first, first[1:]):
        if hi - lo >= WORDS:
            out.append(np.unique(run[lo : hi - WORDS + 1]))
        elif hi > lo:
            few = (word[lo:hi] * up[1 : hi - lo + 1]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix64(np.array([few])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the permutations' minima."""
    _, mask, factor = _random()
    least = None
    for at in range(0, len(shingles), 1 << 12):
        low = ((shingles[None, at : at + (1 << 12)] ^ mask) * factor).min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return (mix64(least) & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature: chunk by chunk, with every ERRORS symbols masked in turn."""
    n = len(signatures)
    symbols = signatures.reshape(n, CHUNKS, CHUNK).astype(np.uint64) + np.uint64(1)
    out = np.zeros((n, CHUNKS, CHUNK), np.uint64)
    for masked in range(CHUNK):
        key = np.full((n, CHUNKS), np.uint64(masked + 1)) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(97)
        for j in range(CHUNK):
            if j != masked:
                key = mix64(key * _ODD + symbols[:, :, j])
        out[:, :, masked] = key
    return out.reshape(n, -1).view(np.int64)


def sketch(df: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (digest of the shingle set; null if empty), signature per row.  Stored."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(x.as_py() for x in batch.column("_text")):
                sets = shingle_sets(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "signature"],
                )

    rows = df.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("_text"))
    return stored(
        rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, node binary, signature binary"), "sketch"
    )


def _blocks(members: DataFrame, group: str, sizes: DataFrame, member: Column) -> DataFrame:
    """``members`` once for each pair of blocks of its group that it belongs to: columns ``unit`` and ``side`` (the
    pair, and which of its two blocks).  ``sizes`` has the number of blocks of each group."""
    cut = members.join(sizes, group).withColumn("block", F.pmod(member, F.col("blocks")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.struct(F.col(group), F.least("block", "other"), F.greatest("block", "other"))
    side = (F.col("block") > F.col("other")).cast("int")
    return met.withColumn("unit", F.xxhash64(pair)).withColumn("side", side).drop("block", "other", "blocks")


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing symbols of all signatures of ``a`` and all of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] != b[None, :, k]
    return out


def _units(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    rows = rows.sort_values(["unit", "node"], kind="stable")
    unit = rows["unit"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])) if len(unit) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 1:
            yield rows.iloc[lo:hi]


def _stars(union: _Union, nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
    return [(nodes[union.find(i)], nodes[i]) for i in range(len(nodes)) if union.find(i) != i]


def families(nodes: DataFrame, far: int) -> DataFrame:
    """Edges (a, b) that connect all of ``nodes`` (node, signature) whose signatures meet at a key and differ in at most
    ``far`` symbols.

    Keys that only one signature has go first.  The signatures at one key are compared block by block; a block pair
    returns a spanning forest of its near pairs.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                keys = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(raw) + 1, dtype=np.int32) * CHUNKS * CHUNK), pa.array(chunk_keys(raw).ravel())
                )
                yield pa.RecordBatch.from_arrays([part.column("node"), keys], ["node", "keys"])

    keyed = nodes.select("node", "signature").mapInArrow(emit, "node binary, keys array<bigint>")
    keyed = keyed.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = stored(sizes.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"), "n"), "keys")
    rows, _ = blocks.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0)), F.count("*")).collect()[0]
    met = _blocks(keyed, "key", blocks.drop("n"), F.xxhash64("node")).join(nodes.select("node", "signature"), "node")
    part = F.pmod("unit", F.lit(max(8, rows // 50_000))).alias("part")

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for unit in _units(rows):
            names, side = unit["node"].tolist(), unit["side"].to_numpy()
            raw = np.frombuffer(b"".join(unit["signature"]), "<u2").reshape(-1, SYMBOLS)
            if len(names) == 2:
                if names[0] != names[1] and np.count_nonzero(raw[0] != raw[1]) <= far:
                    found.add((names[0], names[1]))
                continue
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            union = _Union(len(names))
            for i, j in zip(*np.nonzero(_apart(raw[left], raw[right]) <= far)):
                union.join(int(left[i]), int(right[j]))
            found.update(_stars(union, names))
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    edges = met.select(part, "unit", "side", "node", "signature").groupBy("part").applyInPandas(near, "a binary, b binary")
    return edges.distinct()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def confirm(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``members`` (family, node, signature, text): within a family the pairs with near signatures are
    compared on their full shingle sets, nearest first, leaving out those already linked in this block."""
    far = farthest(percent)
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1))
    sizes = stored(sizes.select("family", blocks.alias("blocks"), "bytes"), "families")
    total = sizes.agg(F.coalesce(F.sum(F.col("bytes") * F.col("blocks")), F.lit(0))).collect()[0][0]
    part = F.pmod("unit", F.lit(max(8, int(total // (2 << 20))))).alias("part")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for unit in _units(rows):
            names, side = unit["node"].tolist(), unit["side"].to_numpy()
            raw = np.frombuffer(b"".join(unit["signature"]), "<u2").reshape(-1, SYMBOLS)
            sets = []
            for _, run in chunks(unit["text"]):
                sets += shingle_sets(run)  # sorted
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            apart = _apart(raw[left], raw[right])
            i, j = np.nonzero(apart <= far)
            order = np.argsort(apart[i, j], kind="stable")
            union = _Union(len(names))
            for x, y in zip(left[i[order]].tolist(), right[j[order]].tolist()):
                if x == y or union.find(x) == union.find(y):
                    continue
                a, b = sets[x], sets[y]
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = _shared(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    union.join(x, y)
            found += _stars(union, names)
        return pd.DataFrame(found, columns=["a", "b"])

    met = _blocks(members, "family", sizes.select("family", "blocks"), F.xxhash64("node"))
    met = met.select(part, "unit", "side", "node", "signature", "text")
    return met.groupBy("part").applyInPandas(check, "a binary, b binary")


def groups(df: DataFrame, percent: int = 80) -> DataFrame:
    """What ``near_duplicates`` gives, and text_key (the text's hash) and stays: whether the row is, or equals, the one of
    its group that comes first by doc_id (null last) and text_key.  Rows without shingles all stay."""
    rows = sketch(df)
    nodes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("example"),
            F.first("signature").alias("signature"),
        ),
        "nodes",
    )
    related = components(families(nodes, farthest(percent))).withColumnRenamed("component", "family")
    c = related.join(nodes, "node").select("family", "node", "signature", "example.*").alias("c")
    t = df.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("t")
    texts = t.join(c, F.expr("t.doc_id <=> c.doc_id AND t.text_key = c.text_key"))
    members = stored(texts.select("c.family", "c.node", "c.signature", "t.text").dropDuplicates(["node"]), "members")
    linked = components(stored(confirm(members, percent), "confirmed"))
    labelled = nodes.select("node", "example").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("example").alias("least"))
    of_node = labelled.join(smallest, "component").select("node", "least")
    out = rows.join(of_node, "node", "left").withColumn("component_id", F.expr("if(least IS NULL, doc_id, least.doc_id)"))
    stays = F.expr("least IS NULL OR (doc_id <=> least.doc_id AND text_key = least.text_key)")
    kept = F.when(F.col("component_id").isNull(), stays).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key", stays.alias("stays"))


def near_duplicates(df: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``df`` (doc_id, text).

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for their sets of 5-word shingles (A-Z in
    lower case; with fewer words the whole sequence is one shingle).  ``component_id`` is the smallest doc_id that
    links reach, ``kept`` marks the document that has it.  Documents with equal sets are one node from the start.  Null, empty
    and wordless texts have no shingles and are linked with nothing.  Repeated rows of one doc_id and text all get
    the same result; an empty table gives no rows; other columns are not read.

    Rows with a null doc_id are linked by their texts as others are.  They take the smallest doc_id of their group and
    are not kept; where no row of the group has a doc_id, ``component_id`` is null and one of the texts is kept.
    """
    return groups(df, percent).select("doc_id", "n_shingles", "component_id", "kept")
