"""Embedding whitening from exact integer sums: bit-sliced scatter.

Vectors become integers.  In each batch every dimension is shifted to start at 0 and cut into bit planes, and a plane
is packed across the rows into 64-bit words.  The ones that two planes share, counted word by word and weighted by
their powers of two, are the exact sums of products; the shifts are put back as integers.  Spark adds the sums of all
tasks, so the covariance is centred as integers before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sums of products travel as high * 2**60 + low: a sum of highs stays a decimal, a sum of lows as well.
_LOW = 60
_SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry, as longs; null where the vector is null or holds null or non-finite entries."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(doubles, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter(x: np.ndarray) -> np.ndarray:
    """The exact sums of products of the columns of ``x`` and a last column of ones, as Python integers.

    The last row (and column) therefore holds the column sums, and its end the number of rows.
    """
    rows, dims = x.shape
    shift = [int(m) for m in x.min(axis=0)] + [0]
    y = np.ones((rows, dims + 1), np.uint64)
    y[:, :dims] = x.astype(np.uint64) - x.min(axis=0).astype(np.uint64)
    bits = [max(1, int(m).bit_length()) for m in y.max(axis=0)]
    padded = np.zeros((-(-rows // 64) * 64, dims + 1), np.uint64)
    padded[:rows] = y
    planes = np.concatenate(
        [np.packbits(((padded[:, d] >> np.uint64(a)) & np.uint64(1)).astype(bool)).view(np.uint64)[None] for d in range(dims + 1) for a in range(bits[d])]
    )
    first = np.concatenate([[0], np.cumsum(bits)[:-1]])
    wide = 2 * max(bits) + rows.bit_length() >= 62
    weight = np.array([1 << a for b in bits for a in range(b)], object if wide else np.int64)
    sums = np.zeros((dims + 1, dims + 1), object)
    for d in range(dims + 1):
        own = planes[first[d] : first[d] + bits[d]]
        rest = planes[first[d] :]
        shared = np.stack([np.bitwise_count(rest & plane).sum(axis=1, dtype=np.int64) for plane in own])
        weighted = (shared.astype(weight.dtype) * weight[first[d] : first[d] + bits[d], None]).sum(axis=0) * weight[first[d] :]
        sums[d, d:] = sums[d:, d] = np.add.reduceat(weighted, first[d:] - first[d]).astype(object)
    ones, base = sums[dims].copy(), np.array(shift, object)
    return sums + np.outer(base, ones) + np.outer(ones, base) + rows * np.outer(base, base)


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            sums = scatter(matrix(batch.column(0)))
            total = sums if total is None else total + sums
    if total is not None:
        i, j = np.tril_indices(len(total))
        values = [int(v) for v in total[i, j]]
        whole = [Decimal(v >> _LOW) for v in values], [Decimal(v & ((1 << _LOW) - 1)) for v in values]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([i, j, *whole], kinds)], ["i", "j", "high", "low"])


@dataclass(frozen=True)
class Whitening:
    """n vectors with integer sums S, the eigenvalues by falling size and their unit vectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Eigenvalues above the rounding errors of the largest; along the others there is nothing to scale."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors; NaN along unusable directions."""
        scale = np.sqrt(np.where(self.usable, self.values, np.nan))
        return (x - np.array([s / self.n for s in self.sums])) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n * x - S)**2, exact whatever its size."""
        most = max(self.n * max(abs(int(x.max())), abs(int(x.min()))) + abs(s) for s in self.sums)
        kind = np.int64 if most * most * len(self.sums) < 1 << 62 else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) for v in (off * off).sum(axis=1)]


def fit(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """The whitening of the integer vectors in column ``x``, all of one length; None without rows or dimensions.

    Tasks send one row for each pair of dimensions, Spark adds them, and the driver takes the sums of the pairs:
    it holds dimensions squared numbers, whatever the rows.
    """
    sums = vectors.select("x").mapInArrow(_task_sums, _SUMS).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    size = max((row["i"] for row in sums), default=0)
    if size == 0:
        return None
    whole = np.zeros((size + 1, size + 1), object)
    for row in sums:
        whole[row["i"], row["j"]] = whole[row["j"], row["i"]] = (int(row["high"]) << _LOW) + int(row["low"])
    n, s = whole[size, size], whole[size, :size]
    centred = n * whole[:size, :size] - np.outer(s, s)
    values, basis = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred], float))
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(int(centred[d, d]) for d in range(size)) / (n * n)
    return Whitening(int(n), [int(v) for v in s], values[order], basis[:, order], trace)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error: a row for each vector that
    takes part and each of the first ``components`` components (all, if there are fewer dimensions).

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length than
    the most frequent one (ties: the longer); entries of more than 2**63 / ``scale`` count as the largest long.  The
    covariance is that of the distinct integer vectors.  Rows that repeat an id, a null id among them, are each
    returned.  Along a direction without variance (one distinct vector, repeated or constant dimensions) ``whitened``
    is null, and ``explained`` too where there is no variance at all; ``identity_error`` is measured on the whitened
    distinct vectors over the other components, null without any.  An empty table gives no rows.  Other columns are
    not read, whatever their names.
    """
    spark = df.sparkSession
    none = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).alias("vec_id"), integers(F.col(vector), scale).alias("x")).where(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], none)
    rows = rows.where(F.size("x") == lengths[0]["size"])
    distinct = stored(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    spread = spark.sparkContext.broadcast(model)
    kept = [k for k in range(len(model.values)) if model.usable[k]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = spread.value.apply(matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in kept], [f"w{k}" for k in kept])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                off = pa.array([Decimal(v) for v in spread.value.deviations(x)], pa.decimal128(38, 0))
                out = pa.array(list(spread.value.apply(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), off, out], ["vec_id", "deviation", "whitened"])

    error = None
    if kept:
        white = distinct.mapInArrow(project, ", ".join(f"w{k} double" for k in kept))
        off_identity = [F.abs(F.covar_pop(f"w{a}", f"w{b}") - F.lit(float(a == b))) for a in kept for b in kept if a <= b]
        error = white.agg(F.array_max(F.array(*off_identity)).alias("error")).first()["error"]
    id_type = rows.schema["vec_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*(F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values))
    each = placed.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), shares[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
