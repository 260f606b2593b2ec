"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions.  Each merge rank has a bucket of the list positions whose pair merges
at that rank; a two-level bitmap marks the ranks with a bucket, and find-first-set on it gives the next rank.  A
position whose pair has changed since it was queued is skipped when it comes up.  A merge costs a constant number of
bitmap steps, so very long pre-tokens need no quadratic scan.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pre-tokens up to this many characters are remembered by a Python worker, and so many of them.
CACHED_CHARS, CACHED = 48, 600_000


#: The bits of a 256-bit word.
BIT = [1 << k for k in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The queue: ``buckets`` holds the positions of each rank as a heap, so that equal ranks go leftmost first; ``top``
    marks the 256-bit words of ``low`` that are not zero, these mark the ranks with a bucket.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts at a position
    before = list(range(-1, n - 1))
    get = ranks.get
    # Rank of the pair starting at a position; None: no pair, or the position was merged away.
    queued: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
    queued.append(None)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(queued):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> 8
                low[word] = low.get(word, 0) | BIT[rank & 255]
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
        if queued[i] != rank:  # stale
            continue
        middle = end[i]
        stop = end[i] = end[middle]
        queued[middle] = queued[i] = None
        if stop < n:
            before[stop] = i
            pairs = ((i, end[stop]), (before[i], stop)) if i else ((i, end[stop]),)
        elif i:
            pairs = ((before[i], stop),)
        else:
            break
        for start, last in pairs:
            rank = queued[start] = get(piece[start:last])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], start)
                else:
                    buckets[rank] = [start]
                    word = rank >> 8
                    low[word] = low.get(word, 0) | BIT[rank & 255]
                    top |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoding and decoding by one rank file."""

    def __init__(self, lines: bytes, pattern: str, remembered: int = CACHED) -> None:
        self.remembered = remembered
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        known = self.known
        pieces = self.find(text)
        out = list(map(known.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    ids = out[i] = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
                    if len(piece) <= CACHED_CHARS:
                        known[piece] = ids
            if len(known) > self.remembered:  # the older half goes
                for piece in list(islice(known, self.remembered // 2)):
                    del known[piece]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def _codec(digest: str, lines: bytes, pattern: str, remembered: int) -> Codec:
    return Codec(lines, pattern, remembered)


class Vocabulary:
    """A rank file and its pre-token pattern, read on the driver and sent to the executors (under 1 MB).

    A Python worker remembers the ids of up to ``remembered`` words; fewer change its memory and time, not the ids.
    """

    def __init__(self, path: str, pattern: str, remembered: int = CACHED) -> None:
        with open(path, "rb") as file:
            self.lines = file.read()
        self.pattern, self.remembered = pattern, remembered
        self.digest = hashlib.sha256(self.lines + pattern.encode()).hexdigest()

    def codec(self) -> Codec:
        return _codec(self.digest, self.lines, self.pattern, self.remembered)


def _mapped(df: DataFrame, keep: tuple[str, ...], source: str, new: str, vocabulary: Vocabulary, step: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema: StructType = df.select(*keep).schema.add(new, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = getattr(shared.value.codec(), step)
        for batch in batches:
            last = batch.num_columns - 1
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = pa.array([apply(x.as_py()) for x in part.column(last)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(last)] + [made], schema.names)

    return df.select(*keep, source).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` (binary: little-endian unsigned 32-bit token ids) of each row's whole text.

    Each match of the pattern is encoded separately, without special tokens.  Null and empty texts have no ids.
    Equal rows give equal rows; other columns are not read.
    """
    source = F.coalesce(F.col(text), F.lit("")).alias("_text")
    return _mapped(df, keep, source, "ids", vocabulary, "encode")


def decode(df: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded`` (binary: the bytes of the tokens); null ids as none."""
    source = F.coalesce(F.col(ids), F.lit(b"")).alias("_ids")
    return _mapped(df, keep, source, "decoded", vocabulary, "decode")


def n_tokens(ids: str = "ids"):
    """Number of ids, long."""
    return (F.octet_length(F.col(ids)) / 4).cast("long")
