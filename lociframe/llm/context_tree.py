"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision has its own tree of contexts, the bytes before it.  A node holds how
often each bit followed its context in the training texts and estimates bits after Krichevsky and Trofimov; its
weighted probability is half its own estimate and half the product of its children's, so all depths are mixed by the
evidence for them.  The model is fixed once the counts are gathered, so what a text costs is a sum over its strings of
`depth` + 1 bytes, and Spark computes the cost once for each distinct string.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored

#: At most so many distinct strings, the most used ones, go to every executor (48 MB); the others are joined by a shuffle.
BROADCAST_STRINGS = 3_000_000
#: A word with at least 1/HOT of all training tokens is looked up in a broadcast table of at most HOT words.
HOT = 1 << 20
FLUSH = 1 << 19
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, of a text; white space is ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def strings(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the code of (previous byte, the one before, ..., the byte itself), and its stream's number.

    A stream is preceded by ``depth`` ends.
    """
    pad = END * depth
    data = np.frombuffer(pad + pad.join(streams), np.uint8).astype(np.int64)
    sizes = np.array([len(s) for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes)
    code = data[depth - 1 : -1].copy()
    for back in [*range(2, depth + 1), 0]:
        code <<= 8
        code |= data[depth - back : len(data) - back]
    return code[np.arange(len(owner)) + owner * depth], owner


def _streams(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, list[list[bytes]], list[bytes]]]:
    first, found, size = 0, [], 0
    for i, text in enumerate(texts):
        own = tokens(text)
        found.append(own)
        size += len(text or "")
        if size >= limit or i + 1 == len(texts):
            yield first, found, [b" ".join(x) + END for x in found]
            first, found, size = i + 1, [], 0


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma_half(a) + _lgamma_half(b) - _lgamma_one(a + b) - math.log(math.pi)


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    """ln gamma(n + 1) by Stirling's series after three steps of the recurrence, from n + 4."""
    return _series(n + 4.0) - np.log((n + 1.0) * (n + 2.0) * (n + 3.0))


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    return _series(n + 4.5) - np.log((n + 0.5) * (n + 1.5) * (n + 2.5) * (n + 3.5))


def _series(x: np.ndarray) -> np.ndarray:
    r = 1.0 / x
    tail = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + tail


class Levels:
    """The nodes of all bit trees above a set of strings, from ``top`` to ``depth`` bytes of context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        byte = codes & 255
        step = np.arange(8)
        self.prefix = ((1 << step) | (byte[:, None] >> (8 - step))).ravel()
        self.bit = ((byte[:, None] >> (7 - step)) & 1).ravel()
        n = np.repeat(counts, 8).astype(float)
        context = np.repeat(codes >> 8, 8)
        self.index, self.kt, self.own = {}, {}, {}
        node, zeros, ones, below = (context << 8) | self.prefix, n * (1 - self.bit), n * self.bit, None
        to_node = np.arange(len(node))
        for d in range(depth, top - 1, -1):
            ids, inverse = np.unique(node, return_inverse=True)
            zeros, ones = (np.bincount(inverse, weights=x, minlength=len(ids)) for x in (zeros, ones))
            estimate = log_kt(zeros, ones)
            if below is None:
                weighted = estimate
                self.own[d] = np.ones(len(ids))
            else:
                children = np.bincount(inverse, weights=below, minlength=len(ids))
                weighted = np.logaddexp(estimate, children) - math.log(2)
                self.own[d] = np.exp(estimate - math.log(2) - weighted)
            to_node = inverse[to_node]
            self.index[d], self.kt[d] = to_node, (ones + 0.5) / (zeros + ones + 1.0)
            self.ids, self.zeros, self.ones, self.weighted = ids, zeros, ones, weighted
            below = weighted
            node = ((ids >> 16) << 8) | (ids & 255)

    def predict(self, depth: int, top: int) -> np.ndarray:
        """The probability of a one for each string and bit, mixed from ``depth`` up to ``top``."""
        p = self.kt[depth][self.index[depth]]
        for d in range(depth - 1, top - 1, -1):
            i = self.index[d]
            p = self.own[d][i] * self.kt[d][i] + (1.0 - self.own[d][i]) * p
        return p


def string_costs(counts: DataFrame, depth: int, rows_a_group: int = 50_000) -> DataFrame:
    """``counts`` (code, n) with ``cost``: log10 of the model's probability of the string's last byte after the others.

    Strings with the same two last context bytes make one subtree and meet in one group; a group holds several such
    subtrees.  The two upper levels have at most 256 x 255 nodes and are mixed on the driver.  Other columns are kept.
    """
    more = [f for f in counts.schema.fields if f.name not in ("code", "n")]
    groups = max(16, counts.count() // rows_a_group)
    pair = F.shiftright("code", 8 * (depth - 1))
    grouped = counts.withColumn("part", F.pmod(F.xxhash64(pair), F.lit(groups)).cast("int"))

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        levels = Levels(rows["code"].to_numpy(), rows["n"].to_numpy(), depth, 2)
        return pd.DataFrame(
            {
                "last": levels.ids >> 16, "prefix": levels.ids & 255, "zeros": levels.zeros, "ones": levels.ones,
                "below": levels.weighted,
            }
        )

    second = grouped.select("code", "n", "part").groupBy("part").applyInPandas(up, "last long, prefix long, zeros double, ones double, below double")
    first = second.groupBy("last", "prefix").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas()
    first = first.sort_values(["last", "prefix"])
    last, prefix = first["last"].to_numpy(np.int64), first["prefix"].to_numpy(np.int64)
    zeros, ones = first["zeros"].to_numpy(float), first["ones"].to_numpy(float)
    estimate = log_kt(zeros, ones)
    weighted = np.logaddexp(estimate, first["below"].to_numpy(float)) - math.log(2)
    own1 = np.exp(estimate - math.log(2) - weighted)
    root = [np.bincount(prefix, weights=x, minlength=256) for x in (zeros, ones, weighted)]
    root_estimate = log_kt(root[0], root[1])
    own0 = np.exp(root_estimate - np.logaddexp(root_estimate, root[2]))
    kt0 = (root[1] + 0.5) / (root[0] + root[1] + 1.0)
    base, factor = np.zeros((256, 256)), np.ones((256, 256))  # p = base + factor * p of the second level
    kt1 = (ones + 0.5) / (zeros + ones + 1.0)
    base[last, prefix] = own0[prefix] * kt0[prefix] + (1 - own0[prefix]) * own1 * kt1
    factor[last, prefix] = (1 - own0[prefix]) * (1 - own1)
    upper = counts.sparkSession.sparkContext.broadcast((base, factor))

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["code"].to_numpy()
        levels = Levels(codes, rows["n"].to_numpy(), depth, 2)
        before = np.repeat(codes >> (8 * depth), 8)
        one = upper.value[0][before, levels.prefix] + upper.value[1][before, levels.prefix] * levels.predict(depth, 2)
        chosen = np.where(levels.bit == 1, one, 1.0 - one)
        kept = {f.name: rows[f.name] for f in more}
        return pd.DataFrame({"code": codes, "cost": np.log10(chosen).reshape(-1, 8).sum(axis=1), **kept})

    schema = ", ".join(["code long, cost double", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])
    return grouped.groupBy("part").applyInPandas(down, schema)


class Costs:
    """Code -> cost, NaN without one: a table with one place a code; codes whose place is taken are found by bisection."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray) -> None:
        likely = np.argsort(-costs, kind="stable")  # they get their places first
        codes, costs = codes[likely], costs[likely]
        self.bits = max(4, int(2 * len(codes)).bit_length())
        place = self.place(codes)
        _, kept = np.unique(place, return_index=True)
        self.code = np.full(1 << self.bits, -1, np.int64)
        self.cost = np.zeros(1 << self.bits)
        self.code[place[kept]], self.cost[place[kept]] = codes[kept], costs[kept]
        rest = np.ones(len(codes), bool)
        rest[kept] = False
        order = np.argsort(codes[rest])
        self.rest, self.rest_cost = codes[rest][order], costs[rest][order]

    def place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        place = self.place(codes)
        out = self.cost[place]
        other = np.flatnonzero(self.code[place] != codes)
        if len(other):
            at = np.searchsorted(self.rest, codes[other])
            known = np.flatnonzero(at < len(self.rest))
            known = known[self.rest[at[known]] == codes[other[known]]]
            out[other] = np.nan
            out[other[known]] = self.rest_cost[at[known]]
        return out


def count_strings(df: DataFrame, depth: int) -> DataFrame:
    """Distinct strings of all texts of ``df`` (_text, _train) with their numbers in training texts, ``n``, and in all,
    ``uses``.  Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            codes, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            add = lambda k: np.bincount(inverse, weights=np.concatenate([x[k] for x in held]), minlength=len(codes))
            return codes, *(add(k).astype(np.int64) for k in (1, 2))

        for batch in batches:
            train = np.array(batch.column("_train").to_pylist(), bool)
            for first, _, streams in _streams(batch.column("_text").to_pylist()):
                codes, owner = strings(streams, depth)
                found, inverse, uses = np.unique(codes, return_inverse=True, return_counts=True)
                held.append((found, np.bincount(inverse[train[first + owner]], minlength=len(found)), uses))
                if sum(len(x[0]) for x in held) > 6 * FLUSH:
                    held[:] = [merged()]
                    if len(held[0][0]) > 3 * FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["code", "n", "uses"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["code", "n", "uses"])

    found = df.select("_text", "_train").mapInArrow(run, "code long, n long, uses long")
    return stored(found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "strings")


def _by_use(costs: DataFrame, most: int) -> Column:
    """The condition of the ``most`` most used strings, or somewhat fewer: those from a step of ``uses`` on."""
    step = F.floor(8 * F.log2(F.col("uses") + 1))
    held, least = 0, 1 << 20  # above the step of any number
    for at, n in sorted(map(tuple, costs.groupBy(step).count().collect()), reverse=True):
        held += n
        if held > most:
            break
        least = at
    return step >= least


def _counted(owner: np.ndarray, codes: np.ndarray, rows: int) -> pa.ListArray:
    """Per row its distinct codes with their numbers."""
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.zeros(0, int)
    n = np.diff(np.append(new, len(codes)))
    pairs = pa.StructArray.from_arrays([pa.array(codes[new], pa.int64()), pa.array(n, pa.int64())], ["code", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[new], np.arange(rows + 1)), pa.int32()), pairs)


def count_words(df: DataFrame) -> DataFrame:
    """Words of the training texts of ``df`` with their numbers; the empty word is the end token.  Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counter: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"]
            )

        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column("_text"):
                counter.update(tokens(text.as_py()))
                counter[b""] += 1
                if len(counter) > FLUSH:
                    yield batch_of(counter)
                    counter = Counter()
        yield batch_of(counter)

    found = df.where("_train").select("_text").mapInArrow(run, "word binary, n long")
    return stored(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


def score(df: DataFrame, held_out, depth: int = 5, broadcast_strings: int = BROADCAST_STRINGS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``df`` (doc_id, text).

    ``held_out`` is the condition of the rows that nothing is learned from.  A text is its words in lower case (A-Z),
    each two parted by one space, and one end, so null, empty and blank texts are just the end.  ``base_score`` is
    the sum of the tokens' log10 smoothed unigram probabilities, ``score`` log10 of the text's probability under
    context-tree weighting with ``depth`` bytes of context.  Without training texts every bit costs one bit.  Equal
    rows give equal rows, and other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select("doc_id", F.col("text").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("_train", ~F.col("held_out"))
    vocabulary = count_words(rows)
    known, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    hot = vocabulary.where(F.col("n") * HOT >= F.lit(total)).toArrow()
    costs = stored(string_costs(count_strings(rows, depth), depth), "costs")
    common = _by_use(costs, broadcast_strings)
    table = costs.where(common).select("code", "cost").toArrow()
    shared = spark.sparkContext.broadcast({"hot": hot, "table": [table[c].to_numpy() for c in ("code", "cost")]})
    del table, hot
    spread = total + 0.5 * (known + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = shared.value["hot"], shared.value
        if "costs" not in held:  # a worker makes it once
            held["costs"] = Costs(*held.pop("table"))
        lookup, number = held["costs"], TaskContext.get().partitionId() << 33
        base = {w: math.log10((n + 0.5) / spread) for w, n in zip(hot["word"].to_pylist(), hot["n"].to_pylist())}
        pairs = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for first, found, streams in _streams(batch.column("_text").to_pylist()):
                part = batch.slice(first, len(found))
                codes, owner = strings(streams, depth)
                cost = lookup.of(codes)
                far = np.isnan(cost)
                sums = np.bincount(owner, weights=np.where(far, 0.0, cost), minlength=len(found))
                n_tokens, n_known, scores, rest = [], [], [], []
                for own in found:
                    own = [*own, b""]
                    got = [base.get(w) for w in own]
                    missing = Counter(w for w, g in zip(own, got) if g is None)
                    n_tokens.append(len(own))
                    n_known.append(len(own) - sum(missing.values()))
                    scores.append(math.fsum(g for g in got if g is not None))
                    rest.append([{"word": w, "n": n} for w, n in missing.items()])
                row = np.arange(number, number + len(found))
                number += len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()),
                        pa.array(n_known, pa.int64()), pa.array(scores, pa.float64()), pa.array(sums, pa.float64()),
                        pa.array(rest, pairs), _counted(owner[far], codes[far], len(found)),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "strings"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(
        rows.select("doc_id", "held_out", "_text").mapInArrow(
            run,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
            "rest array<struct<word: binary, n: bigint>>, strings array<struct<code: bigint, n: bigint>>",
        ),
        "scored",
    )
    cost = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(spread))
    rare = (
        scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
        .join(vocabulary.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row").agg(
            F.sum(F.col("n") * cost).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("also")
        )
    )
    out = scored.drop("rest", "strings").join(rare, "row", "left")
    others = costs.where(~common).select("code", "cost")
    listed = scored.select("row", F.explode("strings").alias("s")).select("row", "s.code", "s.n").join(others, "code")
    out = out.join(listed.groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("_far")), "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_far", F.lit(0.0))).alias("score"),
    )
