"""Language identification with bit-sliced Bloom filters over character trigrams.

Each language has a Bloom filter of the trigrams typical of it.  The filters share their hash positions and are stored
sliced: one slot holds a bit per language, so that the AND of a trigram's slots is the mask of all languages that
contain it.  Per language the bits set over a text are counted, corrected for the filter's false positives, and the
largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, mix64, stored

UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for everything that is no letter."""
    table = np.full(0x110000, 32, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (21 bits a character) around every letter of the texts, and each one's text number.

    Everything that is no letter counts as a space, also both ends of a text.
    """
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[points].astype(np.int64)
    at = np.flatnonzero(low[1:-1] != 32) + 1
    grams = (low[at - 1] << 42) | (low[at] << 21) | low[at + 1]
    starts = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    return grams, np.searchsorted(starts, at, side="right") - 1


@dataclass(frozen=True)
class Filters:
    """Bit-sliced filters: ``slots[i, w]`` holds the bits of languages 64w to 64w+63 at position i."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray, probes: int = 3) -> np.ndarray:
        """The mask of the languages containing each trigram."""
        at = positions(grams, len(self.slots), probes)
        out = self.slots[at[0]]
        for p in at[1:]:
            out = out & self.slots[p]
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of trigrams found, and the number of trigrams."""
        grams, owner = trigrams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.masks(grams)
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits = np.bincount(owner, weights=bit.astype(float), minlength=len(texts))
            rate = self.false_rate[k]
            out[:, k] = np.maximum(0.0, hits - total * rate) / (1.0 - rate)
        return out / np.maximum(total, 1.0)[:, None], total


def positions(grams: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    one = mix64(grams.astype(np.uint64))
    two = mix64(one) | np.uint64(1)
    return [((one + np.uint64(i) * two) & np.uint64(slots - 1)).astype(np.int64) for i in range(probes)]


def build(entries: list[tuple[str, int]], languages: list[str], probes: int = 3) -> Filters:
    """Filters from (language, trigram) entries; the number of slots gives each language 16 bits an entry."""
    by: dict[str, list[int]] = {x: [] for x in languages}
    for language, gram in entries:
        by[language].append(gram)
    slots = 1 << max(10, (16 * max([len(v) for v in by.values()], default=1) - 1).bit_length())
    sliced = np.zeros((slots, -(-max(1, len(languages)) // 64)), np.uint64)
    rates = np.zeros(len(languages))
    for k, language in enumerate(languages):
        for p in positions(np.array(by[language], np.int64), slots, probes):
            sliced[p, k // 64] |= np.uint64(1 << (k % 64))
        fill = float(np.mean((sliced[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)))
        rates[k] = min(0.5, fill**probes)
    return Filters(tuple(languages), sliced, rates)


def learn(
    labelled: DataFrame, sample_rows: int = 4000, least_share: float = 2e-5, next_share: float = 0.25
) -> Filters:
    """Filters from ``labelled`` (text, lang); rows with a null in either do not count.

    ``sample_rows`` bounds the classifier's training sample: about so many rows of each language, chosen by the hash
    of their text, and each chosen row with its whole text.  A trigram enters a language's filter when it makes up
    ``least_share`` of that language's trigrams (hence at most 1/least_share entries a language, the bound of what
    reaches the driver) and at least ``next_share`` of its share in the language where it is most common.  No rows
    give filters without languages.
    """
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows_of_lang")), "languages")  # small: a row for each
    drawn = (
        rows.join(sizes, "lang")
        .where((F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * F.col("rows_of_lang")) < F.lit(sample_rows << 30))
        .select("text", "lang")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column("text"))
            names = batch.column("lang").to_pylist()
            codes = {x: i for i, x in enumerate(sorted(set(names)))}
            for first, run in chunks(texts):
                grams, owner = trigrams(run)
                lang = np.array([codes[x] for x in names[first : first + len(run)]])[owner]
                for name, k in codes.items():
                    found, n = np.unique(grams[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    common = counts.select("lang", "gram", share.alias("share")).where(F.col("share") >= least_share)
    best = F.max("share").over(Window.partitionBy("gram"))
    kept = common.withColumn("best", best).where(F.col("share") >= next_share * F.col("best"))
    entries = [(r.lang, r.gram) for r in kept.select("lang", "gram").collect()]
    return build(entries, sorted({x for x, _ in entries}))


def _judge(filters: Filters, texts: Iterable[str | None], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, confidence and share of known trigrams of each of ``n`` texts."""
    names, score, known = [], np.zeros(n), np.zeros(n)
    for first, run in chunks(texts):
        if not filters.languages:
            names += [UNDETERMINED] * len(run)
            continue
        shares, total = filters.shares(run)
        best = shares.argmax(axis=1)
        top = shares.max(axis=1)
        sums = shares.sum(axis=1)
        names += [filters.languages[b] if letters else UNDETERMINED for b, letters in zip(best, total)]
        score[first : first + len(run)] = np.divide(top, sums, out=np.zeros(len(run)), where=sums > 0)
        known[first : first + len(run)] = top
    return names, np.clip(score, 0.0, 1.0), np.clip(known, 0.0, 1.0)


def identify(df: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (the winner's part of all languages' corrected counts) per row.

    `und` with score 0 for null, empty and letterless texts, and for all if no language was learned.  A text whose
    trigrams are all unknown gets the first language with score 0; ties go to the smaller language.  Other columns
    are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, _ = _judge(shared.value, (x.as_py() for x in batch.column(batch.num_columns - 1)), batch.num_rows)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def accept(df: DataFrame, filters: Filters, text: str = "text", least_known: float = 0.2) -> DataFrame:
    """The rows of ``df``, all columns, whose text is in a learned language.

    Rejected: texts that are `und`, and texts of which less than ``least_known`` of the trigrams belong to the
    winner.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, known = _judge(shared.value, (x.as_py() for x in batch.column(batch.schema.names.index(text))), batch.num_rows)
            yield batch.filter(pa.array([n != UNDETERMINED and k >= least_known for n, k in zip(names, known)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
