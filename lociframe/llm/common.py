"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: ASCII only, as bytes.split() has it.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return _own_folder()
    return folder


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lociframe-llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, the same rows at each use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, native."""
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: Iterable[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null as empty) in runs of about ``limit`` characters, with the first one's number."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run
