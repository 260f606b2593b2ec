"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, context_tree, idfiles, language, lines, mixing, neardup, pages, runs, sharding, sketches, sql, whitening
from .common import shared_folder, words

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def vocabulary(remembered: int = bpe.CACHED) -> bpe.Vocabulary:
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without its repeated lines."""
    out = lines.drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.size("lines_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary()
    ids = bpe.encode(_read(spark, sf_dir, "documents"), words)
    back = bpe.decode(ids, words, keep=("doc_id", "ids"))
    return back.select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").withColumn("held_out", remainder(3) == 1)
    filters = language.learn(documents.where(~F.col("held_out")))
    return language.identify(documents, filters, keep=("doc_id", "held_out"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(_read(spark, sf_dir, "documents"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_read(spark, sf_dir, "documents"), remainder(5) == 1)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long, which takes some ten million distinct vectors, is null here; the operator has it as a decimal."""
    white = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def repeated_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, text), the words from a on repeating the p words there where the document's number asks for it.

    A null doc_id has no number, so its text stays as it is.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(number / 10)
    chosen = F.when(F.pmod(number, F.lit(10)) == 0, words(F.col("text")))
    split = documents.select("doc_id", "text", g.alias("g"), chosen.alias("own")).withColumn("n", F.size("own").cast("long"))
    placed = split.withColumn("a", F.expr("pmod(g, nullif(n, 0))")).withColumn("p", F.expr("1 + (n - a) div (3 + pmod(g, 8))"))
    unit = F.slice("own", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.expr("int((n - a + p - 1) div p)")))
    changed = F.slice(F.concat(F.slice("own", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n").cast("int"))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(repeated_tails(_read(spark, sf_dir, "documents")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    idfiles.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return idfiles.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_line_dedup, op3_byte_bpe, op4_main_text, op5_near_duplicates, op6_source_mix, op7_balanced_shards,
        op8_language, op9_fingerprints, op10_context_tree, op11_whitening, op12_periodic_runs, op13_token_files,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": sql.LINE_DEDUP,
    "op5_near_duplicates": sql.NEAR_DUPLICATES,
    "op6_source_mix": sql.SOURCE_MIX,
    "op9_fingerprints": sql.FINGERPRINTS,
}
