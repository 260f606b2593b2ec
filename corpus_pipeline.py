"""A training corpus from raw documents: language filter, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs.  All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import bpe, language, lines, mixing, neardup
from lociframe.llm.common import stored
from lociframe.llm.queries import remainder, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; null, empty and letterless texts go.

    Each row is judged on its own: repeated rows and a null doc_id are kept or go like others; of an empty table none.
    """
    filters = language.learn(docs.where(remainder(3) != 1))
    return language.accept(docs.select(*COLUMNS), filters)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars anew; documents that lose every line with a word go.

    The earliest of equal lines is that of the smallest doc_id (null first); rows that repeat doc_id and text lose the
    same lines; null and empty texts stay as they are; an empty table gives no rows.
    """
    out = lines.drop_repeated_lines(docs.select(*COLUMNS))
    emptied = F.col("lines_dropped").isNotNull() & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarities of 0.8 or more link, the document that is first by doc_id (null last) and hash of
    the text; rows that repeat both a doc_id and a text count once."""
    kept = neardup.groups(docs, percent=80).where("stays").select("doc_id", "text_key").distinct()
    d, k = docs.select(*COLUMNS).withColumn("_text_key", F.xxhash64("text")).alias("d"), kept.alias("k")
    joined = d.join(k, F.expr("d.doc_id <=> k.doc_id AND d._text_key = k.text_key"), "left_semi")
    one = joined.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows that repeat doc_id, source and text are one row that is taken as often as all of them together; null and
    wordless texts are never taken; a null doc_id or source is a value like others, and an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    key = ("doc_id", "source", "text_key")
    taken = stored(mixing.mix(docs).where("copies > 0").groupBy(*key).agg(F.sum("copies").alias("copies")), "taken")
    one = docs.groupBy("doc_id", "source", F.xxhash64("text").alias("text_key"), "text").agg(F.min(F.struct("lang", "n_chars")).alias("rest"))
    joined = one.alias("d").join(taken.alias("t"), F.expr(" AND ".join(f"d.{c} <=> t.{c}" for c in key)))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t.copies"))))
    return each.select("d.doc_id", "d.text", "d.rest.lang", "d.source", "d.rest.n_chars").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (binary, little-endian unsigned 32-bit), n_tokens, and a digest of the decoded text.

    A row for each row, repeated ones too; null and empty texts have no ids.
    """
    words = vocabulary(remembered=100_000)  # the workers of earlier stages are still there
    ids = bpe.encode(docs, words, keep=("doc_id", "source"))
    back = bpe.decode(ids, words, keep=("doc_id", "source", "ids"))
    return back.select("doc_id", "source", "ids", bpe.n_tokens().alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The stages learn filters, confirm on shingle sets and encode by ranks, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
