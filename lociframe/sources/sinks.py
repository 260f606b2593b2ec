"""Writers for patterns, alignments, traces and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.align import CHUNK

_HEX_TO_BASE = ("123456789abcdef", "ACMGRSVTWYHKDBN")  # fixed values: IUPAC letters by mask


def pattern_text(patterns: DataFrame, labels: DataFrame) -> DataFrame:
    """(locus, text): a compressed alignment with its weight line, header flag P.

    One locus is one text; ``labels(locus, seq_idx, label)``.
    """
    lettered = patterns.withColumn("column", F.translate("column", *_HEX_TO_BASE))
    packed = lettered.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("pattern_id", "column", "weight"))).alias("p"))
    names = labels.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("seq_idx", "label"))).alias("l"))
    both = packed.join(names, "locus")
    rows = F.transform(
        "l",
        lambda x, i: F.concat(x["label"], F.lit("  "), F.array_join(F.transform("p", lambda c: F.substring(c["column"], i + 1, F.lit(1))), "")),
    )
    weights = F.array_join(F.transform("p", lambda c: c["weight"].cast("string")), " ")
    header = F.concat_ws(" ", F.size("l"), F.size("p"), F.lit("P"))
    return both.select("locus", F.concat_ws("\n", header, F.array_join(rows, "\n"), weights).alias("text"))


def write_patterns(patterns: DataFrame, path: str, labels: DataFrame | None = None, fmt: str = "parquet") -> None:
    """Parquet clustered by locus, or text files when ``fmt='text'``."""
    if fmt == "text":
        pattern_text(patterns, labels).select("text").write.mode("overwrite").text(path, lineSep="\n\n")
    else:
        patterns.repartition("locus").sortWithinPartitions("locus", "pattern_id").write.mode("overwrite").format(fmt).save(path)


def concat_chunks(sequences: DataFrame, tag: str = "label") -> DataFrame:
    """(label, locus, chunk, piece): the joined alignment as ordered pieces.

    For corpora whose joined sequences exceed one row; order by (label, locus,
    chunk) to stream them out.
    """
    pieces = F.posexplode(F.expr(f"regexp_extract_all(sequence, '.{{1,{CHUNK}}}', 0)"))
    return sequences.select(F.col(tag).alias("label"), "locus", pieces.alias("chunk", "piece"))


def concat_alignment(sequences: DataFrame, tag: str = "label") -> DataFrame:
    """(label, sequence): all loci joined end to end per label, in locus order."""
    packed = sequences.groupBy(F.col(tag).alias("label")).agg(F.array_sort(F.collect_list(F.struct("locus", "sequence"))).alias("s"))
    return packed.select("label", F.array_join(F.transform("s", lambda x: x["sequence"]), "").alias("sequence"))


def write_concat(sequences: DataFrame, path: str, tag: str = "label") -> None:
    """Write the joined alignment as ordered pieces, one folder per label.

    Range partitioning keeps long labels spread over many files whose names
    follow the order.
    """
    chunks = concat_chunks(sequences, tag)
    chunks.repartitionByRange("label", "locus", "chunk").sortWithinPartitions("label", "locus", "chunk").write.mode(
        "overwrite"
    ).parquet(path)


def wide_trace(trace: DataFrame, params: list[str]) -> DataFrame:
    """One row per sample in the given column order; lnL with 3 decimals, others 6."""
    text = F.when(F.col("param") == "lnL", F.format_string("%.3f", "value")).otherwise(F.format_string("%.6f", "value"))
    wide = trace.withColumn("text", text).groupBy("chain", "gen").pivot("param", params).agg(F.first("text"))
    return wide.select("chain", F.col("gen").alias("Gen"), *[f"`{p}`" for p in params])


def write_trace(trace: DataFrame, path: str, params: list[str]) -> None:
    """Tab-separated log per chain, ordered by iteration."""
    wide = wide_trace(trace, params)
    wide.repartitionByRange("chain", "Gen").sortWithinPartitions("chain", "Gen").write.mode("overwrite").partitionBy("chain").csv(
        path, sep="\t", header=True, nullValue="-"
    )


def write_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    summary.write.mode("overwrite").format(fmt).save(path)
