"""Follow growing run directories with Structured Streaming.

State is one row per (chain, parameter), topology or clade; no windows and no
watermarks, because samples are ordered by ``gen`` and never late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lociframe.operators.newick import tree_taxa, tree_topologies
from lociframe.operators.trees import strip_tree_attributes

TRACE_SCHEMA = "chain string, gen long, param string, value double"
TREE_SCHEMA = "chain string, gen long, newick string"
MANIFEST = "first long, last long, folder string"
MARKS = "chain string, param string, last long"


def stream_trace(
    spark: SparkSession, directory: str, schema: str | StructType = TRACE_SCHEMA, fmt: str = "parquet", files_per_trigger: int = 100,
    columns: list[str] | None = None,
) -> DataFrame:
    """New samples of a run directory as they are appended.

    With ``columns`` the files are tab-separated logs with a ``Gen`` header and
    are unpivoted; otherwise they already have ``schema``.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if columns is None:
        return reader.schema(schema).format(fmt).load(directory)
    wide_schema = ", ".join(["Gen long", *[f"`{c}` double" for c in columns]])
    wide = reader.schema(wide_schema).option("sep", "\t").option("header", True).option("nullValue", "-").csv(directory)
    wide = wide.withColumn("chain", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(f"`{c}`").alias("value")) for c in columns]))
    return wide.select("chain", F.col("Gen").alias("gen"), cells.alias("c")).select("chain", "gen", "c.param", "c.value")


def stream_running_mean(trace: DataFrame) -> DataFrame:
    """Samples so far and their mean, per (chain, parameter)."""
    return trace.groupBy("chain", "param").agg(F.count("value").alias("n"), F.avg("value").alias("rmean"))


def stream_newick_counts(trees: DataFrame) -> DataFrame:
    """Samples per attribute-free tree text: the state behind the posteriors."""
    return strip_tree_attributes(trees).groupBy("newick").agg(F.count(F.lit(1)).alias("n"))


def expand_counts(newick_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topology and clade counts from the current text counts (a batch table)."""
    topologies = tree_topologies(newick_counts, ["n"]).groupBy("topology").agg(F.sum("n").alias("n"))
    return topologies, tree_taxa(newick_counts, ["n"], proper=True).groupBy("clade").agg(F.sum("n").alias("n"))


def _commit(spark: SparkSession, sink: str, batch_id: int, folder: str, first: int) -> None:
    """Enter ``folder`` in the manifest as what batches ``first`` to ``batch_id`` gave.

    The entry is one small file that Spark's own commit puts in place; a batch that is replayed puts the same one there.
    """
    entry = spark.createDataFrame([(first, batch_id, folder)], MANIFEST)
    entry.coalesce(1).write.mode("overwrite").json(f"{sink}/manifest/entry={batch_id}-{first}")


def _committed(spark: SparkSession, sink: str) -> list[tuple[int, int, str]]:
    """(first, last, folder) of the committed batches in order: the widest compaction, then the batches after it.

    The manifest has a row for each batch, whatever the batches hold.
    """
    try:
        rows = spark.read.schema(MANIFEST).json(f"{sink}/manifest").select("first", "last", "folder").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []  # nothing was committed yet
    entries = sorted(((r["first"], r["last"], r["folder"]) for r in rows), key=lambda e: (e[0], -e[1]))
    out, last = [], -1
    for entry in entries:
        if entry[0] > last:
            out.append(entry)
            last = entry[1]
    return out


def _nothing(step: str) -> None:
    """What ``on_step`` is called with after each step of a batch: ``written`` and ``committed``."""


def _start(df: DataFrame, mode: str, checkpoint: str, publish: Callable[[DataFrame, int], None], available_now: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_topology_posterior(
    trees: DataFrame, checkpoint: str, sink: str, available_now: bool = False, slots: int = 3, on_step: Callable[[str], None] = _nothing
) -> StreamingQuery:
    """Keep topology and clade counts up to date in ``sink``; read them with :func:`topology_state`.

    The streaming state holds one count per tree text; after each batch the few texts are rewritten as canonical
    topologies and clades.  A batch writes both tables to the next of ``slots`` folders and then commits it, so a reader
    never sees one table of a batch without the other, and the sink does not grow with the number of batches.
    """

    def publish(counts: DataFrame, batch_id: int) -> None:
        counts = counts.persist()  # parsed once for each table
        topologies, found = expand_counts(counts)
        folder = f"{sink}/slot={batch_id % slots}"
        topologies.write.mode("overwrite").parquet(f"{folder}/topologies")
        found.write.mode("overwrite").parquet(f"{folder}/clades")
        counts.unpersist()
        on_step("written")
        _commit(counts.sparkSession, sink, batch_id, folder, 0)  # counts are complete: they stand for all batches so far
        on_step("committed")

    return _start(stream_newick_counts(trees), "complete", checkpoint, publish, available_now)


def topology_state(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """(topology, n) and (clade, n) as of the last committed batch."""
    entries = _committed(spark, sink)
    if not entries:
        return spark.createDataFrame([], "topology string, n long"), spark.createDataFrame([], "clade array<string>, n long")
    folder = entries[-1][2]
    return spark.read.parquet(f"{folder}/topologies"), spark.read.parquet(f"{folder}/clades")


def _read_samples(spark: SparkSession, entries: list[tuple[int, int, str]], table: str, schema: str) -> DataFrame:
    paths = [f"{folder}/{table}" for _, _, folder in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_resume(
    trace: DataFrame, checkpoint: str, sink: str, available_now: bool = True, on_step: Callable[[str], None] = _nothing
) -> StreamingQuery:
    """Append samples to ``sink`` exactly once across restarts; read them with :func:`durable_samples`.

    Offsets live in ``checkpoint``.  A batch writes its samples and the last ``gen`` of every (chain, param) so far to
    its own folder and then commits it to the manifest.  A batch that is replayed after a failure starts from the same
    committed batches and replaces what it had written.  A run that goes back to a saved state writes samples again that
    are there already.  Samples beyond the marks are new; the others, if any, are compared with the committed samples of
    their stretch of ``gen``, so files may also come in any order, and no later read has to compare samples.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [e for e in _committed(spark, sink) if e[1] < batch_id]
        marks = _read_samples(spark, earlier[-1:], "marks", MARKS)  # a row for each chain and parameter
        batch = batch.dropDuplicates(["chain", "gen", "param"])
        b, m = batch.alias("b"), marks.alias("m")
        behind = b.join(m, F.expr("b.chain <=> m.chain AND b.param <=> m.param AND b.gen <= m.last"), "left_semi")
        span = behind.agg(F.min("gen").alias("low"), F.max("gen").alias("high")).first()
        if span["low"] is not None:  # only samples of that stretch can be there already
            there = _read_samples(spark, earlier, "samples", TRACE_SCHEMA).filter(F.col("gen").between(span["low"], span["high"])).alias("t")
            batch = b.join(there, F.expr("b.chain <=> t.chain AND b.param <=> t.param AND b.gen = t.gen"), "left_anti")
        folder = f"{sink}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{folder}/samples")
        own = spark.read.schema(batch.schema).parquet(f"{folder}/samples").select("chain", "param", F.col("gen").alias("last"))
        ends = marks.unionByName(own).groupBy("chain", "param").agg(F.max("last").alias("last"))
        ends.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks")
        on_step("written")
        _commit(spark, sink, batch_id, folder, batch_id)
        on_step("committed")

    return _start(trace, "append", checkpoint, publish, available_now)


def compact(spark: SparkSession, sink: str, rows_a_file: int = 5_000_000) -> None:
    """Rewrite the samples of all committed batches as one folder, which later reads take in their place.

    May run beside the stream: batches that are committed meanwhile follow the compacted ones.  The old folders stay,
    as a reader may be in them; they may be removed when no read from before is under way.
    """
    entries = _committed(spark, sink)
    if len(entries) < 2:
        return
    first, last = entries[0][0], entries[-1][1]
    folder = f"{sink}/compact={first}-{last}"
    samples = _read_samples(spark, entries, "samples", TRACE_SCHEMA)
    samples.repartitionByRange("chain", "param", "gen").write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").parquet(f"{folder}/samples")
    _read_samples(spark, entries[-1:], "marks", MARKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks")
    _commit(spark, sink, last, folder, first)


def durable_samples(spark: SparkSession, sink: str) -> DataFrame:
    """All samples of committed batches of :func:`stream_resume`, one row per (chain, gen, param)."""
    return _read_samples(spark, _committed(spark, sink), "samples", TRACE_SCHEMA)
