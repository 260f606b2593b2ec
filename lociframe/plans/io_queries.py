"""Round trips through the text formats, and the streaming operators.

Each query writes the derived tables in the format an analysis produces, reads
them back with the library's reader, and must return the original rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import trace as T
from lociframe.plans.align_queries import IMAP, PARTS, PATS, SEQS, patterns
from lociframe.plans.registry import query, r, scratch
from lociframe.plans.trace_queries import COND, MIG, TRACE
from lociframe.plans.tree_queries import SAMPLE, TIMED
from lociframe.sources import adapters as A
from lociframe.sources import sinks, text
from lociframe.streaming import monitor

_DIGEST = f"WITH {SEQS} SELECT label, seq_idx, CAST(length(sequence) AS INTEGER) AS len, md5(sequence) AS digest FROM seqs"


def _digest(df):
    return df.select("label", "seq_idx", F.length("sequence").alias("len"), F.md5("sequence").alias("digest"))


def _phylip(sequences):
    """One text per locus: header, then label and sequence in lines of 60."""
    wrapped = F.array_join(F.expr("regexp_extract_all(sequence, '.{1,60}', 0)"), "\n")
    rows = sequences.groupBy("locus").agg(
        F.array_sort(F.collect_list(F.struct("seq_idx", F.concat("label", F.lit("  "), wrapped).alias("t")))).alias("s"),
        F.max(F.length("sequence")).alias("len"),
    )
    body = F.array_join(F.transform("s", lambda x: x["t"]), "\n")
    return rows.select(F.concat(F.size("s"), F.lit(" "), "len", F.lit("\n"), body).alias("value"))


@query("read_alignments", _DIGEST)
def read_alignments(spark, sf):
    path = scratch(spark, "phylip") + "/a"
    _phylip(A.sequences(spark, sf)).write.text(path)
    return _digest(text.number_loci(text.read_alignments(spark, path)))


def _text(df, spark, name):
    path = scratch(spark, name) + "/t"
    df.write.text(path)
    return path


@query("read_imap", f"WITH {IMAP} SELECT * FROM imap")
def read_imap(spark, sf):
    lines = A.imap(spark, sf).select(F.concat_ws("\t", "individual", "species").alias("value"))
    return text.read_imap(spark, _text(lines, spark, "imap"))


@query("read_dates", "SELECT 'o' || o_orderkey AS label, o_totalprice AS age FROM orders")
def read_dates(spark, sf):
    lines = A.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey", F.lit(" "), "o_totalprice").alias("value"))
    return text.read_dates(spark, _text(lines, spark, "dates"))


def _wide_file(trace, params, spark, name):
    """Tab-separated logs with a ``Gen`` header; absent values show ``-``."""
    wide = trace.groupBy("chain", "gen").pivot("param", params).agg(F.first("value"))
    path = scratch(spark, name) + "/t"
    ordered = wide.repartitionByRange("chain", "gen").sortWithinPartitions("chain", "gen")
    ordered.select(F.col("gen").alias("Gen"), *[f"`{p}`" for p in params]).write.csv(path, sep="\t", header=True, nullValue="-")
    return path


_PARAMS = ["click", "error", "purchase", "signup", "view"]


@query("read_trace", f"WITH {TRACE} SELECT param, gen, value FROM trace")
def read_trace(spark, sf):
    path = _wide_file(A.trace(spark, sf), _PARAMS, spark, "trace")
    return text.read_trace(spark, path).filter("value is not null").select("param", "gen", "value")


@query("read_wide_trace", f"WITH {TRACE} SELECT param, gen, value FROM trace")
def read_wide_trace(spark, sf):
    path = _wide_file(A.trace(spark, sf), _PARAMS, spark, "wide")
    return text.read_wide_trace(spark, path, _PARAMS).filter("value is not null").select("param", "gen", "value")


@query("repair_trace_rows", f"WITH {TRACE} SELECT gen, param, value FROM trace WHERE gen % 10 <> 5")
def repair_trace_rows(spark, sf):
    """Every tenth line loses its value and must be dropped."""
    rows = A.trace(spark, sf).select(F.col("param").alias("chain"), F.col("gen").cast("int").alias("line_no"), "gen", "value")
    cut = F.when(F.col("gen") % 10 == 5, F.col("gen").cast("string")).otherwise(F.concat_ws("\t", "gen", "value"))
    lines = rows.select("chain", "line_no", cut.alias("line"))
    header = rows.select("chain").distinct().select("chain", F.lit(0).alias("line_no"), F.lit("Gen\tx").alias("line"))
    good, _ = text.repair_trace_rows(lines.unionByName(header))
    return good.select(F.col("fields")[0].cast("long").alias("gen"), F.col("chain").alias("param"), F.col("fields")[1].cast("double").alias("value"))


@query("read_conditionals", f"WITH {COND} SELECT param, gen, a1, b1 FROM cond")
def read_conditionals(spark, sf):
    cond = A.conditionals(spark, sf)
    cells = cond.select("chain", "gen", F.explode(F.array(
        F.struct(F.concat("param", F.lit("_a1")).alias("param"), F.col("a1").alias("value")),
        F.struct(F.concat("param", F.lit("_b1")).alias("param"), F.col("b1").alias("value")),
    )).alias("c")).select("chain", "gen", "c.*")
    path = _wide_file(cells, [f"{p}_{s}" for p in "ANR" for s in ("a1", "b1")], spark, "cond")
    return text.read_conditionals(spark, path).filter("a1 is not null").select("param", "gen", "a1", "b1")


@query("read_tree_sample", f"WITH {TIMED} SELECT CASE WHEN x0 > 0 THEN 1 ELSE 0 END + CASE WHEN y0 > 0 THEN 1 ELSE 0 END + 2 AS n_species, count(*) AS n FROM timed GROUP BY 1")
def read_tree_sample(spark, sf):
    lines = A.timed_trees(spark, sf).select(F.concat_ws(" ", "newick", "n_species").alias("value"))
    out = text.read_tree_sample(spark, _text(lines, spark, "trees"))
    return out.groupBy("n_species").agg(F.count(F.lit(1)).alias("n"))


@query("read_delim_sample", "SELECT o_orderkey AS gen, CAST(o_orderkey % 4 AS INTEGER) AS np, repeat('1', CAST(o_orderkey % 4 AS INTEGER)) || repeat('0', CAST(3 - o_orderkey % 4 AS INTEGER)) AS model FROM orders")
def read_delim_sample(spark, sf):
    k = (F.col("o_orderkey") % 4).cast("int")
    model = F.concat(F.repeat(F.lit("1"), k), F.repeat(F.lit("0"), 3 - k))
    lines = A.table(spark, sf, "orders").select(F.concat_ws("\t", "o_orderkey", k, model, F.lit("0.1")).alias("value"))
    return text.read_delim_sample(spark, _text(lines, spark, "delim")).select("gen", "np", "model")


def _per_locus(df, header, spark, name):
    """One file per locus with the rows ``line`` in the order of ``gen``."""
    rows = df.select("locus", F.col("gen").cast("long").alias("gen"), "line")
    if header:
        top = df.select("locus").distinct().select("locus", F.lit(-1).cast("long").alias("gen"), F.lit(header).alias("line"))
        rows = rows.unionByName(top)
    path = scratch(spark, name) + "/t"
    placed = rows.withColumn("file", F.concat(F.lit("L"), "locus")).repartition("file").sortWithinPartitions("file", "gen")
    placed.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    return path


_BY_FOLDER = r"file=L(\d+)"


@query("read_gene_trees", f"WITH {TIMED} SELECT k % 40 AS locus, round(z0 / 1000.0, 6) AS th, count(*) AS n FROM timed GROUP BY 1, 2")
def read_gene_trees(spark, sf):
    trees = A.timed_trees(spark, sf)
    height = F.regexp_extract("newick", r"D:([0-9.]+)\);$", 1)
    lines = trees.select((F.col("gen") % 40).alias("locus"), "gen", F.concat("newick", F.lit(" [TH="), height, F.lit(", TL=1.0]")).alias("line"))
    path = _per_locus(lines, None, spark, "gtrees")
    out = text.read_gene_trees(spark, path, _BY_FOLDER)
    return out.groupBy("locus", r("th")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_migration_history",
    """WITH e AS (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [NULL] END) AS event, o_totalprice / 1e6 AS p FROM orders)
    SELECT o_orderkey % 40 AS locus, 'A' AS node_pop, event, CASE event WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS source,
      CASE event WHEN 0 THEN 'B' WHEN 1 THEN 'C' END AS target, event = 1 AND event IS NOT NULL AS crossing,
      round(sum(CASE event WHEN 0 THEN p WHEN 1 THEN p + 1 END), 6) AS t, count(*) AS n
    FROM e GROUP BY 1, 3""",
)
def read_migration_history(spark, sf):
    o = A.table(spark, sf, "orders")
    p = F.col("o_totalprice") / 1e6
    moved = F.concat(F.lit("A:"), p.cast("string"), F.lit("*B&A$"), (p + 1).cast("string"), F.lit("*C&B;"))
    line = F.when(F.col("o_orderkey") % 2 == 0, moved).otherwise(F.lit("A:;"))
    lines = o.select((F.col("o_orderkey") % 40).alias("locus"), F.col("o_orderkey").alias("gen"), line.alias("line"))
    history = text.read_migration_history(spark, _per_locus(lines, None, spark, "migs"), _BY_FOLDER)
    out = text.mark_crossings(history, spark.createDataFrame([("A", "D"), ("B", "C")], "label string, parent string"))
    return out.groupBy("locus", "node_pop", "event", "source", "target", "crossing").agg(
        r(F.sum("time")).alias("t"), F.count(F.lit(1)).alias("n")
    )


_MIGWIDE = """w AS (SELECT locus, gen, sum(n) FILTER (source = 0) AS a, sum(n) FILTER (source = 1) AS b, sum(n) FILTER (source = 2) AS c, sum(n) FILTER (source = 3) AS d FROM mig GROUP BY 1, 2)"""


@query(
    "read_migcounts",
    f"WITH {MIG}, {_MIGWIDE} SELECT locus, s AS source, CASE s WHEN 'A' THEN 'B' ELSE 'A' END AS target, CAST(sum(coalesce(CASE s WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END, 0)) AS BIGINT) AS n FROM w, (VALUES ('A'), ('B'), ('C'), ('D')) v(s) GROUP BY 1, 2, 3",
)
def read_migcounts(spark, sf):
    mig = A.migcounts(spark, sf)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("source") == k, F.col("n"))), F.lit(0))
    lines = mig.groupBy("locus", "gen").agg(F.concat_ws("\t", *map(total, range(4))).alias("line"))
    out = text.read_migcounts(spark, _per_locus(lines, "W_A->B\tW_B->A\tW_C->A\tW_D->A", spark, "migcounts"), _BY_FOLDER)
    return out.groupBy("locus", "source", "target").agg(F.sum("n").alias("n"))


@query("read_locus_rates", "SELECT o_orderkey % 40 AS locus, p AS param, round(sum(CASE p WHEN 'mu' THEN o_totalprice / 1e6 ELSE o_orderkey / 8.0 END), 4) AS total, count(*) AS n FROM orders, (VALUES ('mu'), ('kappa')) v(p) GROUP BY 1, 2")
def read_locus_rates(spark, sf):
    lines = A.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 40).alias("locus"), F.col("o_orderkey").alias("gen"),
        F.concat_ws("\t", F.col("o_totalprice") / 1e6, F.col("o_orderkey") / 8).alias("line"),
    )
    out = text.read_locus_rates(spark, _per_locus(lines, "mu\tkappa", spark, "rates"), _BY_FOLDER)
    return out.groupBy("locus", "param").agg(r(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("read_partitions", f'WITH {PARTS} SELECT start + 1 AS start, "end" + 1 AS "end", dtype, model FROM parts')
def read_partitions(spark, sf):
    lines = A.partitions(spark, sf).select(
        F.concat(F.col("start") + 1, F.lit("-"), F.col("end") + 1, F.lit(", "), "dtype", F.lit(", "), F.lower("model")).alias("value")
    )
    return text.read_partitions(spark, _text(lines, spark, "parts"))


@query("read_traits", "SELECT 'c' || c_custkey AS label, 0 AS char_idx, c_acctbal AS value FROM customer UNION ALL SELECT 'c' || c_custkey, 1, c_nationkey FROM customer")
def read_traits(spark, sf):
    c = A.table(spark, sf, "customer")
    rows = c.groupBy("c_nationkey").agg(
        F.collect_list(F.concat(F.lit("c"), "c_custkey", F.lit(" "), "c_acctbal", F.lit(" "), "c_nationkey")).alias("s")
    )
    block = F.concat(F.size("s"), F.lit(" 2 C 0.5 0.0\n"), F.array_join("s", "\n"))
    out = text.read_traits(spark, _text(rows.select(block.alias("value")), spark, "traits"))
    return out.select("label", "char_idx", "value")


@query("read_beta_weights", "SELECT (o_orderkey % 8 + 0.5) / 8 AS beta, round(2.0 * count(*) / (SELECT count(*) FROM orders), 9) AS weight FROM orders GROUP BY 1")
def read_beta_weights(spark, sf):
    w = A.beta_weights(spark, sf).groupBy().agg(F.array_sort(F.collect_list(F.struct("beta", "weight"))).alias("s"))  # eight rows
    body = F.array_join(F.transform("s", lambda x: F.concat_ws(",", x["beta"], x["weight"], F.lit(""))), "\n")
    lines = w.select(F.concat(F.lit("beta,weight,ElnfX\n"), body).alias("value"))
    return text.read_beta_weights(spark, _text(lines, spark, "beta")).select("beta", r("weight", 9))


@query("read_active_rates", "SELECT l_orderkey % 1000 AS gen, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || '->' || l_linestatus END AS pair, count(*) AS n FROM lineitem GROUP BY 1, 2")
def read_active_rates(spark, sf):
    token = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("\tW_"), "l_returnflag", F.lit("->"), "l_linestatus", F.lit("="), F.col("l_quantity") / 10)).otherwise("")
    lines = A.table(spark, sf, "lineitem").select(F.concat((F.col("l_orderkey") % 1000).cast("string"), F.lit("\t0.01"), token).alias("value"))
    out = text.read_active_rates(spark, _text(lines, spark, "active"))
    return out.groupBy("gen", "pair").agg(F.count(F.lit(1)).alias("n"))


# --- sinks -------------------------------------------------------------------


@query("write_patterns", f"WITH {PATS} SELECT locus, col AS code, pattern_id, weight FROM pats")
def write_patterns(spark, sf):
    path = scratch(spark, "patterns") + "/p"
    sinks.write_patterns(patterns(spark, sf), path)
    return spark.read.parquet(path).select("locus", F.col("column").alias("code"), "pattern_id", "weight")


@query("pattern_text", f"WITH {PATS} SELECT locus, '4 ' || count(*) || ' P' AS header, CAST(sum(weight) AS BIGINT) AS sites FROM pats GROUP BY 1")
def pattern_text(spark, sf):
    out = sinks.pattern_text(patterns(spark, sf), A.sequences(spark, sf))
    weights = F.split(F.element_at(F.split("text", "\n"), -1), " ")
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return out.select("locus", F.substring_index("text", "\n", 1).alias("header"), total.alias("sites"))


@query("write_trace", f"WITH {TRACE} SELECT param, gen, value FROM trace")
def write_trace(spark, sf):
    path = scratch(spark, "sink") + "/t"
    sinks.write_trace(A.trace(spark, sf), path, _PARAMS)
    wide = spark.read.schema("Gen long, " + ", ".join(f"{p} double" for p in _PARAMS)).csv(f"{path}/chain=c1", sep="\t", header=True, nullValue="-")
    long = wide.unpivot(["Gen"], _PARAMS, "param", "value").filter("value is not null")
    return long.select("param", F.col("Gen").alias("gen"), "value")


@query("write_summary", f"WITH {TRACE} SELECT chain, param, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM trace GROUP BY 1, 2")
def write_summary(spark, sf):
    path = scratch(spark, "summary") + "/t"
    sinks.write_summary(T.trace_moments(A.trace(spark, sf)), path)
    return spark.read.parquet(path).select("chain", "param", "n", r("mean"), "min", "max")


# --- streams -----------------------------------------------------------------


def _replay(df, spark, name, files=10):
    path = scratch(spark, name) + "/in"
    df.repartitionByRange(files, "gen").write.parquet(path)
    return path


@query("stream_trace", f"WITH {TRACE} SELECT chain, param, gen, value FROM trace")
def stream_trace(spark, sf):
    source = _replay(A.trace(spark, sf), spark, "stream")
    out = scratch(spark, "stream") + "/s"
    monitor.stream_resume(monitor.stream_trace(spark, source, files_per_trigger=4), out + "/ck", out + "/data").awaitTermination()
    return monitor.durable_samples(spark, out + "/data").select("chain", "param", "gen", "value")


@query("stream_running_mean", f"WITH {TRACE} SELECT chain, param, count(*) AS n, round(avg(value), 6) AS rmean FROM trace GROUP BY 1, 2")
def stream_running_mean(spark, sf):
    source = _replay(A.trace(spark, sf), spark, "mean")
    out = scratch(spark, "mean") + "/s"
    means = monitor.stream_running_mean(monitor.stream_trace(spark, source, files_per_trigger=4))
    publish = lambda df, batch: df.write.mode("overwrite").parquet(out + "/current")
    (
        means.writeStream.outputMode("complete").option("checkpointLocation", out + "/ck")
        .foreachBatch(publish).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out + "/current").select("chain", "param", "n", r("rmean"))


def _followed_trees(spark, sf, name):
    """Both tables of a followed tree sample, after several batches."""
    source = _replay(A.tree_sample(spark, sf), spark, name)
    out = scratch(spark, name) + "/s"
    trees = monitor.stream_trace(spark, source, monitor.TREE_SCHEMA, files_per_trigger=4)
    monitor.stream_topology_posterior(trees, out + "/ck", out + "/data", available_now=True).awaitTermination()
    return monitor.topology_state(spark, out + "/data")


@query("stream_topology_posterior", f"WITH {SAMPLE} SELECT topology, n FROM tp")
def stream_topology_posterior(spark, sf):
    return _followed_trees(spark, sf, "topologies")[0]


@query("stream_clade_posterior", f"WITH {SAMPLE} SELECT clade, n FROM cp")
def stream_clade_posterior(spark, sf):
    return _followed_trees(spark, sf, "clades")[1].select(F.array_join("clade", ",").alias("clade"), "n")


@query("stream_resume", f"WITH {TRACE} SELECT chain, param, gen, value FROM trace")
def stream_resume(spark, sf):
    """A run that goes back a little each time; its samples are compacted while it is followed."""
    trace = A.trace(spark, sf)
    middle = trace.agg((F.max("gen") / 2).alias("m"))
    marked = trace.crossJoin(F.broadcast(middle))
    out = scratch(spark, "resume")
    for part in ("gen <= m", "gen > m - 50"):
        marked.filter(part).drop("m").repartitionByRange(4, "gen").write.mode("append").parquet(out + "/in")
        stream = monitor.stream_trace(spark, out + "/in")
        monitor.stream_resume(stream, out + "/ck", out + "/data").awaitTermination()
        monitor.compact(spark, out + "/data")
    return monitor.durable_samples(spark, out + "/data").select("chain", "param", "gen", "value")
