"""Domain tables derived from the given star-schema tables.

Every adapter uses all rows and whole texts, with integer and string
expressions that a second SQL engine can repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions.blocks import running_totals

#: sequences per locus in the derived alignments
SEQUENCES = 4
#: text characters and the alignment character each one stands for
LETTERS = "abcdefghijklmnoprstuvwxyABCDEFGHIJKLMNOPRSTUVWXY éèêç.,qQzZ~"
BASES = "ACGT" * ((len(LETTERS) - 5) // 4) + "ACGT"[: (len(LETTERS) - 5) % 4] + "YYNN-"
#: per sequence: one match per four characters, keeping the sequence's own
#: character when it is in a class and the first sequence's otherwise
DEALS = (
    ("(?s)(.)...", 1),
    ("(?s)(?:.([aeiou])|(.)[^aeiou])..", 2),
    ("(?s)(?:..([nrst])|(.).[^nrst]).", 2),
    ("(?s)(?:...([ eE])|(.)..[^ eE])", 2),
)


#: the characters that DEALS lets a sequence keep, and the alignment character of every code below 256 (the last: of others)
OWN = ("", "aeiou", "nrst", " eE")
_BASE = np.full(256, ord("N"), np.uint8)
_BASE[[*map(ord, LETTERS + "-")]] = [*map(ord, BASES + "-")]
_OWN = [np.isin(np.arange(256), [*map(ord, own)]) for own in OWN]


def _dealt(text: str | None) -> list[str | None]:
    """The sequences of a text: ``DEALS`` and ``BASES`` on arrays of its codes."""
    if text is None:
        return [None] * SEQUENCES
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
    dealt = np.append(codes, np.full(-len(codes) % SEQUENCES, ord("~"), np.uint8)).reshape(-1, SEQUENCES).T
    return [_BASE[np.where(keep[own], own, dealt[0]) if i else own].tobytes().decode() for i, (keep, own) in enumerate(zip(_OWN, dealt))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One locus per document: the whole text dealt to four sequences.

    Characters 4i..4i+3 of the text give site i.  Sequence 0 takes the first;
    the others take their own character when it is in their class and copy
    sequence 0 otherwise, so columns are correlated.  The text is padded to a
    multiple of four with gaps.
    """
    docs = table(spark, sf_dir, "documents")
    dealt = docs.select(F.col("doc_id").alias("locus"), "source", F.udf(_dealt, "array<string>", useArrow=False)("text").alias("dealt"))
    each = dealt.repartition("locus").withColumn("seq_idx", F.explode(F.array(*map(F.lit, range(SEQUENCES)))))
    label = F.concat(F.lit("d"), "locus", F.lit("^"), "source", F.lit("."), "seq_idx")
    return each.select("locus", "source", "seq_idx", label.alias("label"), F.get("dealt", "seq_idx").alias("sequence"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One protein locus per document: the quarters of the text are four sequences; what is no amino acid is a gap."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")).alias("text"))
    quarter = F.ceil(F.length("text") / SEQUENCES).cast("int")
    rows = docs.select(
        F.col("doc_id").alias("locus"), quarter.alias("n"),
        F.rpad(F.translate("text", "JOUX", "----"), quarter * SEQUENCES, "-").alias("text"), F.explode(F.array(*map(F.lit, range(SEQUENCES)))).alias("seq_idx"),
    )
    return rows.select("locus", "seq_idx", F.substring("text", F.col("seq_idx") * F.col("n") + 1, F.col("n")).alias("sequence"))


def imap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individuals are source.sequence; sequences 0,1 are species A, 2 is B, 3 is C."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select(
        F.col("source"), F.explode(F.sequence(F.lit(0), F.lit(SEQUENCES - 1))).alias("i")
    ).select(
        F.concat("source", F.lit("."), "i").alias("individual"),
        F.when(F.col("i") < 2, "A").when(F.col("i") == 2, "B").otherwise("C").alias("species"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 50 loci with five DNA models in turn."""
    docs = table(spark, sf_dir, "documents")
    models = F.array(*[F.lit(m) for m in ("JC69", "K80", "HKY", "GTR", "TN93")])
    return (
        docs.groupBy(F.floor(F.col("doc_id") / 50).alias("b"))
        .agg(F.min("doc_id").alias("start"), F.max("doc_id").alias("end"))
        .select("start", "end", F.lit("DNA").alias("dtype"), F.get(models, (F.col("b") % 5).cast("int")).alias("model"))
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter per event type, iterations numbered by time."""
    ev = table(spark, sf_dir, "events")
    numbered = running_totals(
        ev, ["event_type"], ["ts", "event_id"], F.to_date("ts"), {"gen": F.lit(1)}
    )
    return numbered.select(F.lit("c1").alias("chain"), "gen", F.col("event_type").alias("param"), "value")


def two_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with one chain per user parity, iterations numbered in each."""
    ev = table(spark, sf_dir, "events").withColumn(
        "chain", F.when(F.col("user_id") % 2 == 0, "c1").otherwise("c2")
    )
    numbered = running_totals(
        ev, ["chain", "event_type"], ["ts", "event_id"], F.to_date("ts"), {"gen": F.lit(1)}
    )
    return numbered.select("chain", "gen", F.col("event_type").alias("param"), "value")


def _u(key: str):
    return (F.col(key) * 7919) % 1000


def tree_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four topologies in fixed shares; children swapped for odd keys."""
    u, odd = _u("o_orderkey"), F.col("o_orderkey") % 2 == 1
    return table(spark, sf_dir, "orders").select(
        F.lit("c1").alias("chain"),
        F.col("o_orderkey").alias("gen"),
        F.when(u < 550, F.when(odd, "(D,(C,(A,B)));").otherwise("(((A,B),C),D);"))
        .when(u < 750, F.when(odd, "(D,(B,(A,C)));").otherwise("(((A,C),B),D);"))
        .when(u < 900, F.when(odd, "((C,D),(B,A));").otherwise("((A,B),(C,D));"))
        .otherwise(F.when(odd, "(D,(A,(B,C)));").otherwise("(((B,C),A),D);"))
        .alias("newick"),
    )


def timed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species trees with ages from the order price; some inner ages are zero.

    x, y, z are the ages of the two inner nodes and the root in 1/1000 units.
    """
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, 0).otherwise(k % 7 + 1)
    y = x + F.when(k % 5 == 0, 0).otherwise(k % 11 + 1)
    z = y + k % 13 + 1
    num = lambda c: (c / 1000.0).cast("decimal(12,3)").cast("string")
    names = F.when(_u("o_orderkey") < 700, F.array(*map(F.lit, "ABCD"))).otherwise(F.array(*map(F.lit, "BCAD")))
    n = lambda i: F.get(names, F.lit(i))
    return table(spark, sf_dir, "orders").select(
        F.lit("c1").alias("chain"),
        k.alias("gen"),
        F.concat(
            F.lit("((("), n(0), F.lit(":"), num(x), F.lit(","), n(1), F.lit(":"), num(x), F.lit("):"), num(y - x),
            F.lit(","), n(2), F.lit(":"), num(y), F.lit("):"), num(z - y), F.lit(","), n(3), F.lit(":"), num(z), F.lit(");"),
        ).alias("newick"),
        (F.lit(2) + (x > 0).cast("int") + (y > 0).cast("int")).alias("n_species"),
    )


def delim_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-node guide tree; a collapsed parent collapses its child."""
    u = _u("o_orderkey")
    a = (u % 10 < 8).cast("int")
    b = a * (F.floor(u / 10) % 10 < 6).cast("int")
    c = b * (F.floor(u / 100) % 10 < 5).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.lit("c1").alias("chain"),
        F.col("o_orderkey").alias("gen"),
        (a + b + c).alias("np"),
        F.concat(a.cast("string"), b.cast("string"), c.cast("string")).alias("model"),
    )


def coalescent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene-tree events: one locus per supplier, one sample per order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("gen"),
        (F.col("l_orderkey") % 40).alias("locus"),
        F.col("l_returnflag").alias("pop"),
        (F.col("l_extendedprice") / 1e6).alias("time"),
        F.lit("COAL").alias("kind"),
        F.lit(-1).alias("delta_n"),
    )


def migcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (
        j.select(
            (F.col("o_orderkey") % 40).alias("locus"),
            (F.col("c_nationkey") % 4).cast("long").alias("source"),
            ((F.col("c_nationkey") + F.col("o_orderkey")) % 4).alias("target"),
            (F.floor(F.col("o_orderkey") / 40) % 25).alias("gen"),
        )
        .filter("source <> target")
        .groupBy("gen", "locus", "source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def conditionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a1, b1) per line item; iterations numbered by order and line in each flag."""
    li = table(spark, sf_dir, "lineitem")
    numbered = running_totals(
        li.withColumn("b1", F.col("l_extendedprice") / 1e4),
        ["l_returnflag"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b1"],
        F.floor(F.col("l_orderkey") / 4096),
        {"gen": F.lit(1)},
    )
    return numbered.select(
        F.lit("c1").alias("chain"),
        "gen",
        F.col("l_returnflag").alias("param"),
        (3 + F.col("l_quantity")).alias("a1"),
        "b1",
    )


def power_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 8).cast("int").alias("beta_idx"),
        F.col("o_orderkey").alias("gen"),
        (-F.col("o_totalprice") / 1000).alias("lnl"),
    )


def beta_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quadrature points weighted by their share of the orders."""
    o = power_posterior(spark, sf_dir).groupBy("beta_idx").agg(F.count(F.lit(1)).alias("c"))
    total = o.agg(F.sum("c").alias("t"))
    return o.crossJoin(F.broadcast(total)).select(
        "beta_idx", ((F.col("beta_idx") + 0.5) / 8).alias("beta"), (2.0 * F.col("c") / F.col("t")).alias("weight")
    )
