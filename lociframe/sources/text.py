"""Readers for the text formats of alignments, samples and side tables.

Every format is read as lines, so files are split like any text input.  Where
the position of a line matters (headers, iterations, loci) lines are numbered
per file split and the splits' counts are accumulated; no file has to pass
through one task.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions.blocks import attach_group_row, running_totals

Paths = str | list[str]


def _lines(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.text(paths).withColumn("value", F.trim(F.regexp_replace("value", r"\r$", "")))


def _content(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines without blank, ``*`` and ``#`` ones."""
    return _lines(spark, paths).filter(~F.col("value").rlike(r"^\s*([*#].*)?$"))


def _checked(value: Column, ok: Column, message: str, line: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), line)).cast("string"))


def _numbered_lines(spark: SparkSession, paths: Paths, **counters: Column) -> DataFrame:
    """(file, line_no, line) with 0-based line numbers, and running counters.

    A counter is the number of lines of the file, up to and with this one, for
    which the given flag over ``line`` holds.  Ids only order the lines of one
    split, where they follow the text.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    totals = {"line_no": F.lit(1), **{name: flag.cast("long") for name, flag in counters.items()}}
    numbered = running_totals(rows, ["file"], ["_id"], F.col("_start"), totals)
    return numbered.withColumn("line_no", F.col("line_no") - 1).drop("_start", "_id")


_LABEL = re.compile(r"\s*([^ \t]+)", re.ASCII)
_NO_CHARACTER = re.compile(r"[^A-Za-z0-9?.\-]|[jo]")


def _records(body: list[str], n: int, length: int, interleaved: bool) -> list[tuple[str, str]]:
    """The label and sequence of each record of a locus; every line is looked at once."""
    labels: list[str] = []
    pieces: list[list[str]] = []
    shortest: list[tuple[int, int]] = []  # heap of (characters, record); a sequential locus has its last record only
    for line in body:
        # records of an interleaved locus are equally long within a block, so the first of the shortest is next
        full = not shortest or shortest[0][0] >= length
        if len(labels) < n and (interleaved or full):
            found = _LABEL.match(line)
            labels.append(found[1])
            at, size, line = len(pieces), 0, line[found.end() :]
            pieces.append([])
            if not interleaved:
                shortest.clear()
        elif full:
            break
        else:
            size, at = heappop(shortest)
        pieces[at].append(_NO_CHARACTER.sub("", line))
        heappush(shortest, (size + len(pieces[at][-1]), at))
    return [*zip(labels, map("".join, pieces))]


def read_alignments(spark: SparkSession, paths: Paths, max_loci: int | None = None, interleaved: bool = False) -> DataFrame:
    """(file, locus, seq_idx, label, sequence) from sequential or interleaved files.

    A file holds loci one after another, each with a header ``count length``.
    Headers are counted along the file to number the loci, and each locus is
    folded line by line.  A sequential record starts with its label and
    continues until ``length`` characters are read; an interleaved locus
    repeats its sequences in order, block by block.  Text after a complete last
    locus is ignored.
    """
    head = r"^\s*(\d+)\s+(\d+)\s*[A-Za-z]?\s*$"
    is_head = F.col("line").rlike(head)
    lines = _numbered_lines(spark, paths, locus=is_head).filter(~F.col("line").rlike(r"^\s*([*#].*)?$"))
    marked = lines.withColumn("header", is_head)
    if max_loci is not None:
        marked = marked.filter(F.col("locus") <= max_loci)
    early = F.raise_error(F.concat(F.lit("text before the first header: "), F.col("line"))).cast("string")
    control = F.raise_error(F.concat(F.lit("control character in locus "), F.col("locus").cast("string"))).cast("string")
    marked = marked.withColumn(
        "line", F.when(F.col("locus") == 0, early).when(F.col("line").rlike(r"[\x00-\x08\x0E-\x1F\x7F]"), control).otherwise(F.col("line"))
    )
    shape = lambda i: F.max(F.when(F.col("header"), F.regexp_extract("line", head, i).cast("int")))
    body = F.sort_array(F.collect_list(F.when(~F.col("header"), F.struct("line_no", "line"))))
    loci = marked.groupBy("file", "locus").agg(
        shape(1).alias("n_seq"), shape(2).alias("length"), F.transform(body, lambda x: x["line"]).alias("body")
    )
    n, length = F.col("n_seq"), F.col("length")
    record = "array<struct<label:string,sequence:string>>"
    parsed = loci.withColumn("parsed", F.udf(_records, record, useArrow=False)("body", n, length, F.lit(interleaved)))
    wrong = F.raise_error(F.concat(F.lit("too few sequences in locus "), F.col("locus").cast("string"))).cast(record)
    rows = parsed.withColumn("parsed", F.when(F.size("parsed") == n, F.col("parsed")).otherwise(wrong)).select(
        "file", "locus", "length", F.posexplode("parsed").alias("seq_idx", "r")
    )
    good = (F.length("r.sequence") == length) & ~F.col("r.sequence").contains(".")
    return rows.select(
        "file", "locus", "seq_idx", F.col("r.label").alias("label"),
        _checked(F.col("r.sequence"), good, "wrong length or illegal character", F.col("r.label")).alias("sequence"),
    )


def number_loci(alignments: DataFrame) -> DataFrame:
    """Make ``locus`` unique over files: offsets from the loci per file."""
    per_file = alignments.groupBy("file").agg(F.max("locus").alias("_n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = per_file.select("file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    joined = attach_group_row(alignments, offsets, ["file"], ["label", "locus"])
    return joined.withColumn("locus", F.col("locus") + F.col("_off")).drop("_off", "file")


def _pairs(spark: SparkSession, paths: Paths, first: str, second: str) -> DataFrame:
    pattern = r"^\s*(\S+)\s+(\S+)\s*$"
    rows = _content(spark, paths)
    ok = F.col("value").rlike(pattern)
    one = _checked(F.regexp_extract("value", pattern, 1), ok, "expected two columns", F.col("value"))
    return rows.select(one.alias(first), F.regexp_extract("value", pattern, 2).alias(second))


def read_imap(spark: SparkSession, path: Paths) -> DataFrame:
    """(individual, species); an individual listed twice is an error."""
    pairs = _pairs(spark, path, "individual", "species")
    counted = pairs.groupBy("individual").agg(F.count(F.lit(1)).alias("k"), F.first("species").alias("species"))
    return counted.select(
        _checked(F.col("individual"), F.col("k") == 1, "duplicate individual", F.col("individual")).alias("individual"), "species"
    )


def read_dates(spark: SparkSession, path: Paths) -> DataFrame:
    """(label, age); the age must be a number."""
    pairs = _pairs(spark, path, "label", "age")
    age = F.expr("try_cast(age as double)")
    bad = F.raise_error(F.concat(F.lit("bad age of "), F.col("label"))).cast("double")
    return pairs.select("label", F.when(age.isNotNull(), age).otherwise(bad).alias("age"))


def split_trace_lines(lines: DataFrame) -> DataFrame:
    """(chain, line_no, fields, header_fields) from ``lines(chain, line_no, line)``."""
    headers = lines.filter("line_no = 0").select("chain", F.split("line", "\t").alias("header"))
    rows = lines.filter("line_no > 0 and line <> ''")
    return attach_group_row(rows, headers, ["chain"], ["line_no"]).withColumn("fields", F.split("line", "\t"))


def repair_trace_rows(lines: DataFrame, fixed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose fields under the header are all there and numbers, and the others.

    Fields beyond the header's are ignored.  A dash stands for a missing value, as the sink of this library writes it.

    ``lines(chain, line_no, line)``, header at line 0.  A bad first row or two
    bad rows in a row fail the job.  Each bad row is compared with the one
    before it by a join on the line number, not by ordering the whole file.
    """
    split = split_trace_lines(lines)
    width = F.lit(fixed) if fixed is not None else F.size("header")
    numbers = F.forall(F.slice("fields", F.lit(1), width), lambda x: (x == "-") | x.try_cast("double").isNotNull())
    marked = split.withColumn("bad", (F.size("fields") < width) | ~numbers)
    broken = marked.filter("bad").select("chain", "line_no", "line")
    previous = broken.select("chain", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("_twice"))
    fatal = (F.col("line_no") == 1) | F.coalesce("_twice", F.lit(False))
    checked = broken.join(previous, ["chain", "line_no"], "left").select(
        "chain",
        _checked(F.col("line_no").cast("string"), ~fatal, "first or consecutive bad rows", F.col("line")).cast("long").alias("line_no"),
        "line",
    )
    good = marked.filter("not bad").join(checked.select("chain", "line_no"), ["chain", "line_no"], "left_anti")
    return good.select("chain", "line_no", "header", "fields"), checked


def _long(good: DataFrame) -> DataFrame:
    cells = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size("header") - 1),
            lambda i: F.struct(F.get(F.col("header"), i).alias("param"), F.get(F.col("fields"), i).alias("text")),
        )
    )
    return good.select("chain", F.get(F.col("fields"), F.lit(0)).cast("long").alias("gen"), cells.alias("c")).select(
        "chain", "gen", "c.param", "c.text"
    )


def read_trace(spark: SparkSession, paths: Paths, repair: bool = True) -> DataFrame:
    """(chain, gen, param, value) of tab-separated logs with a ``Gen`` header.

    One file is one chain, named by its path.  Columns may differ between files.
    """
    lines = _numbered_lines(spark, paths).withColumnRenamed("file", "chain")
    good = repair_trace_rows(lines)[0] if repair else split_trace_lines(lines)
    return _long(good).withColumn("value", F.expr("try_cast(nullif(text, '-') as double)")).drop("text")


def read_wide_trace(spark: SparkSession, paths: Paths, columns: list[str]) -> DataFrame:
    """Large logs of one known column set: splittable CSV, unpivoted.

    ``columns`` names the columns after ``Gen``; every file carries the header.
    """
    schema = ", ".join(["Gen long", *[f"`{c}` double" for c in columns]])
    wide = spark.read.schema(schema).csv(paths, sep="\t", header=True, nullValue="-")
    wide = wide.withColumn("chain", F.col("_metadata.file_path"))
    return wide.unpivot(["chain", "Gen"], columns, "param", "value").withColumnRenamed("Gen", "gen")


def read_active_rates(spark: SparkSession, paths: Paths) -> DataFrame:
    """(chain, gen, pair, rate) from the ragged ``W_a->b=v`` tokens of a log."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("chain"), "value").filter(~F.col("value").startswith("Gen"))
    tokens = F.expr(r"regexp_extract_all(value, r'W_[^\s=]+=[^\s]+', 0)")
    return rows.select(
        "chain", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("gen"), F.explode_outer(tokens).alias("t")
    ).select(
        "chain",
        "gen",
        F.when(F.col("t").isNotNull(), F.regexp_extract("t", r"^W_([^=]+)=", 1)).alias("pair"),
        F.regexp_extract("t", r"=(.+)$", 1).try_cast("double").alias("rate"),
    )


def read_conditionals(spark: SparkSession, paths: Paths) -> DataFrame:
    """(chain, gen, param, a1, b1) from column pairs ``_a1`` / ``_b1``; ``-`` is NULL."""
    cells = read_trace(spark, paths)
    named = cells.withColumn("name", F.regexp_replace("param", r"_[ab]1$", ""))
    part = lambda suffix: F.max(F.when(F.col("param").endswith(suffix), F.col("value")))
    return named.filter(F.col("param").rlike(r"_[ab]1$")).groupBy("chain", "gen", F.col("name").alias("param")).agg(
        part("_a1").alias("a1"), part("_b1").alias("b1")
    )


def read_tree_sample(spark: SparkSession, paths: Paths) -> DataFrame:
    """(chain, gen, newick, n_species): one tree per line, in file order."""
    lines = _numbered_lines(spark, paths).withColumnRenamed("file", "chain").filter(F.col("line").contains("("))
    pattern = r"^\s*(.*;)\s*(\d+)?\s*$"
    return lines.select(
        "chain",
        (F.col("line_no") + 1).alias("gen"),
        F.regexp_extract("line", pattern, 1).alias("newick"),
        F.expr(r"try_cast(nullif(regexp_extract(line, r'^\s*(.*;)\s*(\d+)?\s*$', 2), '') as int)").alias("n_species"),
    )


def read_delim_sample(spark: SparkSession, paths: Paths) -> DataFrame:
    """(chain, gen, np, model): the first three fields of every sample."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("chain"), F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.filter(F.col("f")[0].rlike(r"^\d+$")).select(
        "chain", F.col("f")[0].cast("long").alias("gen"), F.col("f")[1].cast("int").alias("np"), F.col("f")[2].alias("model")
    )


def read_gene_trees(spark: SparkSession, paths: Paths, locus_pattern: str = r"L(\d+)") -> DataFrame:
    """(locus, gen, newick, th, tl): one file per locus, ``newick [TH=, TL=]``."""
    lines = _numbered_locus_lines(spark, paths, locus_pattern)
    number = lambda key: F.expr(f"try_cast(nullif(regexp_extract(line, r'{key}\\s*=\\s*([-+0-9.eE]+)', 1), '') as double)")
    return lines.filter(F.col("line").contains("(")).select(
        "locus",
        (F.col("line_no") + 1).alias("gen"),
        F.regexp_extract("line", r"^\s*([^;]*;)", 1).alias("newick"),
        number("TH").alias("th"),
        number("TL").alias("tl"),
    )


def _numbered_locus_lines(spark: SparkSession, paths: Paths, locus_pattern: str) -> DataFrame:
    locus = F.regexp_extract("file", locus_pattern + r"[^/]*(?:/[^/]*)?$", 1).cast("long")
    return _numbered_lines(spark, paths).filter("line <> ''").select(locus.alias("locus"), "line_no", "line")


def read_migration_history(spark: SparkSession, paths: Paths, locus_pattern: str = r"L(\d+)") -> DataFrame:
    """(locus, gen, branch, node_pop, event, time, source, target).

    A line holds the branches, each ``pop:`` and then events ``time*target&source``, parted by ``$``, closed by ``;``.
    Events are numbered from 0 along the branch; a branch without any has one row of NULLs.  Directions are backward in time: the
    lineage leaves ``source``.  Where it passes into the parent population, that is an event too, with the parent as
    ``target``; see :func:`mark_crossings`.
    """
    lines = _numbered_locus_lines(spark, paths, locus_pattern)
    branches = lines.select("locus", (F.col("line_no") + 1).alias("gen"), F.posexplode(F.split("line", ";")).alias("branch", "b")).filter(
        F.trim("b") != ""
    )
    events = F.filter(F.split(F.substring_index("b", ":", -1), r"\$"), lambda e: F.trim(e) != "")
    each = branches.select(
        "locus", "gen", "branch", F.trim(F.substring_index("b", ":", 1)).alias("node_pop"), F.posexplode_outer(events).alias("event", "e")
    )
    form = r"^\s*([^*]+)\*([^&]+)&(.+?)\s*$"
    wrong = F.raise_error(F.concat(F.lit("no migration event: "), F.col("e"))).cast("string")
    checked = each.withColumn("e", F.when(F.col("e").isNull() | F.col("e").rlike(form), F.col("e")).otherwise(wrong))
    field = lambda i: F.when(F.col("e").isNotNull(), F.regexp_extract("e", form, i))
    return checked.select(
        "locus", "gen", "branch", "node_pop", "event",
        field(1).cast("double").alias("time"), field(3).alias("source"), field(2).alias("target"),
    )


def mark_crossings(history: DataFrame, parents: DataFrame) -> DataFrame:
    """Add ``crossing``: the event only passes from a population into its parent (``parents``: label, parent)."""
    up = parents.select(F.col("label").alias("source"), F.col("parent").alias("_parent"))
    marked = history.join(up, "source", "left").withColumn("crossing", F.coalesce(F.col("target") == F.col("_parent"), F.lit(False)))
    return marked.select(*history.columns, "crossing")


def _locus_table(spark: SparkSession, paths: Paths, locus_pattern: str) -> DataFrame:
    """(locus, gen, param, value) of per-locus tables whose columns may differ."""
    lines = _numbered_locus_lines(spark, paths, locus_pattern)
    fields = F.split(F.trim("line"), r"\s+")
    headers = lines.filter("line_no = 0").select("locus", fields.alias("header"))
    rows = lines.filter("line_no > 0").select("locus", "line_no", fields.alias("fields"))
    joined = attach_group_row(rows, headers, ["locus"], ["line_no"])
    return joined.select("locus", F.col("line_no").cast("long").alias("gen"), F.explode(F.arrays_zip("header", "fields")).alias("c")).select(
        "locus", "gen", F.col("c.header").alias("param"), F.col("c.fields").try_cast("double").alias("value")
    )


def read_migcounts(spark: SparkSession, paths: Paths, locus_pattern: str = r"L(\d+)") -> DataFrame:
    """(gen, locus, source, target, n) from tables headed ``W_source->target``."""
    return _locus_table(spark, paths, locus_pattern).select(
        "gen", "locus",
        F.regexp_extract("param", r"^W_(.+?)->", 1).alias("source"),
        F.regexp_extract("param", r"->(.+)$", 1).alias("target"),
        F.col("value").cast("long").alias("n"),
    )


def read_locus_rates(spark: SparkSession, paths: Paths, locus_pattern: str = r"L(\d+)") -> DataFrame:
    """(locus, gen, param, value); each file brings its own columns."""
    return _locus_table(spark, paths, locus_pattern)


def read_partitions(spark: SparkSession, path: Paths) -> DataFrame:
    """(start, end, dtype, model) from lines ``start[-end], DNA|AA, MODEL``."""
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*,\s*(DNA|AA)\s*,\s*([A-Za-z0-9+]+)\s*$"
    rows = _content(spark, path)
    start = _checked(F.regexp_extract("value", pattern, 1), F.col("value").rlike(pattern), "bad partition", F.col("value"))
    end = F.nullif(F.regexp_extract("value", pattern, 2), F.lit(""))
    return rows.select(
        start.cast("long").alias("start"),
        F.coalesce(end, start).cast("long").alias("end"),
        F.regexp_extract("value", pattern, 3).alias("dtype"),
        F.upper(F.regexp_extract("value", pattern, 4)).alias("model"),
    )


def read_traits(spark: SparkSession, paths: Paths) -> DataFrame:
    """(partition, dtype, label, char_idx, value, state_mask, v_pop, ldet).

    A block starts with ``rows columns type [v_pop ldet]``, type C (continuous)
    or D (discrete), followed by one line per species.  Discrete values are
    digits, ``{..}`` / ``(..)`` sets, or ``?`` / ``-`` for unknown.
    """
    head = r"^\s*(\d+)\s+(\d+)\s+([CcDd])\w*(?:\s+(\S+)\s+(\S+))?\s*$"
    is_head = F.col("line").rlike(head)
    lines = _numbered_lines(spark, paths, partition=is_head).filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    field = lambda i: F.regexp_extract("line", head, i)
    heads = lines.filter(is_head).select(
        "file", "partition", F.upper(field(3)).alias("dtype"), field(2).cast("int").alias("columns"),
        field(4).try_cast("double").alias("v_pop"), field(5).try_cast("double").alias("ldet"),
    )
    rows = attach_group_row(lines.filter(~is_head), heads, ["file", "partition"], ["line_no"])
    text = F.trim(F.regexp_replace("line", r"^\s*\S+", ""))
    tokens = F.when(F.col("dtype") == "C", F.split(text, r"\s+")).otherwise(
        F.expr(r"regexp_extract_all(regexp_replace(line, '^\\s*\\S+', ''), r'[{(][^)}]*[)}]|[0-9?-]', 0)")
    )
    tokens = F.when(F.size(tokens) == F.col("columns"), tokens).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of trait values: "), F.col("line"))).cast("array<string>")
    )
    cells = rows.select(
        "partition", "dtype", "v_pop", "ldet", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("label"), F.posexplode(tokens).alias("char_idx", "tok")
    )
    digits = F.expr(r"regexp_extract_all(tok, r'[0-9]', 0)")
    mask = F.aggregate(digits, F.lit(0), lambda m, d: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), d.cast("int"))))
    discrete = F.col("dtype") == "D"
    return cells.select(
        "partition", "dtype", "label", "char_idx",
        F.when(~discrete, F.col("tok").try_cast("double")).alias("value"),
        F.when(discrete, F.when(F.col("tok").rlike(r"^[?-]$"), F.lit(1023)).otherwise(mask)).alias("state_mask"),
        "v_pop", "ldet",
    )


def read_beta_weights(spark: SparkSession, path: Paths) -> DataFrame:
    """(beta_idx, beta, weight) in file order from ``beta,weight,ElnfX``."""
    lines = _numbered_lines(spark, path).filter("line <> '' and line_no > 0")
    f = F.split("line", ",")
    return lines.select(
        (F.col("line_no") - 1).alias("beta_idx"), f[0].cast("double").alias("beta"), f[1].cast("double").alias("weight")
    )


def read_protein_models(spark: SparkSession, paths: Paths) -> DataFrame:
    """(model_id, rates, freqs) from files of published protein models, one model a file.

    A file starts with the lower triangle of 190 exchange rates, row by row, and 20 frequencies, in the order of
    ``states.AMINO_ACID_ORDER``; what follows is comment.  ``rates`` is the upper triangle row by row, as
    ``transition_probs_general`` takes it, and ``freqs`` adds up to 1.  The model is named after its file, without the
    ending.  A file with fewer numbers, or with others than numbers before them, fails the job.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    numbers = F.transform(F.slice(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), 1, 210), lambda x: x.try_cast("double"))
    bad = F.raise_error(F.concat(F.lit("not 190 rates and 20 frequencies: "), F.col("file"))).cast("array<double>")
    good = (F.size("x") == 210) & F.forall("x", lambda x: x.isNotNull() & (x >= 0)) & F.exists(F.slice("x", 191, 20), lambda x: x > 0)
    rows = files.withColumn("x", numbers).withColumn("x", F.when(good, F.col("x")).otherwise(bad))
    upper = F.array(*[F.lit(j * (j - 1) // 2 + i) for i in range(20) for j in range(i + 1, 20)])
    total = F.aggregate(F.slice("x", 191, 20), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("_total", total).select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("model_id"),
        F.transform(upper, lambda i: F.get("x", i)).alias("rates"),
        F.transform(F.slice("x", 191, 20), lambda x: x / F.col("_total")).alias("freqs"),
    )
