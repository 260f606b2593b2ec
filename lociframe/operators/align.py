"""Alignment cleaning, compression and per-locus statistics.

The working table is ``columns(locus, site, column)``: one string per aligned
site, holding one character per sequence in ``seq_idx`` order.  Long sequences
are cut into chunks before they are grouped by locus, so a locus with very many
sites spreads over many tasks, and sequences travel as strings rather than as
one row per character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lociframe.functions import states

#: sites per chunk when alignments are turned from rows into columns
CHUNK = 256
#: sites whose patterns are compared by one task
SITES_A_RUN = 1 << 17
#: sites of a locus whose columns are made and compressed by one task
SITES_A_TASK = 1 << 15


def _transposed(pieces: list[str]) -> str:
    """The columns of a chunk, one a line; a sequence that ends earlier is left out after its end."""
    equal = len({*map(len, pieces)}) == 1
    return "\n".join(map("".join, zip(*pieces) if equal else zip_longest(*pieces, fillvalue="")))


def site_columns(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(locus, site, column) with 0-based sites.  The table knows its pieces, for :func:`compress_patterns`."""
    cut = sequences.select("locus", "seq_idx", F.expr(f"regexp_extract_all(sequence, '.{{1,{chunk}}}', 0)").alias("pieces"))
    # outer: the filter for other generators would cut the sequences once more
    counted = cut.select("locus", "seq_idx", F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("chunk", "piece"))
    pieces = counted.filter("piece IS NOT NULL")
    rows = pieces.groupBy("locus", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq_idx", "piece"))).alias("rows"))
    # no piece holds a line feed; batches of Arrow would be by rows, and a row holds a chunk of every sequence
    lines = F.udf(_transposed, StringType(), useArrow=False)(F.transform("rows", lambda r: r["piece"]))
    columns = rows.select("locus", "chunk", F.posexplode(F.split(lines, "\n")).alias("i", "column")).select(
        "locus", (F.col("chunk").cast("long") * chunk + F.col("i")).alias("site"), "column"
    )
    columns._pieces = pieces, chunk
    return columns


def _run_patterns(pieces: DataFrame, chunk: int, dtype: str) -> tuple[DataFrame, DataFrame]:
    """(locus, column, pattern_id, weight): the patterns of each run of ``SITES_A_TASK`` sites, of the loci of one run and
    of the others.

    The pieces of a run meet in one task in the order of chunks and sequences and become columns a chunk at a time, so
    no column is shuffled, and a task holds the columns of one run.
    """
    most = max(1, SITES_A_TASK // chunk)
    dealt = pieces.withColumn("run", F.floor(F.col("chunk") / most)).repartition("locus", "run")
    order = ["chunk", "seq_idx", "piece"]
    whole = Window.partitionBy("locus", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the sequence of most pieces has one in every chunk of its locus
    ordered = dealt.withColumn("long", F.max("n").over(whole) > most).sortWithinPartitions("locus", "run", *order)
    coded = states.encode_text(F.col("piece"), dtype)
    longer = F.raise_error(F.concat(F.lit("illegal sequence characters: "), "piece"))  # two letters in upper case
    coded = F.when(F.length(coded) == F.length("piece"), coded).otherwise(longer)
    ordered = ordered.withColumn("piece", coded)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, columns, sites = None, [], [], []  # (locus, run, chunk), its pieces, and what the run has
        out: list[list] = [[], [], [], []]

        def close_chunk() -> None:
            own = _transposed(held).split("\n")
            columns.extend(own)
            sites.extend(range(at[2] * chunk, at[2] * chunk + len(own)))
            held.clear()

        def close_run() -> None:
            weight = Counter(columns)  # in the order of first sites
            first = dict(zip(reversed(columns), reversed(sites)))
            for values, more in zip(out, ([at[0]] * len(weight), weight, map(first.get, weight), weight.values())):
                values.extend(more)
            columns.clear()
            sites.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, pa.string(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["locus", "column", "pattern_id", "weight"])
            for values in out:
                values.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("locus").type
            *keys, piece = (batch[name].to_pylist() for name in ("locus", "run", "chunk", "piece"))
            for key, text in zip(zip(*keys), piece):
                if key != at:
                    if at is not None:
                        close_chunk()
                        if key[:2] != at[:2]:
                            close_run()
                            if len(out[0]) >= 1 << 16:
                                yield batch_of()
                    at = key
                held.append(text)
        if at is not None:
            close_chunk()
            close_run()
            yield batch_of()

    schema = f"locus {pieces.schema['locus'].dataType.simpleString()}, column string, pattern_id long, weight long"
    one, several = (ordered.filter(c).select("locus", "run", "chunk", "piece").mapInArrow(compress, schema) for c in ("not long", "long"))
    return one, several


def sites_long(sequences: DataFrame) -> DataFrame:
    """(locus, seq_idx, site, base), for users who want one row per character; an empty sequence has none."""
    bases = F.when(F.col("sequence") != "", F.split("sequence", ""))  # split gives an empty text one empty character
    return sequences.select("locus", "seq_idx", F.posexplode(bases).alias("site", "base"))


def encode_states(sites: DataFrame, dtype: str = "DNA") -> DataFrame:
    """Add the state mask of every character; illegal characters fail the job."""
    mask = states.state_mask(F.col("base"), dtype)
    checked = F.when(mask.isNotNull(), mask).otherwise(
        F.raise_error(F.concat(F.lit("illegal character: "), F.coalesce("base", F.lit("NULL"))))
    )
    return sites.withColumn("mask", checked.cast("int"))


def drop_missing_sequences(sequences: DataFrame, dtype: str = "DNA") -> tuple[DataFrame, DataFrame]:
    """Sequences with at least one known character, and the deletions per locus.

    The second table has ``n_deleted`` and ``n_kept``; a locus with none left is
    an error that :func:`require_sequences` raises.
    """
    missing = states.is_missing(F.col("sequence"), F.lit(dtype))
    report = sequences.groupBy("locus").agg(
        F.count_if(missing).alias("n_deleted"), F.count_if(~missing).alias("n_kept")
    )
    return sequences.filter(~missing), report


def require_sequences(report: DataFrame) -> DataFrame:
    return report.withColumn(
        "n_kept",
        F.when(F.col("n_kept") > 0, F.col("n_kept")).otherwise(
            F.raise_error(F.concat(F.lit("no sequence left in locus "), F.col("locus").cast("string"))).cast("long")
        ),
    )


def _ambiguous(column: Column) -> Column:
    return F.upper(column).rlike("[^ACGTU]")


def remove_ambiguous_sites(columns: DataFrame, dtype: str = "DNA") -> DataFrame:
    """Drop every site at which any sequence is ambiguous; amino acids pass."""
    return columns if dtype == "AA" else columns.filter(~_ambiguous(F.col("column")))


def loci_without_clean_sites(columns: DataFrame) -> DataFrame:
    """Loci that :func:`remove_ambiguous_sites` would empty (an input error)."""
    return columns.groupBy("locus").agg(F.bool_and(_ambiguous(F.col("column"))).alias("bad")).filter("bad").select("locus")


def count_ambiguous_sites(columns: DataFrame, dtype: str = "DNA") -> DataFrame:
    hit = F.lit(False) if dtype == "AA" else _ambiguous(F.col("column"))
    return columns.groupBy("locus").agg(F.count_if(hit).alias("n"))


def species_tag(sequences: DataFrame) -> DataFrame:
    """Tag = text after the first ``^`` of the label; an absent tag is an error."""
    tag = F.regexp_extract("label", r"^[^^]*\^(.+)$", 1)
    return sequences.withColumn(
        "tag", F.when(tag != "", tag).otherwise(F.raise_error(F.concat(F.lit("no species tag on "), F.col("label"))))
    )


def select_loci(df: DataFrame, loci: DataFrame) -> DataFrame:
    return df.join(loci, "locus", "left_semi")


def map_species(tagged: DataFrame, imap: DataFrame) -> DataFrame:
    """Add each tag's species; a tag without one fails the job."""
    joined = tagged.join(imap.withColumnRenamed("individual", "tag"), "tag", "left")
    missing = F.raise_error(F.concat(F.lit("no species for individual "), F.col("tag"))).cast("string")
    return joined.withColumn("species", F.coalesce("species", missing))


def unmapped_individuals(tagged: DataFrame, imap: DataFrame) -> DataFrame:
    """Tags without a species: the error list of :func:`map_species`."""
    return tagged.select("tag").distinct().join(imap.withColumnRenamed("individual", "tag"), "tag", "left_anti")


def attach_dates(tagged: DataFrame, dates: DataFrame, rate: float = 1.0) -> DataFrame:
    return tagged.join(
        dates.select(F.col("label").alias("tag"), (F.col("age") * F.lit(float(rate))).alias("age")), "tag", "left"
    )


def assign_partition(loci: DataFrame, partitions: DataFrame) -> DataFrame:
    """Give each locus the data type and model of its block.

    Ranges are cut at multiples of their own bucket width and joined by
    equality on the bucket, so neither side is repeated against all of the
    other.  A locus outside all blocks fails the job.
    """
    width = 1024
    cells = partitions.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    )
    rows = loci.withColumn("_own", F.floor(F.col("locus") / width))
    inside = (F.col("_own") == F.col("_cell")) & F.col("locus").between(F.col("start"), F.col("end"))
    outside = F.raise_error(F.concat(F.lit("no partition for locus "), F.col("locus").cast("string"))).cast(rows.schema["locus"].dataType)
    joined = rows.join(cells, inside, "left")
    return joined.withColumn("locus", F.when(F.col("start").isNull(), outside).otherwise(F.col("locus"))).drop("_own", "_cell", "start", "end")


def validate_partitions(partitions: DataFrame, first: int = 1) -> DataFrame:
    """Rows that start wrongly, overlap or leave a gap; empty when valid.

    Blocks are matched to their neighbours by position arithmetic: a block is
    well placed when its start is ``first`` or one past another block's end.
    """
    starts = partitions.groupBy(F.col("start").alias("at")).agg(F.count(F.lit(1)).alias("starts"))
    ends = partitions.groupBy((F.col("end") + 1).alias("at")).agg(F.count(F.lit(1)).alias("ends"))
    last = partitions.agg((F.max("end") + 1).alias("last"), F.min("start").alias("lowest"))
    points = starts.join(ends, "at", "full").na.fill(0, ["starts", "ends"]).crossJoin(F.broadcast(last))
    edge = (F.col("at") == F.col("last")) & (F.col("ends") == 1) & (F.col("starts") == 0)
    begin = (F.col("at") == first) & (F.col("starts") == 1) & (F.col("ends") == 0)
    inner = (F.col("starts") == 1) & (F.col("ends") == 1)
    broken = points.filter(~(edge | begin | inner)).select(
        "at",
        F.when(F.col("at") == F.col("lowest"), "start")
        .when(F.col("starts") > F.col("ends"), "overlap or gap before")
        .otherwise("overlap or gap after")
        .alias("problem"),
    )
    reversed_rows = partitions.filter("end < start").select(F.col("start").alias("at"), F.lit("reversed").alias("problem"))
    return broken.unionByName(reversed_rows)


def compress_patterns(columns: DataFrame, dtype: str = "DNA", jc69: bool = False) -> DataFrame:
    """Equal columns of a locus become one pattern with a weight.

    ``pattern_id`` is the first site that shows the pattern, which needs no
    ranking.  With ``jc69`` states are first renamed in order of appearance.
    Columns as ``site_columns`` gives them are compressed run by run where they
    are made; only the patterns of loci of several runs are shuffled.
    """
    found = vars(columns).get("_pieces")
    if found is None:
        coded = states.encode_text(F.col("column"), dtype)
        rows = columns.withColumn("column", relabel_jc69(coded) if jc69 else coded)
        return rows.groupBy("locus", "column").agg(F.min("site").alias("pattern_id"), F.count(F.lit(1)).alias("weight"))
    one, several = _run_patterns(*found, dtype)
    merged = lambda df: df.groupBy("locus", "column").agg(F.min("pattern_id").alias("pattern_id"), F.sum("weight").alias("weight"))
    if jc69:
        return merged(one.unionByName(several).withColumn("column", relabel_jc69(F.col("column"))))
    return one.unionByName(merged(several))


def relabel_jc69(coded: Column) -> Column:
    """Rename A,C,G,T to 1,2,3,4 by first appearance; only unambiguous columns.

    Gap-type states (all four bits) keep their code, other ambiguities leave
    the column as it is.  ``coded`` holds hexadecimal state sets.
    """
    order = F.array_join(F.array_distinct(F.split(F.translate(coded, "f", ""), "")), "")
    return F.when(coded.rlike("^[1248f]*$"), F.call_function("translate", coded, order, F.lit("1234"))).otherwise(coded)


def patterns_long(patterns: DataFrame, dtype: str = "DNA") -> DataFrame:
    """(locus, pattern_id, weight, seq_idx, mask): one row per pattern character."""
    chars = patterns.select("locus", "pattern_id", "weight", F.posexplode(F.split("column", "")).alias("seq_idx", "c"))
    return chars.select("locus", "pattern_id", "weight", "seq_idx", states.code_mask(F.col("c"), dtype).alias("mask"))


def _state_sums() -> dict[str, Column]:
    """Weighted characters that admit A, C, G and T, counted inside each row."""
    sums = {}
    for i, name in enumerate("acgt"):
        holders = "".join(d for d in "0123456789abcdef" if int(d, 16) >> i & 1)
        hits = F.length("column") - F.length(F.regexp_replace("column", f"[{holders}]", ""))
        sums[f"n_{name}"] = F.sum(hits * F.col("weight"))
    return sums


def _shares() -> list[Column]:
    whole = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    return [(F.col(f"n_{b}") / whole).alias(f"pi_{b}") for b in "acgt"]


def base_frequencies(patterns: DataFrame) -> DataFrame:
    """Weighted state shares per locus; an ambiguous code counts for each state."""
    totals = patterns.groupBy("locus").agg(*[e.alias(n) for n, e in _state_sums().items()])
    return totals.select("locus", *_shares())


def amino_acid_frequencies(patterns: DataFrame) -> DataFrame:
    """(locus, state, freq) for protein patterns, unions counting for each member."""
    letters = states.AMINO_ACID_ORDER
    masks = patterns_long(patterns, "AA").groupBy("locus", "mask").agg(F.sum("weight").alias("w"))
    each = masks.select(
        "locus",
        "w",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(len(letters) - 1)),
                lambda i: F.call_function("getbit", F.col("mask"), i) == 1,
            )
        ).alias("i"),
    )
    sums = each.groupBy("locus", "i").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("locus"))
    return sums.select("locus", F.substring(F.lit(letters), F.col("i") + 1, F.lit(1)).alias("state"), (F.col("w") / total).alias("freq"))


def alignment_summary(patterns: DataFrame, models: DataFrame, equal_models: tuple[str, ...] = ("JC69", "K80")) -> DataFrame:
    """One row per locus: model, sequences, sites, ambiguous sites, patterns, frequencies."""
    ambiguous = F.col("column").rlike(states.AMBIGUOUS_CODE)
    size = patterns.groupBy("locus").agg(
        F.max(F.length("column")).cast("long").alias("n_sequences"),
        F.sum("weight").alias("n_sites"),
        F.coalesce(F.sum(F.when(ambiguous, F.col("weight"))), F.lit(0)).alias("n_ambiguous"),
        F.count(F.lit(1)).alias("n_patterns"),
        *[e.alias(n) for n, e in _state_sums().items()],
    )
    joined = size.select("*", *_shares()).join(models, "locus")
    equal = F.col("model").isin(*equal_models)
    pis = [F.when(equal, F.lit(0.25)).otherwise(F.col(f"pi_{b}")).alias(f"pi_{b}") for b in "acgt"]
    return joined.select("locus", "model", "n_sequences", "n_sites", "n_ambiguous", "n_patterns", *pis)


def protein_summary(patterns: DataFrame, models: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row per protein locus: model, sequences, sites, ambiguous sites, patterns, 20 state frequencies.

    ``models(locus, model)``; ``fixed(model_id, freqs)`` holds the models that bring their own frequencies, as
    ``read_protein_models`` gives them.  A locus of any other model has the observed shares, an ambiguous code counting
    for each of its states.  Characters are counted by locus first, then given to their states.
    """
    states_in = lambda i: "".join(c for c, m in states.AMINO_ACID_MASKS.items() if m >> i & 1 and c not in "*-?")
    ambiguous = F.col("column").rlike("[BZX]")
    once = lambda value: F.when(F.col("at") == 0, value)  # a pattern's first character stands for the pattern
    letters = patterns.select("locus", "column", "weight", F.posexplode(F.split("column", "")).alias("at", "c"))
    each = letters.groupBy("locus", "c").agg(
        F.max(once(F.length("column"))).cast("long").alias("n_sequences"),
        F.sum(once(F.col("weight"))).alias("n_sites"),
        F.coalesce(F.sum(once(F.when(ambiguous, F.col("weight")))), F.lit(0)).alias("n_ambiguous"),
        F.count(once(F.lit(1))).alias("n_patterns"),
        F.sum("weight").alias("w"),
    )
    sums = each.groupBy("locus").agg(
        F.max("n_sequences").alias("n_sequences"),
        *[F.sum(n).alias(n) for n in ("n_sites", "n_ambiguous", "n_patterns")],
        F.array(*[F.sum(F.when(F.col("c").isin(*states_in(i)), F.col("w")).otherwise(0)) for i in range(20)]).alias("_n"),
    )
    whole = F.aggregate("_n", F.lit(0).cast("long"), lambda s, x: s + x)
    observed = sums.withColumn("_all", whole).withColumn("_seen", F.transform("_n", lambda x: x / F.col("_all")))
    own = fixed.select(F.col("model_id").alias("model"), F.col("freqs").alias("_own"))
    joined = observed.join(models.select("locus", "model"), "locus").join(own, "model", "left")
    columns = ["locus", "model", "n_sequences", "n_sites", "n_ambiguous", "n_patterns"]
    return joined.select(*columns, F.coalesce("_own", "_seen").alias("freqs"))


def population_seqcount(with_species: DataFrame, species: DataFrame, loci: DataFrame) -> DataFrame:
    """Sequences per locus and species, zero-filled.

    ``species`` is the fixed dimension of one analysis (a handful of names): it
    is gathered into one array and exploded beside each locus.
    """
    counts = with_species.groupBy("locus", "species").agg(F.count(F.lit(1)).alias("n"))
    names = species.select("species").agg(F.array_sort(F.collect_set("species")).alias("names"))
    grid = loci.select("locus").crossJoin(F.broadcast(names)).select("locus", F.explode("names").alias("species"))
    return grid.join(counts, ["locus", "species"], "left").na.fill(0, ["n"])


def heterozygosity(columns: DataFrame) -> DataFrame:
    """Two-state characters per (locus, sequence), from patterns with weights."""
    hets = F.posexplode(F.transform(F.split("column", ""), lambda c: c.rlike("[3569ac]")))
    return (
        columns.filter(F.col("column").rlike("[3569ac]"))
        .select("locus", "weight", hets.alias("seq_idx", "het"))
        .filter("het")
        .groupBy("locus", "seq_idx")
        .agg(F.sum("weight").alias("n_het"))
    )


def mean_heterozygosity(patterns: DataFrame) -> DataFrame:
    """Share of characters that are not a single state, per locus."""
    clear = F.length(F.regexp_replace("column", states.AMBIGUOUS_CODE, ""))
    return patterns.groupBy("locus").agg(
        (F.sum((F.length("column") - clear) * F.col("weight")) / F.sum(F.length("column") * F.col("weight"))).alias("h")
    )


def _pair_count(n: Column) -> Column:
    return n * (n - 1) / 2


def mean_pairwise_distance(patterns: DataFrame) -> DataFrame:
    """Differing pairs over all pairs and sites, from character counts.

    Pairs are never listed: per pattern, all pairs minus the pairs that share a
    character.
    """
    n = F.length("column").cast("double")
    chars = F.split("column", "")
    same = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc + _pair_count(n - F.length(F.call_function("replace", F.col("column"), c, F.lit("")))),
    )
    return patterns.groupBy("locus").agg(
        (F.sum((_pair_count(n) - same) * F.col("weight")) / F.sum(_pair_count(n) * F.col("weight"))).alias("d")
    )


def _gram_tiles(codes: np.ndarray, weight: np.ndarray, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, weighted differences) of the tiles at and below the diagonal, by products of one-hot
    columns: a character's own product counts the pairs of sequences that share it."""
    n = codes.shape[1]
    characters = np.unique(codes)
    for i in range(0, n, tile):
        left = codes[:, i : i + tile]
        for j in range(0, i + 1, tile):
            right = codes[:, j : j + tile]
            same = sum(((left == c) * weight[:, None]).T @ (right == c).astype(float) for c in characters)
            yield i, j, np.rint(weight.sum() - same).astype(np.int64)


def pairwise_differences(patterns: DataFrame, tile: int = 128) -> DataFrame:
    """(locus, j1, j2, diff, p) for every pair of sequences of a locus, j1 > j2.

    The pairs are the result.  A run of patterns of a locus becomes weighted counts of differences between blocks of
    ``tile`` sequences inside the task that reads it; the tiles of all runs are added, and only sums become pairs.
    """
    kind = patterns.schema["locus"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for locus, rows in batch.groupby("locus", sort=False):
                codes = np.frombuffer("".join(rows["column"]).encode("utf-32-le"), np.uint32).reshape(len(rows), -1)
                weight = rows["weight"].to_numpy(float)
                for i, j, diff in _gram_tiles(codes, weight, tile):
                    out.append((locus, i, j, diff.shape[1], int(weight.sum()), diff.ravel()))
            yield pd.DataFrame(out, columns=["locus", "i", "j", "width", "length", "diff"])

    schema = f"locus {kind}, i long, j long, width long, length long, diff array<bigint>"
    # runs of a locus are made long, and a long locus is many runs: a pattern's id is the first site that shows it
    runs = patterns.repartition("locus", F.floor(F.col("pattern_id") / SITES_A_RUN)).sortWithinPartitions("locus")
    tiles = runs.select("locus", "column", "weight").mapInPandas(count, schema)
    plus = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda m, n: m + n))
    summed = tiles.groupBy("locus", "i", "j").agg(F.max("width").alias("width"), F.sum("length").alias("length"), F.collect_list("diff").alias("all"))
    summed = summed.select("locus", "i", "j", "width", "length", plus.alias("diff"))
    cells = summed.select("locus", "i", "j", "width", "length", F.posexplode("diff").alias("at", "diff"))
    j1, j2 = F.col("i") + F.floor(F.col("at") / F.col("width")), F.col("j") + F.col("at") % F.col("width")
    pairs = cells.select("locus", j1.cast("int").alias("j1"), j2.cast("int").alias("j2"), "diff", (F.col("diff") / F.col("length")).alias("p"))
    return pairs.filter("j1 > j2")


def root_divergence(patterns: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean divergence across the root per locus, and the starting root age.

    ``sides(locus, left, right)`` holds the ``seq_idx`` arrays of the sequences
    below the root's left and right child.  Differing pairs across the root
    are counted from character counts on each side.
    """
    # joined patterns carry both arrays; no pair of sequences is ever formed
    joined = patterns.join(sides, "locus")
    pick = lambda side: F.array_join(
        F.transform(F.col(side), lambda i: F.substring(F.col("column"), i + 1, F.lit(1))), ""
    )
    rows = joined.select("locus", "weight", F.size("left").alias("nl"), F.size("right").alias("nr"), pick("left").alias("l"), pick("right").alias("r"))
    count = lambda text, c: F.length(text) - F.length(F.call_function("replace", text, c, F.lit("")))
    same = F.aggregate(
        F.array_distinct(F.split("l", "")),
        F.lit(0),
        lambda acc, c: acc + count(F.col("l"), c) * count(F.col("r"), c),
    )
    pairs = F.col("nl") * F.col("nr")
    per_locus = (
        rows.groupBy("locus", "nl", "nr")
        .agg(F.sum((pairs - F.when(pairs > 0, same).otherwise(0)) * F.col("weight")).alias("diff"), F.sum("weight").alias("length"))
        .select("locus", F.when(pairs > 0, F.col("diff") / F.col("length") / (2 * pairs)).alias("divergence"))
    )
    moments = per_locus.agg(
        F.count(F.lit(1)).alias("loci"),
        F.count("divergence").alias("used"),
        F.coalesce(F.avg("divergence"), F.lit(0.0)).alias("md"),
        F.coalesce(F.var_pop("divergence") * F.count("divergence") / F.count(F.lit(1)), F.lit(0.0)).alias("vd"),
    )
    theta = (2 * F.sqrt("vd") + F.sqrt(F.col("vd") * 4 + 1) - 1) / 2
    age = F.when((F.col("used") >= 2) & (F.col("md") - theta / 2 > 0), F.col("md") - theta / 2).otherwise(F.col("md"))
    return per_locus, moments.select("md", "vd", age.alias("root_age"))


def load_profile(patterns: DataFrame) -> DataFrame:
    """Sequences x patterns per locus: the work estimate used for salting."""
    return patterns.groupBy("locus").agg(
        (F.max(F.length("column")) * F.count(F.lit(1))).cast("long").alias("load")
    )
