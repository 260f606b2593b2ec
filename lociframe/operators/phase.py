"""Phasing of diploid genotypes: fixed hets, expansion and pattern mapping."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import states
from lociframe.functions.mathfns import drop_lowest_bit, lowest_bit
from lociframe.session import cut_lineage

HET = "[3569ac]"
THREE_STATES = "[7bde]"
#: bits of a resolution number that one task adds to a row at a time
_BITS = 12
_SALTS = 16


def het_states(patterns: DataFrame, diploid: DataFrame) -> DataFrame:
    """(locus, pattern_id, weight, seq_idx) of two-state codes in diploid rows.

    ``patterns`` are coded columns; ``diploid(locus, seq_idx)`` lists diploids.
    """
    flags = F.transform(F.split("column", ""), lambda c: c.rlike(HET))
    rows = patterns.filter(F.col("column").rlike(HET)).select("locus", "pattern_id", "weight", F.posexplode(flags).alias("seq_idx", "het"))
    return rows.filter("het").drop("het").join(diploid.select("locus", "seq_idx"), ["locus", "seq_idx"], "left_semi")


def three_state_report(patterns: DataFrame, diploid: DataFrame) -> DataFrame:
    """Codes of three states in diploid rows: reported, not phased."""
    flags = F.transform(F.split("column", ""), lambda c: c.rlike(THREE_STATES))
    rows = patterns.filter(F.col("column").rlike(THREE_STATES)).select("locus", "pattern_id", F.posexplode(flags).alias("seq_idx", "three"))
    return rows.filter("three").drop("three").join(diploid.select("locus", "seq_idx"), ["locus", "seq_idx"], "left_semi")


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fix one het per sequence, most heterozygous singleton site first."""
    hets = {site: set(g) for site, g in pdf.groupby("pattern_id")["seq_idx"]}
    counts = dict(zip(pdf["pattern_id"], pdf["site_hets"]))
    singles = dict(zip(pdf["seq_idx"], pdf["seq_singletons"]))
    open_seqs, fixed = set(singles), []
    while open_seqs:
        usable = [(-counts[s], s) for s, seqs in hets.items() if seqs & open_seqs]
        if not usable:
            break
        site = min(usable)[1]
        chosen = min((singles[q], q) for q in hets[site] & open_seqs)[1]
        counts[site] -= 1
        open_seqs.discard(chosen)
        fixed.append((site, chosen))
    out = pd.DataFrame(fixed, columns=["pattern_id", "seq_idx"])
    out.insert(0, "locus", pdf["locus"].iloc[0])
    return out


def diploid_phase_fix(patterns: DataFrame, diploid: DataFrame) -> DataFrame:
    """(locus, pattern_id, seq_idx) of the hets whose phase can be fixed.

    The rule is a greedy sequence of choices within a locus, one per diploid
    sequence.  A sequence's choice is always among its own most heterozygous
    singleton sites, as many as there are sequences plus one, so only those
    sites enter the group: its size depends on the sequences, not on the sites.
    """
    single = cut_lineage(het_states(patterns, diploid).filter("weight = 1").drop("weight"))  # read five times below
    per_site = single.groupBy("locus", "pattern_id").agg(F.count(F.lit(1)).alias("site_hets"))
    per_seq = single.groupBy("locus", "seq_idx").agg(F.count(F.lit(1)).alias("seq_singletons"))
    n_seq = diploid.groupBy("locus").agg((F.count(F.lit(1)) + 1).alias("keep"))
    rows = single.join(per_site, ["locus", "pattern_id"]).join(n_seq, "locus")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("pattern_id"), F.lit(_SALTS)))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("site_hets"), "pattern_id"))
    first = rows.withColumn("_r", best("locus", "seq_idx", "_salt")).filter("_r <= keep")
    needed = first.withColumn("_r", best("locus", "seq_idx")).filter("_r <= keep").select("locus", "pattern_id").distinct()
    small = rows.join(needed, ["locus", "pattern_id"], "left_semi").join(per_seq, ["locus", "seq_idx"])
    locus_type = dict(patterns.dtypes)["locus"]
    return (
        small.select("locus", "pattern_id", "seq_idx", "site_hets", "seq_singletons")
        .groupBy("locus")
        .applyInPandas(_resolve, f"locus {locus_type}, pattern_id long, seq_idx long")
    )


class Expansion(NamedTuple):
    """Phased columns, and for every site of every locus how many there are."""

    columns: DataFrame
    counts: DataFrame


def _open_hets(patterns: DataFrame, diploid: DataFrame, fixed: DataFrame) -> DataFrame:
    """Patterns as characters with the indices of diploid rows (``dip``), fixed hets (``fix``) and the ``h`` open ``hets``."""
    members = diploid.groupBy("locus").agg(F.collect_set(F.col("seq_idx").cast("int")).alias("dip"))
    fixes = fixed.groupBy("locus", "pattern_id").agg(F.collect_set(F.col("seq_idx").cast("int")).alias("fix"))
    none = F.array().cast("array<int>")
    rows = (
        patterns.join(members, "locus", "left")
        .join(fixes, ["locus", "pattern_id"], "left")
        .withColumn("dip", F.coalesce("dip", none))
        .withColumn("fix", F.coalesce("fix", none))
        .withColumn("chars", F.split("column", ""))
    )
    open_hets = F.filter(
        F.sequence(F.lit(0), F.size("chars") - 1),
        lambda i: F.array_contains("dip", i) & ~F.array_contains("fix", i) & F.get(F.col("chars"), i).rlike(HET),
    )
    return rows.withColumn("hets", open_hets).withColumn("h", F.size("hets"))


def _resolutions(rows: DataFrame, most_hets: int, total: int, bits: int, rows_a_task: int) -> DataFrame:
    """Each row once for every ``resolution_idx`` below 2**h.

    Of ``h`` bits the highest are added first, ``bits`` at a time, and the pieces are dealt out anew before the next
    ones, so that a task makes at most 2**bits rows of one that it reads and the last, widest step is spread evenly.
    """
    rows = rows.withColumns({"resolution_idx": F.lit(0).cast("long"), "_left": F.col("h")})
    further = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1))
    step = most_hets
    parts = max(1, min(total // rows_a_task + 1, 1 << 20))
    while step > bits:
        n = F.least(F.lit(bits), F.greatest(F.col("_left") - bits, F.lit(0)))
        rows = rows.withColumn("_n", n).withColumn("_more", further(F.col("_n")))
        number = F.call_function("shiftleft", F.col("resolution_idx"), F.col("_n")).bitwiseOR(F.col("_more"))
        rows = rows.withColumns({"resolution_idx": number, "_left": F.col("_left") - F.col("_n")}).drop("_n", "_more")
        rows = rows.repartition(parts, "locus", "pattern_id", "resolution_idx")
        step -= min(bits, step - bits)
    rows = rows.withColumn("_more", further(F.col("_left")))
    number = F.call_function("shiftleft", F.col("resolution_idx"), F.col("_left")).bitwiseOR(F.col("_more"))
    return rows.withColumn("resolution_idx", number).drop("_left", "_more")


def diploid_expand(
    patterns: DataFrame, diploid: DataFrame, fixed: DataFrame, most_columns: int = 1 << 40, bits: int = _BITS,
    rows_a_task: int = 1 << 20,
) -> Expansion:
    """``columns(locus, site, resolution_idx, column, weight)``: phased columns; ``counts(locus, site, h, n_columns,
    fits)``: what each site becomes.

    Every diploid sequence becomes two.  A site with h unfixed hets gives 2**h columns; the first unfixed het is the
    highest bit of ``resolution_idx``.  A set bit swaps the two states.  The expansion is planned from the sizes of its
    output, see ``_resolutions``.  A locus that would have over ``most_columns`` columns, which no storage holds, is not
    expanded in part: its sites stand in ``counts`` with ``fits`` false, and only there.
    """
    rows = _open_hets(cut_lineage(patterns), diploid, fixed)  # patterns are read for the sizes and for the columns
    n_columns = F.pow(F.lit(2.0), F.col("h"))  # exact as a double up to h = 1023
    size = rows.groupBy("locus").agg(F.sum(n_columns).alias("_size"), F.max("h").alias("_most"))
    size = cut_lineage(size.withColumn("fits", F.col("_size") <= float(most_columns)))
    plan = size.filter("fits").agg(F.max("_most").alias("most"), F.sum("_size").alias("total")).first()
    counts = rows.select("locus", F.col("pattern_id").alias("site"), "h", n_columns.alias("n_columns")).join(size.select("locus", "fits"), "locus")
    able = rows.join(size.filter("not fits").select("locus"), "locus", "left_anti")
    each = _resolutions(able, plan["most"] or 0, int(plan["total"] or 0), bits, rows_a_task)
    digit = lambda mask: F.substring(F.lit("0123456789abcdef"), mask + 1, F.lit(1))

    def phased(c, i):
        mask = states.code_mask(c)
        low, high = digit(lowest_bit(mask)), digit(drop_lowest_bit(mask))
        place = F.array_position("hets", i)
        swap = F.call_function("getbit", F.col("resolution_idx"), (F.col("h") - place).cast("int")) == 1
        pair = F.when(place > 0, F.when(swap, F.concat(high, low)).otherwise(F.concat(low, high)))
        pair = pair.when(F.array_contains("fix", i), F.concat(low, high)).otherwise(F.concat(c, c))
        return F.when(F.array_contains("dip", i), pair).otherwise(c)

    column = F.array_join(F.transform(F.col("chars"), phased), "")
    columns = each.select("locus", F.col("pattern_id").alias("site"), "resolution_idx", column.alias("column"), "weight")
    return Expansion(columns, counts)


def phased_labels(sequences: DataFrame, diploid: DataFrame) -> DataFrame:
    """(locus, seq_idx, label): ``.1`` and ``.2`` copies of diploid sequences."""
    marked = sequences.select("locus", "seq_idx", "label").join(
        diploid.select("locus", "seq_idx").withColumn("_d", F.lit(True)), ["locus", "seq_idx"], "left"
    )
    parts = F.when(F.col("_d"), F.array(F.lit(".1"), F.lit(".2"))).otherwise(F.array(F.lit("")))
    split = marked.select("locus", F.col("seq_idx").alias("_old"), "label", F.posexplode(parts).alias("_half", "suffix"))
    w = Window.partitionBy("locus").orderBy("_old", "_half")  # sequences of one locus
    return split.select("locus", (F.row_number().over(w) - 1).alias("seq_idx"), F.concat("label", "suffix").alias("label"))


def phase_patterns(expanded: DataFrame, jc69: bool = False) -> DataFrame:
    """Compress the phased columns; ``pattern_id`` is derived from the column."""
    from lociframe.operators.align import relabel_jc69

    coded = relabel_jc69(F.col("column")) if jc69 else F.col("column")
    keyed = expanded.withColumn("column", coded)
    return keyed.groupBy("locus", "column").agg(
        F.min(F.struct("site", "resolution_idx")).alias("first"), F.count(F.lit(1)).alias("n_columns")
    ).select("locus", F.concat_ws(".", "first.site", "first.resolution_idx").alias("pattern_id"), "column", "n_columns")


def phase_pattern_map(expanded: DataFrame, patterns: DataFrame, jc69: bool = False) -> DataFrame:
    """(locus, site, resolution_idx, pattern_id) by joining on the column."""
    from lociframe.operators.align import relabel_jc69

    coded = relabel_jc69(F.col("column")) if jc69 else F.col("column")
    return (
        expanded.withColumn("column", coded)
        .join(patterns.select("locus", "column", "pattern_id"), ["locus", "column"])
        .select("locus", "site", "resolution_idx", "pattern_id")
    )


def consensus_genotype(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of the states of two haplotypes, character by character.

    Both are coded strings ``(locus, individual, coded)``.
    """
    pairs = first.withColumnRenamed("coded", "a").join(second.withColumnRenamed("coded", "b"), ["locus", "individual"])
    digit = lambda mask: F.substring(F.lit("0123456789abcdef"), mask + 1, F.lit(1))
    merged = F.zip_with(
        F.split("a", ""), F.split("b", ""), lambda x, y: digit(states.code_mask(x).bitwiseOR(states.code_mask(y)))
    )
    return pairs.select("locus", "individual", F.array_join(merged, "").alias("coded"))
