"""Queries over alignments, species maps and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import states
from lociframe.operators import align as L
from lociframe.operators import phase as P
from lociframe.plans.registry import query, r
from lociframe.session import cut_lineage
from lociframe.sources import adapters as A
from lociframe.sources import sinks as S

_CODES = "".join(states.NUCLEOTIDE_MASKS)
_DIGITS = "".join("0123456789abcdef"[m] for m in states.NUCLEOTIDE_MASKS.values())


def _seq(i: int) -> str:
    pattern, groups = A.DEALS[i]
    keep = "".join(f"\\{g + 1}" for g in range(groups))
    return (
        f"regexp_replace(translate(regexp_replace(padded, '{pattern}', '{keep}', 'g'), "
        f"'{A.LETTERS}', '{A.BASES}'), '[^ACGTYN-]', 'N', 'g')"
    )


DOCS = f"""docs AS (
  SELECT doc_id AS locus, source, {_seq(0)} AS s0, {_seq(1)} AS s1, {_seq(2)} AS s2, {_seq(3)} AS s3
  FROM (SELECT doc_id, source, rpad(text, CAST(ceil(length(text) / 4.0) * 4 AS INTEGER), '~') AS padded FROM documents))"""
SEQS = DOCS + """, seqs AS (
  SELECT locus, source, CAST(i AS INTEGER) AS seq_idx, 'd' || locus || '^' || source || '.' || i AS label,
         CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS sequence
  FROM docs, range(4) t(i))"""
COLS = SEQS + """, cols AS (
  SELECT locus, site, a || b || c || d AS col FROM (
    SELECT locus, CAST(unnest(range(length(s0))) AS BIGINT) AS site, unnest(string_split(s0, '')) AS a,
           unnest(string_split(s1, '')) AS b, unnest(string_split(s2, '')) AS c, unnest(string_split(s3, '')) AS d
    FROM docs))"""
PATS = COLS + f""", pats AS (
  SELECT locus, translate(col, '{_CODES}', '{_DIGITS}') AS col, min(site) AS pattern_id, count(*) AS weight
  FROM cols GROUP BY 1, 2)"""
CHARS = PATS + """, chars AS (
  SELECT locus, pattern_id, weight, col, i AS seq_idx, substr(col, CAST(i + 1 AS INTEGER), 1) AS c,
         instr('0123456789abcdef', substr(col, CAST(i + 1 AS INTEGER), 1)) - 1 AS mask
  FROM pats, range(4) t(i))"""
IMAP = """imap AS (
  SELECT source || '.' || i AS individual, CASE WHEN i < 2 THEN 'A' WHEN i = 2 THEN 'B' ELSE 'C' END AS species
  FROM (SELECT DISTINCT source FROM documents), range(4) t(i))"""
PARTS = """parts AS (
  SELECT min(doc_id) AS start, max(doc_id) AS "end", 'DNA' AS dtype,
         ['JC69', 'K80', 'HKY', 'GTR', 'TN93'][CAST(b % 5 AS INTEGER) + 1] AS model
  FROM (SELECT doc_id, doc_id // 50 AS b FROM documents) GROUP BY b)"""


def columns(spark, sf):
    return L.site_columns(A.sequences(spark, sf))


def patterns(spark, sf):
    return L.compress_patterns(columns(spark, sf))


@query("site_columns", f"WITH {COLS} SELECT locus, count(*) AS sites, md5(string_agg(col, '' ORDER BY site)) AS digest FROM cols GROUP BY 1")
def site_columns(spark, sf):
    packed = columns(spark, sf).groupBy("locus").agg(
        F.count(F.lit(1)).alias("sites"), F.sort_array(F.collect_list(F.struct("site", "column"))).alias("s")
    )
    return packed.select("locus", "sites", F.md5(F.array_join(F.transform("s", lambda x: x["column"]), "")).alias("digest"))


@query("encode_states", f"WITH {CHARS} SELECT locus, seq_idx, CAST(mask AS INTEGER) AS mask, CAST(sum(weight) AS BIGINT) AS n FROM chars GROUP BY 1, 2, 3")
def encode_states(spark, sf):
    coded = L.encode_states(L.sites_long(A.sequences(spark, sf)))
    return coded.groupBy("locus", F.col("seq_idx").cast("long").alias("seq_idx"), "mask").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_missing_sequences",
    f"WITH {SEQS} SELECT locus, CAST(count(*) FILTER (regexp_full_match(sequence, '[-?NXnx]*')) AS BIGINT) AS n_deleted, "
    "CAST(count(*) FILTER (NOT regexp_full_match(sequence, '[-?NXnx]*')) AS BIGINT) AS n_kept FROM seqs GROUP BY 1",
)
def drop_missing_sequences(spark, sf):
    kept, report = L.drop_missing_sequences(A.sequences(spark, sf))
    left = kept.groupBy("locus").agg(F.count(F.lit(1)).alias("n_kept"))
    return report.drop("n_kept").join(left, "locus", "left").na.fill(0, ["n_kept"])


@query(
    "remove_ambiguous_sites",
    f"WITH {COLS} SELECT locus, col AS site_column, count(*) AS n FROM cols WHERE NOT regexp_matches(col, '[^ACGTU]') GROUP BY 1, 2",
)
def remove_ambiguous_sites(spark, sf):
    clean = L.remove_ambiguous_sites(columns(spark, sf))
    return clean.groupBy("locus", F.col("column").alias("site_column")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "count_ambiguous_sites",
    f"WITH {COLS} SELECT locus, count(*) FILTER (regexp_matches(col, '[^ACGTU]')) AS n FROM cols GROUP BY 1",
)
def count_ambiguous_sites(spark, sf):
    return L.count_ambiguous_sites(columns(spark, sf))


@query("species_tag", f"WITH {SEQS} SELECT locus, seq_idx, label, regexp_extract(label, '^[^^]*\\^(.+)$', 1) AS tag FROM seqs")
def species_tag(spark, sf):
    return L.species_tag(A.sequences(spark, sf)).select("locus", "seq_idx", "label", "tag")


@query(
    "select_loci",
    f"WITH {SEQS} SELECT locus, seq_idx, length(sequence) AS len FROM seqs WHERE locus IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def select_loci(spark, sf):
    loci = A.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("locus"))
    kept = L.select_loci(A.sequences(spark, sf), loci)
    return kept.select("locus", "seq_idx", F.length("sequence").cast("long").alias("len"))


@query(
    "map_species",
    f"WITH {SEQS}, {IMAP} SELECT locus, seq_idx, species FROM seqs JOIN imap ON source || '.' || seq_idx = individual",
)
def map_species(spark, sf):
    tagged = L.species_tag(A.sequences(spark, sf))
    return L.map_species(tagged, A.imap(spark, sf)).select("locus", "seq_idx", "species")


@query(
    "attach_dates",
    f"WITH {SEQS}, dates AS (SELECT source || '.0' AS tag, CAST(max(doc_id) AS DOUBLE) AS age FROM documents GROUP BY source) "
    "SELECT locus, seq_idx, round(age * 0.001, 6) AS age FROM seqs LEFT JOIN dates ON source || '.' || seq_idx = tag",
)
def attach_dates(spark, sf):
    docs = A.table(spark, sf, "documents")
    dates = docs.groupBy("source").agg(F.max("doc_id").cast("double").alias("age"))
    dates = dates.select(F.concat("source", F.lit(".0")).alias("label"), "age")
    tagged = L.species_tag(A.sequences(spark, sf))
    return L.attach_dates(tagged, dates, 0.001).select("locus", "seq_idx", r("age"))


@query(
    "assign_partition",
    f"WITH {PARTS} SELECT doc_id AS locus, dtype, model FROM documents JOIN parts ON doc_id BETWEEN start AND \"end\"",
)
def assign_partition(spark, sf):
    loci = A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"))
    return L.assign_partition(loci, A.partitions(spark, sf)).select("locus", "dtype", "model")


@query(
    "validate_partitions",
    """WITH broken AS (
      SELECT min(doc_id) + 1 + CASE WHEN b % 5 = 3 THEN 2 ELSE 0 END AS start, max(doc_id) + 1 AS "end"
      FROM (SELECT doc_id, doc_id // 50 AS b FROM documents) GROUP BY b),
    linked AS (SELECT start, lag("end") OVER (ORDER BY start) AS previous FROM broken)
    SELECT CAST(previous + 1 AS BIGINT) AS "at", 'overlap or gap after' AS problem FROM linked WHERE start <> previous + 1
    UNION ALL SELECT CAST(start AS BIGINT), 'overlap or gap before' FROM linked WHERE start <> previous + 1""",
)
def validate_partitions(spark, sf):
    blocks = A.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("b"))
    broken = blocks.agg(
        (F.min("doc_id") + 1 + F.when(F.col("b") % 5 == 3, 2).otherwise(0)).alias("start"), (F.max("doc_id") + 1).alias("end")
    )
    return L.validate_partitions(broken.select("start", "end"))


@query("compress_patterns", f"WITH {PATS} SELECT locus, col AS code, pattern_id, weight FROM pats")
def compress_patterns(spark, sf):
    return patterns(spark, sf).select("locus", F.col("column").alias("code"), "pattern_id", "weight")


_RELABEL = """CASE WHEN regexp_full_match(col, '[1248f]*') THEN translate(col,
  list_aggregate(list_transform(list_sort(list_distinct(list_transform(string_split(replace(col, 'f', ''), ''),
    lambda x: CAST(instr(replace(col, 'f', ''), x) AS VARCHAR) || x))), lambda x: x[-1]), 'string_agg', ''), '1234') ELSE col END"""


@query(
    "compress_patterns_jc69",
    f"""WITH {COLS}, enc AS (SELECT locus, site, translate(col, '{_CODES}', '{_DIGITS}') AS col FROM cols)
    SELECT locus, {_RELABEL} AS code, min(site) AS pattern_id, count(*) AS weight FROM enc GROUP BY 1, 2""",
)
def compress_patterns_jc69(spark, sf):
    out = L.compress_patterns(columns(spark, sf), jc69=True)
    return out.select("locus", F.col("column").alias("code"), "pattern_id", "weight")


_FREQ = ", ".join(
    f"round(sum(CASE WHEN (mask >> {i}) & 1 = 1 THEN weight ELSE 0 END) / "
    f"CAST(sum(weight * bit_count(CAST(mask AS INTEGER))) AS DOUBLE), 6) AS pi_{b}"
    for i, b in enumerate("acgt")
)


@query("base_frequencies", f"WITH {CHARS} SELECT locus, {_FREQ} FROM chars GROUP BY 1")
def base_frequencies(spark, sf):
    return L.base_frequencies(patterns(spark, sf)).select("locus", *[r(f"pi_{b}") for b in "acgt"])


_PIS = ", ".join(f"CASE WHEN model IN ('JC69', 'K80') THEN 0.25 ELSE pi_{b} END AS pi_{b}" for b in "acgt")


@query(
    "alignment_summary",
    f"""WITH {CHARS}, {PARTS}, f AS (SELECT locus, {_FREQ} FROM chars GROUP BY 1),
    s AS (SELECT locus, CAST(4 AS BIGINT) AS n_sequences, CAST(sum(weight) AS BIGINT) AS n_sites,
      CAST(coalesce(sum(weight) FILTER (regexp_matches(col, '[35679abcdef]')), 0) AS BIGINT) AS n_ambiguous,
      count(*) AS n_patterns FROM pats GROUP BY 1)
    SELECT s.*, model, {_PIS} FROM s JOIN f USING (locus) JOIN parts ON locus BETWEEN start AND "end" """,
)
def alignment_summary(spark, sf):
    loci = A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"))
    models = L.assign_partition(loci, A.partitions(spark, sf)).select("locus", "model")
    out = L.alignment_summary(patterns(spark, sf), models)
    return out.select("locus", "model", "n_sequences", "n_sites", "n_ambiguous", "n_patterns", *[r(f"pi_{b}") for b in "acgt"])


_AMINO = "ARNDCQEGHILKMFPSTWYV"
_UNIONS = {"N": "B", "D": "B", "Q": "Z", "E": "Z"}
_AA_COUNTS = ", ".join(
    f"sum(weight * (length(col) - length(translate(col, '{c}X{_UNIONS.get(c, '')}', '')))) AS n{i}" for i, c in enumerate(_AMINO)
)
_AA_ALL = " + ".join(f"n{i}" for i in range(20))
_AA_PIS = ", ".join(f"round(CASE WHEN locus % 2 = 0 THEN 0.05 ELSE n{i} / CAST({_AA_ALL} AS DOUBLE) END, 6) AS pi_{c.lower()}" for i, c in enumerate(_AMINO))


@query(
    "protein_summary",
    f"""WITH t AS (SELECT doc_id AS locus, translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 'JOUX-', 'XXXXX') AS s FROM documents),
    q AS (SELECT *, CAST(ceil(length(s) / 4.0) AS INTEGER) AS n FROM t),
    p AS (SELECT locus, n, rpad(s, 4 * n, 'X') AS s FROM q),
    c AS (SELECT locus, s, n, CAST(unnest(range(n)) AS INTEGER) AS i FROM (
      SELECT locus, n, [string_split(substr(s, 1, n), ''), string_split(substr(s, n + 1, n), ''), string_split(substr(s, 2 * n + 1, n), ''),
        string_split(substr(s, 3 * n + 1, n), '')] AS s FROM p)),
    pats AS (SELECT locus, s[1][i + 1] || s[2][i + 1] || s[3][i + 1] || s[4][i + 1] AS col, count(*) AS weight FROM c GROUP BY 1, 2),
    f AS (SELECT locus, CAST(4 AS BIGINT) AS n_sequences, CAST(sum(weight) AS BIGINT) AS n_sites,
      CAST(coalesce(sum(weight) FILTER (regexp_matches(col, '[BZX]')), 0) AS BIGINT) AS n_ambiguous, count(*) AS n_patterns, {_AA_COUNTS} FROM pats GROUP BY 1)
    SELECT locus, CASE WHEN locus % 2 = 0 THEN 'equal' ELSE 'observed' END AS model, n_sequences, n_sites, n_ambiguous, n_patterns, {_AA_PIS} FROM f""",
)
def protein_summary(spark, sf):
    """Loci of a model with its own frequencies and loci with observed ones."""
    coded = L.compress_patterns(L.site_columns(A.proteins(spark, sf)), "AA")
    model = F.when(F.col("doc_id") % 2 == 0, "equal").otherwise("observed").alias("model")
    models = A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"), model).distinct()
    fixed = spark.createDataFrame([("equal", [0.05] * 20)], "model_id string, freqs array<double>")
    out = L.protein_summary(coded, models, fixed)
    pis = [r(F.col("freqs")[i]).alias(f"pi_{c.lower()}") for i, c in enumerate(_AMINO)]
    return out.select("locus", "model", "n_sequences", "n_sites", "n_ambiguous", "n_patterns", *pis)


@query(
    "population_seqcount",
    f"""WITH {SEQS}, {IMAP}, kept AS (SELECT * FROM seqs WHERE NOT regexp_full_match(sequence, '[-?NXnx]*')),
    m AS (SELECT locus, species FROM kept JOIN imap ON source || '.' || seq_idx = individual)
    SELECT l.locus, s.species, count(m.locus) AS n FROM docs l CROSS JOIN (SELECT DISTINCT species FROM imap) s
    LEFT JOIN m ON m.locus = l.locus AND m.species = s.species GROUP BY 1, 2""",
)
def population_seqcount(spark, sf):
    kept, _ = L.drop_missing_sequences(A.sequences(spark, sf))
    imap = A.imap(spark, sf)
    mapped = L.map_species(L.species_tag(kept), imap)
    loci = A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"))
    return L.population_seqcount(mapped, imap, loci)


@query(
    "heterozygosity",
    f"WITH {CHARS} SELECT locus, CAST(seq_idx AS BIGINT) AS seq_idx, CAST(sum(weight) AS BIGINT) AS n_het FROM chars WHERE bit_count(CAST(mask AS INTEGER)) = 2 GROUP BY 1, 2",
)
def heterozygosity(spark, sf):
    return L.heterozygosity(patterns(spark, sf)).select("locus", F.col("seq_idx").cast("long").alias("seq_idx"), "n_het")


@query(
    "mean_heterozygosity",
    f"WITH {CHARS} SELECT locus, round(sum(CASE WHEN bit_count(CAST(mask AS INTEGER)) > 1 THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE), 6) AS h FROM chars GROUP BY 1",
)
def mean_heterozygosity(spark, sf):
    return L.mean_heterozygosity(patterns(spark, sf)).select("locus", r("h"))


_PAIRS = """pairs AS (
  SELECT x.locus, x.seq_idx AS j1, y.seq_idx AS j2, sum(x.weight) AS length,
         sum(CASE WHEN x.c <> y.c THEN x.weight ELSE 0 END) AS diff
  FROM chars x JOIN chars y ON x.locus = y.locus AND x.pattern_id = y.pattern_id AND x.seq_idx > y.seq_idx GROUP BY 1, 2, 3)"""


@query("mean_pairwise_distance", f"WITH {CHARS}, {_PAIRS} SELECT locus, round(sum(diff) / CAST(sum(length) AS DOUBLE), 6) AS d FROM pairs GROUP BY 1")
def mean_pairwise_distance(spark, sf):
    return L.mean_pairwise_distance(patterns(spark, sf)).select("locus", r("d"))


@query(
    "pairwise_differences",
    f"WITH {CHARS}, {_PAIRS} SELECT locus, CAST(j1 AS BIGINT) AS j1, CAST(j2 AS BIGINT) AS j2, CAST(diff AS BIGINT) AS diff, round(diff / CAST(length AS DOUBLE), 6) AS p FROM pairs",
)
def pairwise_differences(spark, sf):
    out = L.pairwise_differences(patterns(spark, sf))
    return out.select("locus", F.col("j1").cast("long").alias("j1"), F.col("j2").cast("long").alias("j2"), "diff", r("p"))


@query(
    "root_divergence",
    f"""WITH {CHARS}, {_PAIRS}, d AS (SELECT locus, avg(diff / CAST(length AS DOUBLE)) / 2 AS div FROM pairs
      WHERE (j1 < 2) <> (j2 < 2) GROUP BY 1),
    m AS (SELECT avg(div) AS md, sum((div - (SELECT avg(div) FROM d)) ** 2) / count(*) AS vd FROM d),
    t AS (SELECT md, vd, (2 * sqrt(vd) + sqrt(4 * vd + 1) - 1) / 2 AS theta FROM m)
    SELECT round(md, 6) AS md, round(vd, 6) AS vd, round(CASE WHEN md - theta / 2 > 0 THEN md - theta / 2 ELSE md END, 6) AS root_age FROM t""",
)
def root_divergence(spark, sf):
    sides = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("locus"), F.array(F.lit(0), F.lit(1)).alias("left"), F.array(F.lit(2), F.lit(3)).alias("right")
    )
    return L.root_divergence(patterns(spark, sf), sides)[1].select(r("md"), r("vd"), r("root_age"))


@query("load_profile", f"WITH {PATS} SELECT locus, CAST(4 * count(*) AS BIGINT) AS load FROM pats GROUP BY 1")
def load_profile(spark, sf):
    return L.load_profile(patterns(spark, sf))


@query(
    "concat_alignment",
    f"WITH {SEQS} SELECT source || '.' || seq_idx AS label, CAST(sum(length(sequence)) AS BIGINT) AS len, md5(string_agg(sequence, '' ORDER BY locus)) AS digest FROM seqs GROUP BY 1",
)
def concat_alignment(spark, sf):
    tagged = L.species_tag(A.sequences(spark, sf))
    out = S.concat_alignment(tagged, "tag")
    return out.select("label", F.length("sequence").cast("long").alias("len"), F.md5("sequence").alias("digest"))


def _diploids(spark, sf):
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"))
    return docs.withColumn("seq_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


@query("diploid_phase_fix")
def diploid_phase_fix(spark, sf):
    return P.diploid_phase_fix(patterns(spark, sf), _diploids(spark, sf))


_DIP = """dip AS (
  SELECT locus, pattern_id, weight, max(col) AS col,
         list(seq_idx ORDER BY seq_idx) FILTER (seq_idx < 3 AND bit_count(CAST(mask AS INTEGER)) = 2) AS hets
  FROM chars GROUP BY 1, 2, 3),
res AS (SELECT *, CAST(unnest(range(CAST(2 ** coalesce(len(hets), 0) AS BIGINT))) AS INTEGER) AS resolution_idx FROM dip),
phased AS (SELECT locus, pattern_id AS site, weight, resolution_idx, string_agg(part, '' ORDER BY i) AS code FROM (
  SELECT r.locus, r.pattern_id, r.weight, r.resolution_idx, i,
    CASE WHEN i = 3 THEN ch
         WHEN k IS NULL OR k = 0 THEN ch || ch
         WHEN (resolution_idx >> CAST(len(hets) - k AS INTEGER)) & 1 = 1 THEN hi || lo ELSE lo || hi END AS part
  FROM (SELECT *, list_position(hets, i) AS k, ch, substr('0123456789abcdef', CAST(m & (-m) AS INTEGER) + 1, 1) AS lo,
               substr('0123456789abcdef', CAST(m & (m - 1) AS INTEGER) + 1, 1) AS hi
        FROM (SELECT res.*, i, substr(col, CAST(i + 1 AS INTEGER), 1) AS ch,
                     CAST(instr('0123456789abcdef', substr(col, CAST(i + 1 AS INTEGER), 1)) - 1 AS INTEGER) AS m
              FROM res, range(4) t(i))) r) GROUP BY 1, 2, 3, 4)"""


@query("diploid_expand", f"WITH {CHARS}, {_DIP} SELECT locus, site, resolution_idx, code, weight FROM phased")
def diploid_expand(spark, sf):
    out = P.diploid_expand(patterns(spark, sf), _diploids(spark, sf), _no_fixes(spark)).columns
    return out.select("locus", "site", F.col("resolution_idx").cast("int").alias("resolution_idx"), F.col("column").alias("code"), "weight")


@query("diploid_expand_counts", f"""WITH {CHARS}, {_DIP}, c AS (SELECT locus, pattern_id AS site, coalesce(len(hets), 0) AS h FROM dip)
    SELECT locus, site, CAST(h AS INTEGER) AS h, 2.0 ** h AS n_columns, sum(2.0 ** h) OVER (PARTITION BY locus) <= 200 AS fits FROM c""")
def diploid_expand_counts(spark, sf):
    """Sites by the columns they become, in loci of up to 200 columns and above."""
    return P.diploid_expand(patterns(spark, sf), _diploids(spark, sf), _no_fixes(spark), most_columns=200).counts


@query("diploid_expand_fitting", f"""WITH {CHARS}, {_DIP} SELECT locus, count(*) AS n, sum(resolution_idx)::BIGINT AS idx FROM phased
    WHERE locus IN (SELECT locus FROM dip GROUP BY 1 HAVING sum(2.0 ** coalesce(len(hets), 0)) <= 200) GROUP BY 1""")
def diploid_expand_fitting(spark, sf):
    """Loci that fit, expanded two bits at a time."""
    out = P.diploid_expand(patterns(spark, sf), _diploids(spark, sf), _no_fixes(spark), most_columns=200, bits=2).columns
    return out.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.sum("resolution_idx").alias("idx"))


def _no_fixes(spark):
    """Nothing fixed: all hets are expanded, which SQL can repeat."""
    return spark.createDataFrame([], "locus long, pattern_id long, seq_idx long")


@query("diploid_phased_patterns")
def diploid_phased_patterns(spark, sf):
    """Fix, expand and recompress; the greedy fixes have no SQL form."""
    pats, dips = cut_lineage(patterns(spark, sf)), _diploids(spark, sf)
    expanded = P.diploid_expand(pats, dips, P.diploid_phase_fix(pats, dips)).columns
    return P.phase_patterns(expanded).select("locus", F.col("column").alias("code"), "pattern_id", "n_columns")


@query(
    "phase_pattern_map",
    f"WITH {CHARS}, {_DIP} SELECT p.locus, p.site, p.resolution_idx, first.s || '.' || first.r AS pattern_id FROM phased p "
    "JOIN (SELECT locus, code, min({'s': site, 'r': resolution_idx}) AS first FROM phased GROUP BY 1, 2) USING (locus, code)",
)
def phase_pattern_map(spark, sf):
    expanded = P.diploid_expand(patterns(spark, sf), _diploids(spark, sf), _no_fixes(spark)).columns
    return P.phase_pattern_map(expanded, P.phase_patterns(expanded)).withColumn("resolution_idx", F.col("resolution_idx").cast("int"))


@query(
    "consensus_genotype",
    f"""WITH {CHARS} SELECT x.locus, CAST(x.seq_idx / 2 AS INTEGER) AS individual, CAST(x.mask | y.mask AS INTEGER) AS mask, CAST(sum(x.weight) AS BIGINT) AS n
    FROM chars x JOIN chars y ON x.locus = y.locus AND x.pattern_id = y.pattern_id AND x.seq_idx % 2 = 0 AND y.seq_idx = x.seq_idx + 1 GROUP BY 1, 2, 3""",
)
def consensus_genotype(spark, sf):
    """Sequences 0 and 1 are the haplotypes of individual 0, sequences 2 and 3 of individual 1."""
    individual = F.floor(F.col("seq_idx") / 2).cast("int").alias("individual")
    coded = A.sequences(spark, sf).select("locus", "seq_idx", individual, states.encode_text(F.col("sequence")).alias("coded"))
    pick = lambda half: coded.filter(F.col("seq_idx") % 2 == half).drop("seq_idx")
    merged = P.consensus_genotype(pick(0), pick(1))
    each = merged.select("locus", "individual", F.explode(F.split("coded", "")).alias("c"))
    counts = each.groupBy("locus", "individual", "c").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("locus", "individual", states.code_mask(F.col("c")).cast("int").alias("mask"), "n")
