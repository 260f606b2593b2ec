"""Line dedup by a deletion-neighbourhood join over words, with DataFrame functions only.

The edit bound is one word: inserted, deleted or replaced.  Every variant of a line with one word deleted becomes a
hashed key.  Lines whose variants are equal and lack the word at the same place differ in that one word; a line equal
to another's variant lacks one word of it.  Lines meet in the aggregate of a key, not in pairs: each line learns the
earliest line of its keys, and that one pair is verified on the words.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, words

#: Lines with fewer words are compared for equality only.
LEAST_WORDS = 8
#: Tables of at most so many rows (under 50 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def lines_of(df: DataFrame) -> DataFrame:
    """place (doc_id, text_key, line_no from 0), line, h1 and h2 (digests of the line) of all lines with a word."""
    exploded = df.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select(
        F.struct("doc_id", "text_key", "line_no").alias("place"), "line",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),  # another seed, not a hash of the first
    )


def _spaced(line: Column) -> Column:
    """The words of a line, one space between them."""
    plain = F.regexp_replace(line, SPACE, " ")
    other = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for odd in ("  ", "\t", "\x0b", "\x0c", "\r"):  # searched for one by one, which costs less than a regular expression
        other = other | F.contains(line, F.lit(odd))
    return F.when(other, F.btrim(plain)).otherwise(line)


def _reach(n: Column) -> Column:
    """The largest power of 2 up to n / 2."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / 2))).cast("int")


def _ends(spaced: Column, n: Column) -> Column:
    """Digests of the first and of the last k words of a line of n words; k is the largest power of 2 up to n / 2.

    An edit of one word leaves the first k words or the last k words as they were, also those of the other line.
    Where n - 1 words have another k, there are digests for that one too.
    """
    cut = partial(F.call_function, "substring_index")
    ends = lambda k: [
        F.xxhash64(F.lit("head"), k, cut(spaced, F.lit(" "), k)), F.xxhash64(F.lit("tail"), k, cut(spaced, F.lit(" "), -k))
    ]
    k, less = _reach(n), _reach(n - 1)
    return F.when(n >= LEAST_WORDS, F.when(k == less, F.array(*ends(k))).otherwise(F.array(*ends(k), *ends(less))))


def distinct_lines(df: DataFrame) -> DataFrame:
    """h1, h2, first (the earliest place), n, ends of each distinct line.  Stored."""
    rows = lines_of(df).select("h1", "h2", "place", _spaced(F.col("line")).alias("spaced"))
    n = F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.lit(" "), F.lit(""))) + 1
    rows = rows.withColumn("words", n).select("h1", "h2", "place", _ends(F.col("spaced"), F.col("words")).alias("ends"))
    return stored(
        rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("ends").alias("ends")), "lines"
    )


def _checked(small: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows; a larger one is left to a shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _without(w: Column, at: Column) -> Column:
    """The words but the one at a place; all of them at -1."""
    return F.when(at < 0, w).otherwise(F.concat(F.slice(w, F.lit(1), at), F.slice(w, at + 2, F.size(w))))


def near_lines(df: DataFrame, distinct: DataFrame) -> DataFrame:
    """first of the distinct lines that have an earlier line within the bound.

    Lines that share an end with no other have none and are left out; where only the head is shared, words of the head
    need not be deleted, and likewise for the tail.
    """
    ends = distinct.where("ends IS NOT NULL").select("first", F.posexplode("ends").alias("which", "end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select("end")
    is_head = F.col("which") % 2 == 0
    asked = ends.join(shared, "end").groupBy("first").agg(F.max(is_head).alias("head"), F.max(~is_head).alias("tail"))
    lines = lines_of(df).join(_checked(stored(asked, "asked")), F.col("place") == F.col("first"))
    met = stored(lines.select("first", "head", "tail", words(F.col("line")).alias("w")).distinct(), "met")
    each = met.select("first", "head", "tail", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    for k in (1, 2):
        each = each.withColumn(f"here{k}", F.xxhash64("word", "i", F.lit(k))).withColumn(
            f"moved{k}", F.xxhash64("word", F.col("i") - 1, F.lit(k))
        )
    line = Window.partitionBy("first")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    to_here = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    key = [
        F.coalesce(F.bit_xor(f"here{k}").over(before), zero)
        .bitwiseXOR(F.bit_xor(f"moved{k}").over(to_here))
        .bitwiseXOR(F.bit_xor(f"moved{k}").over(line))
        for k in (1, 2)
    ]
    whole = [F.bit_xor(f"here{k}").over(line) for k in (1, 2)]
    beyond = (F.col("head") & (F.col("i") >= _reach(F.col("n") - 1))) | (F.col("tail") & (F.col("i") < F.col("n") - _reach(F.col("n") - 1)))
    keyed = each.select(
        "first", "i", beyond.alias("beyond"),
        F.struct(key[0].alias("k1"), F.xxhash64(key[1], F.col("n") - 1).alias("k2"), F.col("i").alias("at")).alias("variant"),
        F.struct(whole[0].alias("k1"), F.xxhash64(whole[1], "n").alias("k2"), F.lit(-1).alias("at")).alias("whole"),
    )
    both = F.filter(F.array(F.when(F.col("beyond"), F.col("variant")), F.when(F.col("i") == 0, F.col("whole"))), lambda v: v.isNotNull())
    rows = stored(keyed.select("first", F.explode(both).alias("v")).select("first", "v.*"), "variants")
    groups = rows.groupBy("k1", "k2", "at").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    variant = Window.partitionBy("k1", "k2")
    least = F.struct(F.col("least").alias("first"), "at")
    entire = F.min(F.when(F.col("at") < 0, least)).over(variant)
    shorter = F.min(F.when(F.col("at") >= 0, least)).over(variant)
    met_at = groups.select("k1", "k2", "at", "members", least.alias("least"), entire.alias("entire"), shorter.alias("shorter"))
    met_at = met_at.where("members > 1 OR (entire IS NOT NULL AND shorter IS NOT NULL)").select(
        "k1", "k2", "at", F.when(F.col("at") < 0, F.col("shorter")).otherwise(F.least("least", "entire")).alias("earliest")
    )
    pairs = (
        rows.join(met_at, ["k1", "k2", "at"]).where("earliest.first < first")
        .groupBy("first").agg(F.min(F.struct("earliest", "at")).alias("m"))
        .select("first", F.col("m.at").alias("at"), F.col("m.earliest.first").alias("other"), F.col("m.earliest.at").alias("other_at"))
    )
    own = met.select("first", F.col("w").alias("own"))
    other = met.select(F.col("first").alias("other"), F.col("w").alias("other_w"))
    same = _without(F.col("own"), F.col("at")) == _without(F.col("other_w"), F.col("other_at"))
    return pairs.join(own, "first").join(other, "other").where(same).select("first")


def drop_repeated_lines(df: DataFrame) -> DataFrame:
    """All rows of ``df`` (doc_id, text, and any columns) with ``text`` less its repeated lines, and ``lines_dropped``,
    the numbers (from 0) of the lines that are gone, null if none.

    A line, text between line feeds, goes if the same line or, from LEAST_WORDS words on, one within one word of it
    comes earlier: in a document of smaller doc_id (ties by a digest of the text) or higher up in its own.  An
    earlier line counts even if it goes itself.  White space between words is no difference in the second case.
    Lines without words stay, so null and empty texts do too; rows that repeat doc_id and text lose the same lines.
    A column named lines_dropped is replaced.
    """
    distinct = distinct_lines(df)
    near = near_lines(df, distinct).withColumn("near", F.lit(True))
    repeated = stored(
        distinct.join(near, "first", "left").where("n > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "repeated",
    )
    gone = stored(
        lines_of(df).drop("line").join(_checked(repeated), ["h1", "h2"]).where(F.col("near") | (F.col("place") != F.col("first")))
        .groupBy("place.doc_id", "place.text_key").agg(F.sort_array(F.collect_set("place.line_no")).alias("gone")),
        "gone",
    )
    d, g = df.drop("lines_dropped").withColumn("_text_key", F.xxhash64("text")).alias("d"), _checked(gone).alias("g")
    joined = d.join(g, F.expr("d.doc_id <=> g.doc_id AND d._text_key = g.text_key"), "left")
    dropped = F.col("g.gone")
    step = lambda x, k: F.concat(
        F.array_repeat(F.lit(False), (x - F.when(k > 0, F.get(dropped, k - 1)).otherwise(-1) - 1).cast("int")), F.array(F.lit(True))
    )
    joined = joined.withColumn("_mask", F.flatten(F.transform(dropped, step)))
    kept = F.filter(F.split("d.text", "\n"), lambda _, i: ~F.coalesce(F.get(F.col("_mask"), i), F.lit(False)))
    text = F.when(dropped.isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in df.columns if c != "lines_dropped"]
    return joined.select(*columns, dropped.alias("lines_dropped"))
