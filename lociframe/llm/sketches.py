"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A paragraph's digest enters one cell of each third of a sketch: a count, an XOR of digests and an XOR of checks.  The
cells of two versions subtract; a cell with a single digest left gives it away, and taking it out of its other cells
opens further ones (peeling) until all cells are empty, which lists the differing digests.  If peeling gets stuck, the
sketch is made anew, larger: as sub-sketches, each digest being in one of them, and each that still gets stuck is made
again with twice the cells and other hash functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Cells of a third of the fingerprint, and of a sub-sketch in the first retry.
THIRD, RETRY_THIRD = 4, 8
#: A sub-sketch is made anew with twice the cells, up to so often: two digests share all cells of the last with
#: probability 1e-9, and of all in turn with less than 1e-30.
RETRIES = 8
CHECK = 998_244_353
#: Digests are numbers below 2**DIGEST_BITS.
DIGEST_BITS = 60
ROUNDS = 24
#: A paragraph of more code points is cut after its sentences, and a sentence of more into pieces of so many.
UNIT = 400
#: A sentence with the marks and spaces that end it, or a piece of a longer one.
PIECE = rf"[^.!?。！？]{{0,{UNIT}}}[.!?。！？]{{1,{UNIT}}} ?|[^.!?。！？]{{1,{UNIT}}}"
#: Rows about of one block of neighbours, and pieces of the doc_id range.
ROWS_A_BLOCK, PIECES = 2000, 64


def paragraphs(text: Column) -> Column:
    """Distinct 60-bit digests of a text's non-empty paragraphs (between line feeds), ascending.

    A paragraph longer than UNIT counts as its pieces, so an edit of a text without line feeds changes only some of its
    digests.
    """
    digest = lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")
    cut = lambda p: F.when(F.char_length(p) <= UNIT, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)))
    units = F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), cut))
    return F.sort_array(F.array_distinct(F.transform(units, digest)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cells_of(digest: Column, third_cells: Column, attempt: Column) -> Column:
    """The three cells of a digest, one in each third."""
    modulus = lambda third: (attempt * 34 + (1_000_003 + 10 * third)).cast("long")
    return F.array(*(F.pmod(F.pmod(digest, modulus(t)), third_cells).cast("int") + third_cells * t for t in range(3)))


def _numbers(third_cells: Column) -> Column:
    return F.sequence(F.lit(0), third_cells * 3 - 1)


def sketch(digests: Column, third_cells: Column, attempt: Column) -> Column:
    """Cells (count c, XOR of digests i, XOR of checks k) of a set of digests."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("k"))
    add = lambda x, d: F.struct(
        (x["c"] + 1).alias("c"), x["i"].bitwiseXOR(d["d"]).alias("i"), x["k"].bitwiseXOR(F.pmod(d["d"], F.lit(CHECK))).alias("k")
    )
    placed = F.transform(digests, lambda d: F.struct(d.alias("d"), _cells_of(d, third_cells, attempt).alias("at")))
    cells = lambda ds: F.transform(
        _numbers(third_cells), lambda n: F.aggregate(F.filter(ds, lambda d: F.array_contains(d["at"], n)), zero, add)
    )
    return _once(placed, cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b,
        lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["i"].bitwiseXOR(y["i"]).alias("i"), x["k"].bitwiseXOR(y["k"]).alias("k")),
    )


def peel(cells: Column, third_cells: Column, attempt: Column) -> Column:
    """Number of digests that subtracted cells hold; null if peeling gets stuck."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(state: Column) -> Column:
        single = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["k"] == F.pmod(x["i"], F.lit(CHECK))))
        pure = F.array_distinct(
            F.transform(single, lambda x: F.struct(x["c"].alias("c"), x["i"].alias("i"), _cells_of(x["i"], third_cells, attempt).alias("at")))
        )

        def remove(pure: Column) -> Column:
            def cell(x: Column, n: Column) -> Column:
                return F.aggregate(
                    F.filter(pure, lambda p: F.array_contains(p["at"], n)), x,
                    lambda y, p: F.struct(
                        (y["c"] - p["c"]).alias("c"), y["i"].bitwiseXOR(p["i"]).alias("i"),
                        y["k"].bitwiseXOR(F.pmod(p["i"], F.lit(CHECK))).alias("k"),
                    ),
                )

            return F.struct(
                F.transform(state["cells"], cell).alias("cells"), (state["n"] + F.size(pure)).alias("n"), (F.size(pure) > 0).alias("open")
            )

        return _once(pure, remove)

    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: F.when(state["open"], take(state)).otherwise(state)
    )
    return _once(done, lambda s: F.when(F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["i"] == 0)), s["n"]))


def _below(digests: Column, value: Column) -> Column:
    """How many of the sorted digests are below a value: a binary search."""
    steps = F.sequence(F.ceil(F.log2(F.size(digests) + 1)).cast("int"), F.lit(0), F.lit(-1))
    power = lambda s: F.call_function("shiftleft", F.lit(1), s)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(digests, at + power(s) - 1) < value, at + power(s)).otherwise(at))


def differing(a: Column, b: Column, base: Column) -> Column:
    """Number of digests in one of the sorted sets ``a`` and ``b`` only; ``base`` is their subtracted fingerprints.

    If these don't peel, the digests are cut by their leading bits into ranges of at most about half as many digests
    as a sub-sketch has cells.  A range that doesn't peel is made anew, larger, alone; work grows with n log n.
    """
    first = peel(base, F.lit(THIRD), F.lit(0))
    bits = F.greatest(F.ceil(F.log2((F.size(a) + F.size(b) + 1) / (1.5 * RETRY_THIRD))), F.lit(0)).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(DIGEST_BITS) - bits)

    def part(p: Column) -> Column:
        def mine(digests: Column) -> Column:
            ends = F.struct(_below(digests, width * p).alias("lo"), _below(digests, width * (p + 1)).alias("hi"))
            return F.when(bits == 0, digests).otherwise(_once(ends, lambda x: F.slice(digests, x["lo"] + 1, x["hi"] - x["lo"])))

        def attempt(sets: Column, third: Column) -> Column:
            cells = subtract(sketch(sets["a"], third, third), sketch(sets["b"], third, third))
            return F.coalesce(peel(cells, third, third), F.lit(-1))

        thirds = F.array(*(F.lit(RETRY_THIRD << r) for r in range(RETRIES)))
        tries = lambda sets: F.aggregate(
            thirds, F.lit(-1), lambda n, third: F.when(n >= 0, n).otherwise(attempt(sets, third))
        )
        return _once(F.struct(mine(a).alias("a"), mine(b).alias("b")), tries)

    each = F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), bits) - 1), part)
    stuck = F.raise_error(F.lit("a sub-sketch did not peel")).cast("int")
    retried = F.aggregate(each, F.lit(0), lambda total, n: F.when(n < 0, stuck).otherwise(total + n))
    return F.coalesce(first, retried)


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Share of common digests among all of two sets with so many differing ones; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def written(cells: Column) -> Column:
    """A sketch as text: counts, digests and checks in hexadecimal, cell by cell."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["c"].cast("string"), F.hex(x["i"]), F.hex(x["k"]))), " ")


def with_next(df: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the next document's next_text in descending order of doc_id, the first after the
    last.  Rows of one doc_id are ordered by a digest of the text.

    Rows are dealt into blocks of neighbouring doc_ids: PIECES pieces with equal numbers of rows, each cut into equal
    widths.  The last row of each block is also dealt to the following block, so each block is one small window.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    n, bounds = rows.agg(
        F.count("*"), F.percentile_approx("doc_id", [i / PIECES for i in range(PIECES + 1)], 10_000)
    ).collect()[0]
    bounds = sorted(set(bounds or []))
    cuts = max(1, -(-n // (PIECES * ROWS_A_BLOCK)))
    piece = F.lit(-1)  # null and any doc_id below the first bound
    for i, (lo, hi) in enumerate(zip(bounds, [*bounds[1:], bounds[-1] + 1 if bounds else 0])):
        inside = F.least(F.floor((F.col("doc_id") - lo) * cuts / (hi - lo)), F.lit(cuts - 1))
        piece = F.when(F.col("doc_id") >= lo, F.lit(i * cuts) + inside).otherwise(piece)
    rows = rows.withColumn("block", piece.cast("long"))
    ends = rows.groupBy("block").agg(F.max(F.struct("doc_id", "tie")).alias("end"))
    order = Window.orderBy("block")
    following = F.coalesce(F.lead("block").over(order), F.min("block").over(Window.partitionBy()))
    ends = stored(ends.select("end.*", following.alias("to")), "ends")
    edge = rows.alias("r").join(ends.alias("e"), F.expr("r.doc_id <=> e.doc_id AND r.tie = e.tie"))
    edge = edge.select("r.doc_id", "r.text", "r.tie", F.col("e.to").alias("block"), F.lit(0).alias("own"))
    window = Window.partitionBy("block").orderBy("own", "doc_id", "tie")
    return (
        rows.withColumn("own", F.lit(1)).unionByName(edge).withColumn("next_text", F.lag("text").over(window))
        .where("own = 1").select("doc_id", "text", "next_text")
    )


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``df``
    (doc_id, text).

    The edited text is the text whose last half (rounded down) is replaced by as much of the start of the next
    document in descending order of doc_id (after the last: the first, which for a single row is itself).
    Likeness is that of the sets of paragraphs (long ones: of their pieces), from the digests that peeling lists.  Null texts are empty; an empty text has
    an empty fingerprint, like another empty one (1.0).  A null doc_id comes last.  Equal texts have equal fingerprints; other columns are
    not read.
    """
    rows = with_next(df).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"),
        paragraphs(F.col("edited")).alias("e"), paragraphs(F.col("next_text")).alias("x"),
    )
    rows = rows.select("*", *(sketch(F.col(c), F.lit(THIRD), F.lit(0)).alias(f"s{c}") for c in "aex"))
    rows = rows.select("*", *(differing(F.col("a"), F.col(c), subtract(F.col("sa"), F.col(f"s{c}"))).alias(f"d{c}") for c in "ex"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"), written(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("de")).alias("near_edited"), likeness(F.col("a"), F.col("x"), F.col("dx")).alias("near_next"),
    )
