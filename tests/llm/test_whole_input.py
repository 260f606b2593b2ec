"""Rows that once fell out: null and repeated doc_ids."""

import corpus_pipeline
from lociframe.llm import neardup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def near(text):
    """A text at a similarity of 51/61 to ``text`` of 60 words."""
    return text.rsplit(" ", 5)[0] + " so it ends otherwise now"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [(None, prose(s)) for s in range(5)] + [(7, prose(10)), (7, prose(11))]  # no near copies
    rows += [(3, prose(20)), (8, near(prose(20))), (8, prose(21))]  # 8 has a rejected and a clean row
    rows += [(None, prose(30)), (None, near(prose(30)))]  # one group without doc_id
    rows += [(9, prose(40)), (9, near(prose(40)))]  # one group, one doc_id
    rows += [(4, prose(50)), (4, prose(50))]  # equal rows
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    got = sorted(((r.doc_id, r.text) for r in out), key=repr)
    free = [(None, prose(s)) for s in range(5)] + [(7, prose(10)), (7, prose(11)), (3, prose(20)), (8, prose(21)), (4, prose(50))]
    rest = [r for r in got if r not in free]
    assert sorted((r for r in got if r in free), key=repr) == sorted(free, key=repr)
    assert len(rest) == 2 and {r[1].split("x")[0] for r in rest} == {"w30", "w40"}


def test_null_doc_id_beside_an_equal_and_a_near_copy(spark):
    text = prose(1)
    rows = [(None, text), (7, text), (9, near(text)), (None, prose(2)), (None, near(prose(2))), (5, near(prose(2)))]
    rows += [(None, prose(3)), (None, near(prose(3)))]
    out = neardup.near_duplicates(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=repr)
    expected = [(None, 7, False), (7, 7, True), (9, 7, False), (None, 5, False), (None, 5, False), (5, 5, True)]
    expected += [(None, None, True), (None, None, False)]
    assert got == sorted(expected, key=repr)
