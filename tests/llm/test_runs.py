"""Periodic runs against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import queries, runs

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_runs string, start string, runs_sha256 string"


def by_definition(words, least=12):
    """(start, length, period), from comparing all words of each distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def answer(words):
    found = by_definition(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def repeats(seed):
    """Texts of repeated units, cut anywhere."""
    r = random.Random(seed)
    out = []
    for _ in range(r.randint(1, 6)):
        unit = [str(r.randrange(r.choice([1, 2, 5]))).encode() for _ in range(r.randint(1, 15))]
        out += [unit[i % len(unit)] for i in range(r.randint(1, 45))]
    return out


@given(st.integers(0, 10**9), st.sampled_from([2, 4, 7, 12]))
@settings(max_examples=400, deadline=None)
def test_runs_of_random_texts(seed, least):
    words = repeats(seed)
    want = by_definition(words, least)
    assert runs.find_runs([words, words[::-1], []], least) == [want, by_definition(words[::-1], least), []]
    ids = np.unique(np.array(words), return_inverse=True)[1]
    assert sorted(runs.grammar_runs(ids, least), key=lambda r: (r[0], r[2])) == want  # without the cut as well


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    assert runs.find_runs([b])[0] == by_definition(b)


@given(st.lists(st.integers(0, 3), max_size=80))
@settings(max_examples=200, deadline=None)
def test_grammar_gives_back_the_text(ids):
    rest, rules = runs.re_pair(ids, 10)
    spell = lambda s: [s] if s < 10 else spell(rules[s - 10][0]) + spell(rules[s - 10][1])
    assert [i for s in rest for i in spell(s)] == ids
    places, last = {}, {}
    for i, pair in enumerate(zip(rest, rest[1:])):  # no pair is left that stands at two places side by side
        if last.get(pair, -2) != i - 1 or pair[0] != pair[1]:
            places[pair] = places.get(pair, 0) + 1
            last[pair] = i
    assert all(n < 2 for n in places.values())


def test_awkward_rows(spark):
    line = " ".join("a b c d e".split() * 9)
    texts = [None, "", " \t\n ", "one", line, line, "x " * 50_000, "  \x85" * 20, "é\U0001f600\n" * 14]
    rows = [(i if i else None, t, "n", "s", "r") for i, t in enumerate(texts)]
    got = runs.periodic_runs(spark.createDataFrame(rows + rows[4:5], SCHEMA).repartition(3), with_runs=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = (texts[r.doc_id or 0] or "").encode().split()
        if len(words) < 1000:
            assert tuple(r)[1:8] == answer(words)
        else:
            assert tuple(r)[1:5] == (1, 0, 50_000, 1) and r.collapsed == "x"
        assert [(x.start, x.length, x.period) for x in r.runs] == by_definition(words) if len(words) < 1000 else True
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, DATA).collect()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(documents)
    found = 0
    for r in documents:
        words = (r.text or "").encode().split()
        number = zlib.crc32(str(r.doc_id).encode())
        g, n = number // 10, len(words)
        if number % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 3000:
            assert got[r.doc_id] == answer(words), r.doc_id
            found += got[r.doc_id][0]
    assert found


def test_tails_of_awkward_documents(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    texts = dict(zip(ids, (None, "", "w", "a b c d e f g h")))
    rows = [(i, t) for i, t in texts.items()] + [(None, "a b c")]
    got = {r.doc_id: r.text for r in queries.repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == "a b c" and got[ids[0]] is None and got[ids[1]] == "" and got[ids[2]] == "w"
    number = zlib.crc32(str(ids[3]).encode()) // 10
    a = number % 8
    p = 1 + (8 - a) // (3 + number % 8)
    words = "a b c d e f g h".split()
    assert got[ids[3]] == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(8))


@pytest.mark.parametrize("texts", [[], [[]], [[b"a"] * 11]])
def test_nothing_to_find(texts):
    assert runs.find_runs(texts) == [[] for _ in texts]
