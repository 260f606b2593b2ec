"""The operators against SQL, brute force and awkward input."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm import ann, bpe, context_tree, language, lines, mixing, neardup, pages, queries, sharding, sketches

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines_dropped string, size string, shard string, score string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall old trees near the river bank at dusk"


def frame(spark, texts, sources=("a",)):
    """Documents with columns that clash with the operators' own."""
    rows = [(i, t, "en", sources[i % len(sources)], 0, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \n\t ", PROSE, PROSE, PROSE.upper(), "A b", "x" * 70_000, PROSE + "\n" + PROSE + " today", "é\U0001f600 1\x85"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = frame(spark, AWKWARD, ("a", None, "b"))
    return rows.union(rows.where("doc_id = 3")).union(rows.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(map(cell, r)) for r in df.select(columns).collect()), key=repr)
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = sorted((tuple(map(cell, r)) for r in con.execute(f"SELECT {listed} FROM ({queries.ORACLES[name]})").fetchall()), key=repr)
    assert got == expected


def everything(df):
    held = F.col("doc_id") % 5 == 1
    words = queries.vocabulary()
    filters = language.learn(df)
    return [
        lines.drop_repeated_lines(df), bpe.decode(bpe.encode(df, words), words), neardup.near_duplicates(df), mixing.mix(df), sharding.shard(df),
        language.identify(df, filters), language.accept(df, filters), sketches.fingerprints(df), context_tree.score(df, held),
    ]


def test_empty_tables(spark, nothing):
    for out in everything(nothing):
        assert out.collect() == []
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).collect() == []


def test_awkward_rows_all_come_back(awkward):
    outs = everything(awkward)
    for out in [*outs[:6], *outs[7:]]:
        assert out.count() == 12


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in docs.collect()} <= {3, 6, 7, 9}
    assert corpus_pipeline.tokenize(spark, docs, DATA).count() == docs.count()


# line dedup


def test_lines(spark):
    words = PROSE.split()
    gone = lambda *texts: [r.lines_dropped for r in lines.drop_repeated_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    changed, shorter = " ".join(["a", *words[1:]]), " ".join(words[:5] + words[6:])
    two = " ".join(["a", *words[1:-1], "dawn"])
    assert gone(PROSE, changed, shorter, PROSE.replace(" ", "  "), two) == [None, [0], [0], [0], [0]]
    assert gone(PROSE, two, "a b c\nx\na b c", "a b d\n\n") == [None, None, [2], None]
    assert gone(PROSE, " ".join([*words[1:], "new"])) == [None, None]  # one word gone and one added


# byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return queries.vocabulary().codec()


@pytest.fixture(scope="module")
def encoding(codec):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_tiktoken(spark, codec, encoding):
    r = random.Random(3)
    texts = [t for (t,) in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice(a) for _ in range(r.randrange(300))) for a in ("ab", "aAbB '\n\t1sre", "é中 ١x\U0001f600", " \x1c\x85\xa0x") for _ in range(50)]
    texts += ["ab" * 50_000, "<|endoftext|>", ""]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_query(spark, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for row in queries.op3_byte_bpe(spark, DATA).collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


# near duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicate_groups(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # many block pairs
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up = [up[j] if u == up[i] else u for u in up]
    least = {u: min(i for i in range(60) if up[i] == u) for u in up}
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, texts), percent).collect()}
    assert got == {i: least[up[i]] for i in range(60)}


def test_keys_meet_within_the_distance():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 65536, neardup.SYMBOLS).astype("<u2")
        b = a.copy()
        at = r.choice(neardup.SYMBOLS, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)
        b[at] ^= np.uint16(1)
        keys = neardup.chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


# mixing, sharding


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["c"] == 270 and got["b"] == 800


def test_mix_is_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - t) <= 0.2 * t + 2000 for s, t in target.items())


def test_difference_balances():
    r = random.Random(1)
    sizes = [r.randrange(1, 10**6) for _ in range(500)]
    sums = Counter()
    for size, part in zip(sizes, sharding.difference(sizes, 7)):
        sums[part] += size
    assert len(sums) == 7 and max(sums.values()) - min(sums.values()) < 5000
    assert sharding.difference([5], 3) in ([0], [1], [2]) and sharding.difference([], 3) == []


def test_shards(spark, awkward):
    rows = sharding.shard(awkward, 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    text = {i: t or "" for i, t in enumerate(AWKWARD)} | {None: ""}
    place = {}
    for r in rows:
        assert place.setdefault(text[r.doc_id], r.shard) == r.shard
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()))


# language ID, language model


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in queries.op8_language(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
    found = language.identify(frame(spark, [None, "", "12 !?", "zzz"]), language.learn(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and found[3].lang_pred in set(truth.values())


def test_filters_know_what_they_hold():
    entries = [(x, g) for x, lo in (("a", 0), ("b", 500)) for g in range(lo, lo + 1000)]
    filters = language.build(entries, ["a", "b"])
    masks = filters.masks(np.arange(1500))[:, 0]
    assert np.all(masks[:1000] & np.uint64(1)) and np.all(masks[500:] & np.uint64(2))
    assert filters.false_rate.max() < 0.01


def test_context_tree_predictions(spark):
    """A bit's cost is the ratio of the weighted probabilities of its tree with and without the bit."""
    depth = 2
    train = np.concatenate([context_tree.strings([t], depth)[0] for t in (b"abab c\n", b"abba\n")])
    codes, n = np.unique(train, return_counts=True)
    table = {**dict.fromkeys(context_tree.strings([b"bcab\n"], depth)[0].tolist(), 0), **dict(zip(codes.tolist(), n.tolist()))}
    costs = context_tree.string_costs(spark.createDataFrame(list(table.items()), "code long, n long"), depth)

    def path(code):
        before = code.to_bytes(depth + 1, "big")
        byte, prefix = before[-1], 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield prefix, [before[:d] for d in range(depth + 1)], bit
            prefix = prefix << 1 | bit

    def add(nodes, code, times=1):
        for prefix, contexts, bit in path(code):
            for context in contexts:
                nodes.setdefault((prefix, context), [0, 0])[bit] += times

    def weight(nodes, prefix, context):
        own = float(context_tree.log_kt(*(np.array(float(x)) for x in nodes[prefix, context])))
        if len(context) == depth:
            return own
        below = sum(weight(nodes, p, c) for p, c in nodes if p == prefix and len(c) == len(context) + 1 and c[:-1] == context)
        return float(np.logaddexp(own, below) - np.log(2))

    nodes = {}
    for code, times in table.items():
        add(nodes, code, times)
    for row in costs.collect():
        cost = 0.0
        for prefix, contexts, bit in path(row.code):
            more = {k: list(v) for k, v in nodes.items()}
            for context in contexts:
                more[prefix, context][bit] += 1
            cost += weight(more, prefix, b"") - weight(nodes, prefix, b"")
        assert row.cost == pytest.approx(cost / np.log(10), abs=1e-6)


def test_scores_without_a_broadcast_are_the_same(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    some, none = (
        {r.doc_id: r.score for r in context_tree.score(df, F.col("doc_id") % 5 == 1, depth=3, broadcast_strings=n).collect()} for n in (10**6, 0)
    )
    assert some == pytest.approx(none)


@pytest.mark.parametrize("held", ["doc_id % 5 = 1", "true"])
def test_only_rare_strings_leave_the_broadcast(spark, monkeypatch, held):
    """With more strings than are broadcast, the most used ones still are: of a text only its rare ones are shuffled."""
    kept = {}
    keep = lambda df, name: kept.setdefault(name, context_stored(df, name))
    context_stored = context_tree.stored
    df = spark.createDataFrame([(i, "the same words again and again " * 40 + f"item {i * 7919}") for i in range(30)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in context_tree.score(df, F.expr(held)).collect()}
    monkeypatch.setattr(context_tree, "stored", keep)
    part = {r.doc_id: r.score for r in context_tree.score(df, F.expr(held), broadcast_strings=60).collect()}
    assert part == pytest.approx(whole)
    listed = [len(r.strings) for r in kept["scored"].collect()]
    assert 0 < max(listed) < 25  # about 40 strings of each text are those of all texts


def test_base_score(spark):
    rows = {r.doc_id: r for r in queries.op10_context_tree(spark, DATA).collect()}
    docs = {r.doc_id: context_tree.tokens(r.text) + [b""] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in docs.items():
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert rows[i].base_score == pytest.approx(base) and rows[i].n_tokens == len(ws)
        assert rows[i].n_known == sum(counts[w] > 0 for w in ws) and rows[i].train_tokens == total


# fingerprints


def test_fingerprints_of_long_documents(spark):
    r = random.Random(2)
    texts = ["\n".join(f"paragraph {r.randrange(400)}" for _ in range(300)) for _ in range(4)]
    likeness = lambda a, b: len(a & b) / len(a | b)
    rows = sketches.fingerprints(frame(spark, texts)).orderBy("doc_id").collect()
    for i, row in enumerate(rows):
        assert row.near_next == pytest.approx(likeness(set(texts[i].split("\n")), set(texts[i - 1].split("\n"))))
    one = sketches.fingerprints(frame(spark, ["abc"])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def test_fingerprints_of_a_thousand_and_more_paragraphs(spark):
    """Every range of digests must peel: with thousands of them some don't at first."""
    r = random.Random(3)
    common = [f"common {r.randrange(10**9)}" for _ in range(500)]
    texts = ["\n".join(common + [f"own {r.randrange(10**9)}" for _ in range(2500)]) for _ in range(2)]
    sets = [set(t.split("\n")) for t in texts]
    rows = sketches.fingerprints(frame(spark, texts)).collect()
    assert [x.near_next for x in rows] == [pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))] * 2


def units(text):
    """The paragraphs of a text, long ones cut after sentences and every 400 characters, by a scan."""
    out = set()
    for p in text.split("\n"):
        if len(p) <= 400:
            out |= {p} - {""}
            continue
        at = 0
        while at < len(p):
            end = at
            while end < len(p) and end - at < 400 and p[end] not in ".!?。！？":
                end += 1
            marks = end
            while marks < len(p) and marks - end < 400 and p[marks] in ".!?。！？":
                marks += 1
            if marks > end and marks < len(p) and p[marks] == " ":
                marks += 1
            out.add(p[at:marks])
            at = marks
    return out


def test_fingerprints_of_texts_without_line_feeds(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(3, 12))) + r.choice([". ", "! ", "?", "... ", "。"])
    texts = ["".join(sentence() for _ in range(60)), " ".join(word() for _ in range(900)), "x" * 400, "x" * 401, "." * 2000, "\U0001f600" * 900 + "! a"]
    rows = sketches.fingerprints(frame(spark, texts)).orderBy("doc_id").collect()
    for i, row in enumerate(rows):
        n, nxt = len(texts[i]), texts[i - 1]
        a, e, x = units(texts[i]), units(texts[i][: n - n // 2] + nxt[: n // 2]), units(nxt)
        assert row.near_edited == pytest.approx(len(a & e) / len(a | e))
        assert row.near_next == pytest.approx(len(a & x) / len(a | x))
    # the half that stays is found again, with sentence ends and without them
    assert rows[0].near_edited > 0.2 and rows[1].near_edited > 0


# nearest neighbours


def test_neighbours_of_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (7, [0.0, 1.0]), (9, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 50).orderBy("rank", "vec_id", "score").collect()]
    # [1, 0] finds [2] (cosine 1), then its namesake; [1, 0.1] finds [1, 0] and [2] at one distance: the smaller id first
    assert got == [(1, 9), (1, 9), (2, 50), (2, 50), (3, 7), (3, 7)]


def test_neighbours(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(600, 16))
    vectors[100:200] = vectors[100]  # ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(1000, None, "x"), (1050, [0.0] * 16, "x"), (1100, [float("nan")] * 16, "x"), (1150, [None] * 16, "x"), (1200, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for row in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        best = np.lexsort((np.arange(600), -near))[:5]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(s == pytest.approx(unit[q] @ unit[i]) for i, s in got[q])
    # a vector of another length takes part, as if it ended in zeros
    first = unit @ np.eye(16)[0]
    assert got.pop(1200)[0][1] == pytest.approx(first.max())
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]


def test_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    unit = ann.unit(np.array([r.embedding for r in rows], float))
    got = {(r.query_id, r.vec_id) for r in queries.op1_nearest_neighbours(spark, DATA).collect()}
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -9
        hits += sum((ids[q], i) in got for i in ids[np.lexsort((ids, -near))[:5]])
    assert hits >= 0.9 * 5 * np.sum(ids % 50 == 0)


# main text


def test_main_text():
    body = "".join(f"<p>Sentence {i}, with some words in it &amp; more. Another one follows here, calmly.</p>" for i in range(6))
    source = (
        "<html><head><title>T</title><script>if (a < b) '</p>'</script></head><body><!-- <p>no</p> --><nav><a href='x'>Home</a></nav>"
        f"<div class='ad'>Buy this, now!</div><div id=main><h1>Head</h1>{body}<form><input><button>Send</button></form>"
        "<div class=\"comments\"><p>A reader says, well, no.</p></div></div><footer>&copy; me, 2020.</footer></body></html>"
    )
    text = pages.main_text(source)
    assert text.startswith("Head Sentence 0, with some words in it & more.") and text.endswith("Another one follows here, calmly.")
    assert "Buy" not in text and "reader" not in text and "Send" not in text
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""
    assert pages.main_text("<" * 2000 + "a" * 10) is not None
    assert pages.main_text("<div>" * 20_000 + "deep text, here.") == "deep text, here."


def test_pages_query(spark):
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for row in queries.op4_main_text(spark, DATA).collect():
        article = re.search("<article>(.*?)</article>", sources[row.page_id], re.S)[1]
        plain = " ".join(re.sub(r"</?(\w+)[^>]*>", lambda m: "" if m[1] == "b" else " ", article).split())
        plain = html.unescape(plain)
        assert row.text == plain and row.n_chars == len(plain)
