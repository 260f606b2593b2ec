"""Token id files: round trips, select, and the query against the tokenizers library."""

import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociframe.llm import idfiles, queries

DATA = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**40), st.just(0)), max_size=700))
@settings(max_examples=150, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.uint64), dtype=np.uint64)
    code, end = idfiles.EliasFano.load(memoryview(b"xx" + idfiles.EliasFano.encode(values).dump()), 2)
    assert end == 2 + len(idfiles.EliasFano.encode(values).dump())
    assert code.values().tolist() == values.tolist()
    assert [code[i] for i in range(0, len(values), 7)] == values[::7].tolist()
    with pytest.raises(IndexError):
        code[len(values)]


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(idfiles.EliasFano.encode(ends).dump()) * 8 / len(ends) < 2 + np.log2(1000) + 1


def test_far_apart_numbers():
    code = idfiles.EliasFano.encode(np.array([0, 1, 2**63], np.uint64))
    assert code.values().tolist() == [0, 1, 2**63] and code[2] == 2**63


@pytest.mark.parametrize("largest,width", [(65535, 2), (65536, 4)])
def test_file(largest, width):
    ids = [np.array(x, np.uint32) for x in ([1, 0], [0], [largest, 3, 0], [], [7, 0])]
    file = idfiles.IdFile(idfiles.pack([None, None, -5, -5, 2**62], ids))
    assert file.width == width
    assert [file.doc_id(i) for i in range(5)] == [None, None, -5, -5, 2**62]
    assert [file.ids(i).tolist() for i in range(5)] == [x.tolist() for x in ids]
    batches = [b for b in file.batches(100, most=2)]
    assert [s for b in batches for s in b.column(1).to_pylist()] == [100, 102, 103, 106, 106]
    with pytest.raises(ValueError):
        idfiles.IdFile(b"x" * 64)


def test_awkward_documents(spark, tmp_path):
    texts = [None, "", "a", "b" * 50_000, "a", "é  \n x"]
    rows = [(i, t, "x", "x") for i, t in enumerate(texts)] + [(None, "z", "x", "x"), (2, "a", "x", "x"), (2, "c", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start string").repartition(3)
    idfiles.write(df, str(tmp_path / "ids"), FILE, end_id=7, bytes_a_task=10_000)
    got = idfiles.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 2, 2, 3, 4, 5]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    whole = Tokenizer.from_file(FILE)
    want = sorted((i or -1, [*whole.encode(t or "", add_special_tokens=False).ids, 7]) for i, t, _, _ in rows)
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    with pytest.raises(Exception, match="has token ids already"):
        idfiles.write(df, str(tmp_path / "ids"), FILE)
    idfiles.write(df.limit(0), str(tmp_path / "none"), FILE)
    assert idfiles.read(spark, str(tmp_path / "none")).collect() == []


def test_given_ids_small_files_and_files_of_lost_attempts(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.dataSource.register(idfiles.TokenIds)
    ids = F.unhex(F.expr("repeat('01000000', 1 + int(id) % 3)"))
    df = spark.range(40).repartitionByRange(2, "id").sortWithinPartitions("id").select(F.col("id").alias("doc_id"), ids.alias("ids"))
    out = df.write.format("token_ids").option("path", path)
    out.option("ids_a_file", "9").option("documents_a_file", "4").mode("append").save()
    listed = json.loads((Path(path) / "manifest.json").read_text())
    assert len(listed) >= 10 and max(entry["documents"] for entry in listed) <= 4 and max(entry["ids"] for entry in listed) <= 9
    (Path(path) / "000000-00000-lost.ids").write_bytes(b"half a file")
    got = idfiles.read(spark, f"file://{path}").orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(40))
    assert [r.start for r in got] == [sum(1 + k % 3 for k in range(i)) for i in range(40)]


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000a'sé1.<|"), st.characters(codec="utf-8")), max_size=40), max_size=4))
@settings(max_examples=500, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    texts += ["".join(f"{t}<|endoftext|> \n" for t in texts), "it's  \n\n  we'll", "a" * 100 + " b"]
    pieces = idfiles._pieces(FILE).encode
    whole = Tokenizer.from_file(FILE)
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded():
    pieces = idfiles.Pieces(FILE, most=40)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) + "  " * (i % 2) + " " + "y" * 70 for i in range(20)]
    assert [pieces.encode([t]) for t in texts + texts[:3]] == [[x] for x in idfiles.Pieces(FILE).encode(texts + texts[:3])]
    assert len(pieces.known) <= 40 and " " + "y" * 70 not in pieces.known


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    file = public_tokenizers.path(name)
    texts = ["Two  words", "\n One\nmore, it's ", ""]
    whole = Tokenizer.from_file(file)
    assert not idfiles.Pieces(file).cuts
    assert [np.frombuffer(x, "<u4").tolist() for x in idfiles.Pieces(file).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark):
    tokenizer = Tokenizer.from_file(FILE)
    got = {r.doc_id: tuple(r) for r in queries.op13_token_files(spark, DATA).collect()}
    at = 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert got[r.doc_id] == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
