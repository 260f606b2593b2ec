"""Token ids in binary files: one array of all ids, document boundaries in Elias-Fano code.

The Spark data source ``token_ids`` writes and reads a folder of such files.  A task writes its documents, in order, to
files of its own with new names; only the commit at the driver lists the files of the tasks that counted, one short
entry a file with the ids before it, in ``manifest.json``.  Files of lost or repeated attempts are listed nowhere and
never read.  Inside a file all offsets are relative, so the 64-bit numbers are those of the manifest and two of a file.

A file: magic, bytes of an id (2 or 4), number of documents, of null doc_ids, first doc_id; the Elias-Fano code of the
doc_ids and that of the boundaries; the ids, little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import chunks

MAGIC = b"TOKENID1"
_HEAD = struct.Struct("<8sBQQq")
_CODE = struct.Struct("<BQQ")
#: Characters of texts that are encoded at once.
RUN = 12 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class EliasFano:
    """A sequence of non-negative integers that never falls.

    Of each number the lower bits, about log2(largest / count), are packed; the rest is unary: number i sets bit
    (upper part + i).  The position of every ``STEP``-th set bit is noted in 32 bits, so that the i-th number is found
    from there (select) without reading what precedes.
    """

    STEP = 256

    def __init__(self, low_bits: int, count: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray) -> None:
        self.low_bits, self.count, self.low, self.high, self.marks = low_bits, count, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 1) // 64) * 64 if n else 0, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        return cls(low_bits, n, low, high, at[:: cls.STEP].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        word = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        mark = int(self.marks[i // self.STEP])
        left, word = i % self.STEP, mark // 64
        bits = int(self.high[word]) >> (mark % 64) << (mark % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        at = word * 64 + (bits & -bits).bit_length() - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All numbers, as unsigned 64-bit integers."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        upper = (np.flatnonzero(bits)[: self.count] - np.arange(self.count)).astype(np.uint64)
        low = np.unpackbits(self.low, count=self.count * self.low_bits, bitorder="little").reshape(self.count, self.low_bits)
        out = upper << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def dump(self) -> bytes:
        return _CODE.pack(self.low_bits, self.count, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The code at a place, and the place after it."""
        low_bits, count, words = _CODE.unpack_from(data, at)
        at += _CODE.size
        arrays = []
        for kind, number in (("u1", -(-low_bits * count // 8)), ("<u8", words), ("<u4", -(-count // cls.STEP))):
            arrays.append(np.frombuffer(data, kind, number, at))
            at += arrays[-1].nbytes
        return cls(low_bits, count, *arrays), at


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file: documents by doc_id, null first, with the ids of each."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    sizes = np.array([len(x) for x in ids], np.uint64)
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if not len(whole) or int(whole.max()) < 1 << 16 else 4
    head = _HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), first)
    keys = EliasFano.encode(np.array([d - first for d in known], np.uint64))
    ends = EliasFano.encode(np.cumsum(sizes, dtype=np.uint64))
    return head + keys.dump() + ends.dump() + whole.astype(f"<u{width}").tobytes()


class IdFile:
    """A file's documents: ``doc_id(i)`` and ``ids(i)`` of the i-th, found by select."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.documents, self.nulls, self.first = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        view = memoryview(data)
        self.keys, at = EliasFano.load(view, _HEAD.size)
        self.ends, at = EliasFano.load(view, at)
        self.data, self.at = view, at

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys[i - self.nulls]

    def slice(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{self.width}", end - start, self.at + start * self.width)

    def ids(self, i: int) -> np.ndarray:
        return self.slice(self.ends[i - 1] if i else 0, self.ends[i])

    def batches(self, before: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
        """All documents as (doc_id, start, n_tokens, ids), about ``most`` ids at once; ``before``: ids of earlier files."""
        ends = self.ends.values().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        known = [self.first + k for k in self.keys.values().tolist()]
        i = 0
        while i < self.documents:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
            own = [None if k < self.nulls else known[k - self.nulls] for k in range(i, j)]
            held = self.slice(int(starts[i]), int(ends[j - 1])).astype("<u4")
            places = np.concatenate([[0], (ends[i:j] - starts[i]) * 4]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(places), pa.py_buffer(held)])
            arrays = [pa.array(own, pa.int64()), pa.array(before + starts[i:j]), pa.array(ends[i:j] - starts[i:j]), ids]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])
            i = j


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; a path without a scheme is a folder that driver and executors share."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _put(path: str, name: str, data: bytes) -> None:
    store, folder = _store(path)
    with store.open_output_stream(f"{folder}/{name}") as out:
        out.write(data)


def _get(path: str, name: str) -> bytes:
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/{name}") as source:
        return source.read()


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, ids_a_file: int, documents_a_file: int, tokenizer: str | None, end: bytes) -> None:
        self.path, self.ids_a_file, self.documents_a_file, self.tokenizer, self.end = path, ids_a_file, documents_a_file, tokenizer, end

    def _documents(self, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of each row; ids that are given already are taken as they are."""
        keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if self.tokenizer is None:
            yield from ((key, ids or b"") for key, ids in zip(keys, values))
            return
        for first, part in chunks(values, RUN):
            for key, ids in zip(keys[first : first + len(part)], _pieces(self.tokenizer).encode(part)):
                yield key, ids + self.end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, files = TaskContext.get().partitionId(), []
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> None:
            nonlocal keys, held, size
            files.append((f"{part:06d}-{len(files):05d}-{uuid.uuid4().hex}.ids", len(keys), size))
            _put(self.path, files[-1][0], pack(keys, held))
            keys, held, size = [], [], 0

        for batch in iterator:
            for key, ids in self._documents(batch):
                own = np.frombuffer(ids, "<u4")
                if keys and (size + len(own) > self.ids_a_file or len(keys) >= self.documents_a_file):
                    close()
                keys.append(key)
                held.append(own.astype(np.uint16 if not len(own) or int(own.max()) < 1 << 16 else np.uint32))
                size += len(own)
        if keys:
            close()
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        listed, before = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for name, documents, ids in message.files:
                listed.append({"file": name, "documents": documents, "ids": ids, "before": before})
                before += ids
        _put(self.path, "manifest.json", json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for message in messages:
            for name, _, _ in message.files if message else []:
                store.delete_file(f"{folder}/{name}")


class Part(InputPartition):
    def __init__(self, file: str, before: int) -> None:
        super().__init__(file)
        self.file, self.before = file, before


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(entry["file"], entry["before"]) for entry in json.loads(_get(self.path, "manifest.json"))] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from IdFile(_get(self.path, partition.file)).batches(partition.before)


class TokenIds(DataSource):
    """The format ``token_ids``: rows in order, (doc_id long, text string) or (doc_id long, ids binary), read back as ``SCHEMA``.

    Options: ``path`` (file, hdfs, s3 and the other schemes that pyarrow knows); for texts ``tokenizer``, a file of the
    tokenizers library, and ``end_id``, appended to each document (none, if not given); ``ids_a_file`` (4,194,304) and
    ``documents_a_file`` (1,048,576), where a document with more ids has a file for itself.  A folder is written once.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        kinds, tokenizer, end_id = [f.dataType.simpleString() for f in schema], self.options.get("tokenizer"), self.options.get("end_id")
        if kinds != ["bigint", "string" if tokenizer else "binary"]:
            raise ValueError("expected the columns doc_id long, ids binary, or with a tokenizer doc_id long, text string")
        end = b"" if end_id is None else np.array([int(end_id)], "<u4").tobytes()
        path = self.options["path"]
        store, folder = _store(path)
        if store.get_file_info(f"{folder}/manifest.json").type != fs.FileType.NotFound:
            raise ValueError(f"{path} has token ids already")
        store.create_dir(folder, recursive=True)
        return _Writer(path, int(self.options.get("ids_a_file", 1 << 22)), int(self.options.get("documents_a_file", 1 << 20)), tokenizer, end)


class Pieces:
    """A tokenizer of the tokenizers library that remembers the ids of pieces of text.

    A byte-level tokenizer that splits by its regular expression, changes no character and adds no space never joins a
    character with white space after it, and looks ahead only past white space.  So a text can be cut before white
    space that follows another character, and the pieces give the ids of the whole.  Texts are cut before spaces and
    line feeds as Arrow arrays, each different piece of a run of texts is encoded once by the library, and the ids are
    put in the places of the pieces.  Texts where other white space comes before a space or line feed are cut by a
    regular expression.  Every other tokenizer gets whole texts.

    ``most`` pieces of up to ``LONGEST`` characters are remembered; then those used since the last time are kept.
    """

    CUT = re.compile(r"\s*\S+|\s+")
    JOINED = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][ \\n]"
    LONGEST = 64

    def __init__(self, file: str, most: int = 350_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        rules = json.loads(Path(file).read_text())
        splitter = rules["pre_tokenizer"] or {}
        self.cuts = (
            splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
            and not rules["normalizer"] and not rules.get("truncation") and not rules.get("padding")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        )
        self.most = most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in missing:
            found[i] = self.older.get(pieces[i])
            if found[i] is None:
                unknown.append(i)
        for i, ids in zip(unknown, self._library([pieces[i] for i in unknown])):
            found[i] = ids
        if len(self.known) + len(missing) > self.most:
            self.known, self.older = {}, self.known
        self.known.update((pieces[i], found[i]) for i in missing[: self.most] if len(pieces[i]) <= self.LONGEST)
        return found

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where those of each text begin."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at, word_at = lines.offsets.to_numpy(), words.offsets.to_numpy()
        before = np.ones(word_at[-1], np.int8)
        before[word_at[:-1]] = 2
        before[word_at[line_at[:-1]]] = 0
        space = pa.DictionaryArray.from_arrays(before, ["", " ", "\n"]).cast(pa.string())
        return pc.binary_join_element_wise(space, words.flatten(), ""), word_at[line_at]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        if not self.cuts or not texts:
            return self._library(texts)
        out: list[bytes] = [b""] * len(texts)
        joined = pc.match_substring_regex(pa.array(texts, pa.string()), self.JOINED).to_pylist()
        for i in (i for i, odd in enumerate(joined) if odd):
            pieces = self.CUT.findall(texts[i])
            different = list(dict.fromkeys(pieces))
            out[i] = b"".join(map(dict(zip(different, self._each(different))).__getitem__, pieces))
        plain = [i for i, odd in enumerate(joined) if not odd]
        if plain:
            pieces, first = self._cut(pa.array([texts[i] for i in plain], pa.string()))
            coded = pieces.dictionary_encode()
            ids = pa.array(self._each(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            _, offsets, data = ids.buffers()
            ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[first]
            view = memoryview(data) if data is not None else memoryview(b"")
            for i, start, end in zip(plain, ends.tolist(), ends[1:].tolist()):
                out[i] = bytes(view[start:end])
        return out


@lru_cache(2)
def _pieces(file: str) -> Pieces:
    return Pieces(file)


def write(
    df: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text: str = "text",
    bytes_a_task: int = 32 << 20,
) -> None:
    """Encodes every whole text of ``df`` by the file ``tokenizer`` and writes the ids to the new folder ``path`` by
    ascending doc_id.

    Tasks take ranges of (doc_id, hash of the text), so a repeated doc_id is spread; its rows are ordered by that hash,
    a null doc_id comes first, a null or empty text is its end id alone, repeated rows are each written, and of an
    empty table only the manifest.  A text is encoded in one piece, whatever its length.  Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    key = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(max(1, -(-size // bytes_a_task)), *key).sortWithinPartitions(*key)
    df.sparkSession.dataSource.register(TokenIds)
    out = ordered.write.format("token_ids").option("path", path).option("tokenizer", tokenizer)
    (out if end_id is None else out.option("end_id", str(end_id))).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of the documents in ``path``."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("path", path).load()
