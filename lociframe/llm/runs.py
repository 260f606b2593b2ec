"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of words with smallest period q, of at least ``least`` words and 2 * q, that cannot be extended.
Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until no pair is repeated; the symbols
left over are joined in halves.  A run that lies inside the words of a symbol but in neither of its two parts crosses
their boundary, so the runs around each symbol's boundary are looked for once, for one of its places, moved to all its
places in the derivation, and stretches that continue each other are merged to maximal ones.

Before that a text is cut at words that no run can contain.  With ``least`` = m, g = m // 2 and a run of length L and
period q, the g words from i on stand again q words later or earlier, inside the run, unless L - q - g < i < q.  Those
are at most 2q + g - 1 - L <= g - 1 places, so a run lies in a stretch where never more than g - 1 places in a row begin
a sequence of g words that stands only once in the stretch.  Texts without such stretches have no run and no grammar.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64

#: Boundary questions answered at once; bounds the memory of a text of any length.
_AT_ONCE = 1 << 18

Run = tuple[int, int, int]


def re_pair(ids: list[int], fresh: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The symbols left over and the rules: symbol ``fresh`` + i stands for the i-th pair.

    A linked list of positions; the places of each pair are kept in sets, and a heap of counts gives the most frequent
    pair (ties: the smaller pair), entries whose count has changed being put back or skipped.  Of overlapping places
    (a a a) the leftmost counts.
    """
    n = len(ids)
    symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        places[symbol[i], symbol[i + 1]].add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        found = places.get(pair)
        if found is None or len(found) < 2:
            continue
        if len(found) != -count:
            heapq.heappush(heap, (-len(found), pair))
            continue
        chosen, last = [], -1
        for i in sorted(found):
            if i != last:
                chosen.append(i)
                last = after[i] if pair[0] == pair[1] else -1
        if len(chosen) < 2:  # a a a: two places that overlap are no repetition
            del places[pair]
            continue
        new = fresh + len(rules)
        rules.append(pair)
        del places[pair]
        changed = set()
        for i in chosen:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0:
                old = symbol[left], pair[0]
                if old in places:
                    places[old].discard(left)
                places[symbol[left], new].add(left)
                changed.add((symbol[left], new))
            if right < n:
                old = pair[1], symbol[right]
                if old in places:
                    places[old].discard(j)
                places[new, symbol[right]].add(i)
                changed.add((new, symbol[right]))
                before[right] = i
            symbol[i], after[i] = new, right
            symbol[j] = -1
        for p in changed:
            if len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rest, rules


class Repeats:
    """Lengths of equal stretches, from the ranks of all stretches of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while 2 * step <= len(ids):
            r = self.ranks[-1]
            pairs = r[: len(r) - step] * np.int64(len(ids) + 1) + r[step:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far the words from ``a`` and from ``b`` > a on are equal, before ``end``."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[level], 1 << level
            fits = b + length + step <= end
            at = np.where(fits, length, 0)
            same = fits & (r[np.minimum(a + at, len(r) - 1)] == r[np.minimum(b + at, len(r) - 1)])
            length += np.where(same, step, 0)
        return length

    def backward(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How far the words before ``a`` and before ``b`` > a are equal, from ``start`` on."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[level], 1 << level
            fits = a - length - step >= start
            same = fits & (r[np.clip(a - length - step, 0, len(r) - 1)] == r[np.clip(b - length - step, 0, len(r) - 1)])
            length += np.where(same, step, 0)
        return length


def _crossing(repeats: Repeats, nodes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, start, end, period) of the periodic stretches across each node's boundary, within the node.

    A node is (start, boundary, end).  A stretch of two periods has a whole one on one side of the boundary, so the
    words there are compared with those one period on (or back), in both directions.
    """
    start, middle, end = nodes.T
    for side in (0, 1):
        most = np.minimum((end - start) // 2, end - middle if side else middle - start)
        first = np.concatenate([[0], np.cumsum(most)])
        for at in range(0, int(first[-1]), _AT_ONCE):
            flat = np.arange(at, min(at + _AT_ONCE, int(first[-1])))
            node = np.searchsorted(first, flat, "right") - 1
            q = flat - first[node] + 1
            a = middle[node] - (0 if side else q)
            f = repeats.forward(a, a + q, end[node])
            g = repeats.backward(a, a + q, start[node])
            hit = (f + g >= q) & (f + g + q >= least)
            yield node[hit], (a - g)[hit], (a + q + f)[hit], q[hit]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[Run]:
    """Stretches of equal period that overlap by a period are parts of one; of equal stretches the smallest period stays."""
    order = np.lexsort((end, start, period))
    joined: list[list[int]] = []
    for s, e, q in zip(start[order].tolist(), end[order].tolist(), period[order].tolist()):
        if joined and joined[-1][2] == q and joined[-1][1] - s >= q:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e, q])
    smallest: dict[tuple[int, int], int] = {}
    for s, e, q in joined:
        smallest[s, e] = min(q, smallest.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def grammar_runs(ids: np.ndarray, least: int = 12) -> list[Run]:
    """(start, length, period) of all runs of a sequence of word ids, by start and period."""
    n = len(ids)
    words, dense = np.unique(ids, return_inverse=True)
    rest, rules = re_pair(dense.tolist(), len(words))
    size = [1] * len(words)
    for a, b in rules:
        size.append(size[a] + size[b])
    # the symbols left over, joined in halves: nodes that stand at one place each
    cuts = np.concatenate([[0], np.cumsum([size[s] for s in rest])]).tolist()
    nodes, stack = [], [(0, len(rest))]
    while stack:
        i, j = stack.pop()
        if j - i > 1 and cuts[j] - cuts[i] >= least:
            k = (i + j) // 2
            nodes.append((cuts[i], cuts[k], cuts[j]))
            stack += [(i, k), (k, j)]
    # places of each rule in the derivation; a rule holds only earlier symbols
    places: dict[int, list[int]] = defaultdict(list)
    for s, at in zip(rest, cuts):
        if size[s] >= least:
            places[s].append(at)
    offsets = [np.zeros(1, np.int64)] * len(nodes)
    for s in range(len(size) - 1, len(words) - 1, -1):
        found = places.pop(s, None)
        if found is None:
            continue
        a, b = rules[s - len(words)]
        if size[a] >= least:
            places[a] += found
        if size[b] >= least:
            places[b] += [at + size[a] for at in found]
        nodes.append((found[0], found[0] + size[a], found[0] + size[s]))
        offsets.append(np.array(found, np.int64) - found[0])
    if not nodes:
        return []
    pieces = [np.stack(x, axis=1) for x in _crossing(Repeats(dense), np.array(nodes, np.int64), least)]
    hits = np.concatenate(pieces) if pieces else np.zeros((0, 4), np.int64)
    hits = hits[np.lexsort((hits[:, 3], hits[:, 2], hits[:, 1], hits[:, 0]))]
    same = (hits[1:, :3] == hits[:-1, :3]).all(axis=1)  # of equal stretches of a node the smallest period stays
    hits = hits[np.concatenate([[True], ~same])] if len(hits) else hits
    moved = [np.column_stack([h[1] + offsets[h[0]], h[2] + offsets[h[0]], np.full(len(offsets[h[0]]), h[3])]) for h in hits]
    every = np.concatenate(moved) if moved else np.zeros((0, 3), np.int64)
    return _merged(every[:, 0], every[:, 1], every[:, 2])


def stretches(ids: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run, see the head of this module; ``text`` numbers each word's text.

    Cutting is repeated with what is left, a sequence of words counting as repeated only inside its own stretch.
    Sequences are compared by hashes, so chance can only keep more than needed.
    """
    n, gram = len(ids), max(1, least // 2)
    if n < least:
        return []
    key = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        key = mix64(key + ids[k : n - gram + 1 + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    part, at = text[: len(key)].astype(np.int64), np.flatnonzero(text[: len(key)] == text[gram - 1 :])
    while len(at):
        held = mix64(key[at] + part[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(held, kind="stable")
        equal = held[order][1:] == held[order][:-1]
        repeated = np.zeros(len(at), bool)
        repeated[order[1:][equal]] = True
        repeated[order[:-1][equal]] = True
        here = at[repeated]
        if not len(here):
            return []
        gap = (here[1:] - here[:-1] > gram) | (part[here[1:]] != part[here[:-1]])
        first = np.concatenate([[0], np.flatnonzero(gap) + 1])
        last = np.concatenate([first[1:] - 1, [len(here) - 1]])
        long = here[last] + gram - here[first] >= least
        spans = list(zip(here[first[long]].tolist(), (here[last[long]] + gram).tolist()))
        kept = np.concatenate([np.arange(s, e - gram + 1) for s, e in spans]) if spans else np.zeros(0, np.int64)
        part = np.full(len(key), -1, np.int64)
        for number, (s, e) in enumerate(spans):
            part[s : e - gram + 1] = number
        if len(kept) == len(at):
            return spans
        at = kept
    return []


def find_runs(texts: list[list[bytes]], least: int = 12) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    owner, first = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Run]] = [[] for _ in texts]
    for s, e in stretches(ids, owner, least):
        base = int(s - first[owner[s]])
        out[owner[s]] += [(base + start, length, q) for start, length, q in grammar_runs(ids[s:e], least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


_RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 12, with_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and the digests runs_sha256 (of the lines
    ``start,length,period``) and collapsed_sha256 (of the words left, joined by a space) of each row of ``df``.

    Words are split at ASCII white space and numbered from 0; a run has at least ``least`` words.  Of the longest runs
    the first by start and period counts.  ``with_runs`` adds ``runs``, an array of (start, length, period), and
    ``collapsed``, the text without repetitions.  A null or empty text has no word, no run (four nulls) and the digests
    of the empty string; every row is answered on its own, so repeated rows and a null doc_id are kept as they are, and an
    empty table gives no rows.  A text of any length is one piece of work, linear in memory but for a logarithm.  Other
    columns are not read, whatever their names.
    """
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_runs else ""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_RESULT}{more}"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(1).to_pylist()):
                words = [t.encode().split() for t in part]
                columns: dict[str, list] = {name.split(":")[0].split()[0]: [] for name in _RESULT.split(", ")}
                extra: dict[str, list] = {"runs": [], "collapsed": []}
                for own, runs in zip(words, find_runs(words, least)):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                    left = b" ".join(collapsed(own, runs))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    exponent = best[1] * 1000 // best[2] if runs else None
                    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
                    for name, value in zip(columns, (len(runs), *best, exponent, *digests)):
                        columns[name].append(value)
                    if with_runs:
                        extra["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                        extra["collapsed"].append(left.decode())
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                arrays = [batch.column(0).slice(first, len(part)), *(pa.array(v, k) for v, k in zip(columns.values(), kinds))]
                if with_runs:
                    triple = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
                    arrays += [pa.array(extra["runs"], pa.list_(triple)), pa.array(extra["collapsed"], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns, *extra])
                else:
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns])

    return rows.mapInArrow(find, schema)
