"""Newick texts folded to one row a tree.

A fold over a text's tokens with a stack of open nodes gives the nodes in preorder; tips are numbered from left to
right, so the tips below a node are a range of numbers.  What is asked about a tree (nodes, clades, its canonical text,
its delimited species) is worked out inside the same pass over the rows: no token or node is shuffled, and no text is a
shuffle key.  A tree's memory is its own size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[(),;]|(?:\[[^\]]*\]|[^(),;\[])+")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_LABEL, _LENGTH, _THETA, _NOTE = (re.compile(p) for p in (r"^[^:#\[]+", r":([^:#\[]+)", r"#([^:#\[]+)", r"\[([^\]]+)\]"))


@dataclass
class Tree:
    """Columns over the nodes in preorder; indices from 0, ``parent`` of the root is -1."""

    body: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tip: list[bool] = field(default_factory=list)
    first_tip: list[int] = field(default_factory=list)
    leaves: list[int | None] = field(default_factory=list)
    size: list[int | None] = field(default_factory=list)

    def label(self, i: int) -> str | None:
        found = _LABEL.match(self.body[i])
        return found.group() if found else None

    def number(self, i: int, pattern: re.Pattern = _LENGTH) -> float | None:
        found = pattern.search(self.body[i])
        try:
            return float(found.group(1)) if found and "_" not in found.group(1) else None
        except ValueError:
            return None

    def note(self, i: int) -> str | None:
        found = _NOTE.search(self.body[i])
        return found.group(1) if found else None

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(i)
        return out

    def tips(self) -> list[str]:
        return [self.label(i) or "" for i, tip in enumerate(self.tip) if tip]


def fold(text: str) -> Tree:
    """The nodes of a text; an inner node that is never closed has no number of leaves."""
    tree, open_nodes, before, tips = Tree(), [], "", 0

    def add(body: str, tip: bool) -> None:
        tree.body.append(body)
        tree.parent.append(open_nodes[-1] if open_nodes else -1)
        tree.depth.append(len(open_nodes))
        tree.tip.append(tip)
        tree.first_tip.append(tips + 1)
        tree.leaves.append(1 if tip else None)
        tree.size.append(1 if tip else None)

    closed = -1
    for token in TOKEN.findall(_SPACE.sub("", text)):
        if token == "(":
            add("", False)
            open_nodes.append(len(tree.body) - 1)
        elif token == ")":
            closed = open_nodes.pop() if open_nodes else -1
            if closed >= 0:
                tree.leaves[closed] = tips + 1 - tree.first_tip[closed]
                tree.size[closed] = len(tree.body) - closed
        elif token not in ",;":
            if before in ("", "(", ","):
                add(token, True)
                tips += 1
            elif before == ")" and closed >= 0:
                tree.body[closed] = token
        before = token
    return tree


def canonical(tree: Tree, label: Callable[[int], str | None]) -> str:
    """A text that is equal for equal rooted trees: siblings follow the sorted labels of their tips.

    ``label`` gives a node's name; a node with a name is a tip, whatever lies below it.
    """
    children = tree.children()
    names: list[list[str]] = [[] for _ in tree.parent]
    texts = [""] * len(tree.parent)
    for i in range(len(tree.parent) - 1, -1, -1):  # children come after their parent
        own = label(i)
        if own is not None:
            names[i], texts[i] = [own], own
            continue
        below = sorted(children[i], key=lambda c: "".join(names[c]))
        names[i] = sorted(n for c in below for n in names[c])
        texts[i] = "(" + ",".join(texts[c] for c in below) + ")"
        for c in below:
            names[c], texts[c] = [], ""
    return texts[0] + ";" if texts else ";"


def ages(tree: Tree, guard: float = 0.0) -> list[float]:
    """Length of each node's leftmost path down to a tip, ``guard`` added to the lengths of tips."""
    out = [0.0] * len(tree.parent)
    for i in range(len(tree.parent) - 1, 0, -1):
        if tree.parent[i] == i - 1:  # the first child stands right after its parent
            own = tree.number(i)
            out[i - 1] = out[i] + (0.0 if own is None else own + (guard if tree.tip[i] else 0.0))
    return out


def map_trees(trees: DataFrame, keys: list[str], schema: str, work: Callable[..., Iterator[tuple]], inputs: list[str] | None = None) -> DataFrame:
    """(keys, schema): the rows that ``work(tree, *inputs)`` yields for each text; rows without a text give none."""
    inputs = inputs or []
    rows = trees.filter("newick is not null").select(*keys, "newick", *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.name for f in trees.sparkSession.createDataFrame([], schema).schema]
    kinds = trees.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, out = [], [[] for _ in names]
            given = [batch.column(len(keys) + 1 + i).to_pylist() for i in range(len(inputs))]
            for at, text in enumerate(batch.column(len(keys)).to_pylist()):
                for row in work(fold(text), *(c[at] for c in given)):
                    source.append(at)
                    for column, value in zip(out, row):
                        column.append(value)
            taken = pa.array(source, pa.int64())
            arrays = [batch.column(i).take(taken) for i in range(len(keys))]
            arrays += [pa.array(column, kinds.field(name).type) for column, name in zip(out, names)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, *names])

    return rows.mapInArrow(run, f"{head}, {schema}" if keys else schema)


def _nodes(tree: Tree) -> Iterator[tuple]:
    for i, parent in enumerate(tree.parent):
        yield (
            i + 1, parent + 1 if parent >= 0 else None, tree.label(i), tree.number(i), tree.number(i, _THETA), tree.note(i),
            tree.tip[i], tree.first_tip[i], tree.leaves[i], tree.size[i], tree.depth[i],
        )


_NODE = (
    "node_id long, parent_id long, label string, length double, theta double, attributes string, is_tip boolean, "
    "first_tip long, n_leaves long, n_nodes long, depth long"
)


def newick_nodes(trees: DataFrame, keys: list[str]) -> DataFrame:
    """One row per node of every tree; ``keys`` identify a tree.

    Nodes are numbered in preorder from 1.  ``first_tip`` and ``n_leaves`` give the node's tips as a range of tip
    numbers, ``n_nodes`` the size of its subtree, ``depth`` the distance from the root in edges.
    """
    return map_trees(trees, keys, _NODE, _nodes)


def tree_taxa(trees: DataFrame, keys: list[str], proper: bool = False) -> DataFrame:
    """(keys, node_id, clade, n_leaves, is_tip) of every node, or with ``proper`` of the inner ones below the root."""

    def work(tree: Tree) -> Iterator[tuple]:
        tips = tree.tips()
        for i, (first, n) in enumerate(zip(tree.first_tip, tree.leaves)):
            if n is not None and not (proper and (tree.tip[i] or i == 0)):
                yield i + 1, sorted(tips[first - 1 : first - 1 + n]), n, tree.tip[i]

    return map_trees(trees, keys, "node_id long, clade array<string>, n_leaves long, is_tip boolean", work)


def tree_topologies(trees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topology): the canonical text of each tree, tips by their labels."""

    def work(tree: Tree) -> Iterator[tuple]:
        if tree.parent and not tree.tip[0]:
            yield (canonical(tree, lambda i: (tree.label(i) or "") if tree.tip[i] else None),)

    return map_trees(trees, keys, "topology string", work)


def delimited(trees: DataFrame, keys: list[str], total_species: int, tip_guard: float) -> DataFrame:
    """(keys, species, tree, n_species): nodes of age 0 become one species, named by its sorted tip labels.

    When the logged count ``n_species`` says that no node collapsed, tips are lengthened first, so that truncated ages
    cannot collapse by rounding.
    """

    def work(tree: Tree, n_species: int | None) -> Iterator[tuple]:
        if not tree.parent:
            return
        age = ages(tree, tip_guard if n_species == total_species else 0.0)
        tips = tree.tips()

        def species(i: int) -> str | None:
            if not tree.tip[i] and age[i] > 0:
                return None
            first = tree.first_tip[i] - 1
            return "".join(sorted(tips[first : first + (tree.leaves[i] or 0)]))

        found, i = [], 0
        while i < len(tree.parent):  # a species' subtree is skipped whole
            own = species(i)
            if own is not None:
                found.append(own)
                i += tree.size[i] or 1
            else:
                i += 1
        yield sorted(found), canonical(tree, species), len(found)

    return map_trees(trees, keys, "species array<string>, tree string, n_species int", work, ["n_species"])
