"""Helpers on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once: the optimiser may put an expression inside a lambda, where it would be
    worked out again for every element; a lambda's own variable stays one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bisect(ordered: Column, value: Column) -> Column:
    """Index (from 0) of ``value`` in an ascending array, by halving; null if it is absent or null."""
    steps = F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int")))

    def step(at: Column, k: Column) -> Column:
        further = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.get(ordered, further) <= value, further).otherwise(at)

    last = F.aggregate(steps, F.lit(-1), step)
    return F.when(F.get(ordered, last) == value, last)


def ancestor_tables(up: Column) -> Column:
    """(up, depth) of a forest given by the index of each node's parent, its own for roots.

    ``up[k]`` has each node's ancestor 2**k edges above (a root stays itself), made from ``up[k-1]`` by looking it up in
    itself; ``depth`` is the number of edges to the root.
    """

    def doubled(state: Column, _: Column) -> Column:
        far, deep = F.element_at(state["up"], -1), state["depth"]
        step = lambda far, deep: F.struct(
            F.array_append(state["up"], F.transform(far, lambda i: F.get(far, i))).alias("up"),
            F.transform(far, lambda to, i: F.get(deep, i) + F.get(deep, to)).alias("depth"),
        )
        return let(far, lambda f: let(deep, lambda d: step(f, d)))

    def tables(up: Column) -> Column:
        edge = F.transform(up, lambda parent, i: F.when(parent == i, F.lit(0)).otherwise(F.lit(1)))
        levels = F.sequence(F.lit(1), F.ceil(F.log2(F.size(up) + 1)).cast("int"))
        return F.aggregate(levels, F.struct(F.array(up).alias("up"), edge.alias("depth")), doubled)

    return let(up, tables)
