"""The greedy two-hop rule over neighbour lists.

In position order, an item is kept unless its neighbour list shares a member
with the list of an earlier kept item.  Items can only affect each other within
a connected component of the lists, so each component is walked in order by one
task, whose memory holds the members seen.  Lists of at most ``WALK`` edges in
all are one walk, without components.

A component of more than ``WALK`` edges is decided in parallel rounds instead,
with the same result: the rule gives the lexicographically first maximal
independent set of the conflict graph.  Per member, the least undecided item
that lists it; an item is kept when it is the least at all its members; items
with a claimed member are dropped; repeat.  No conflict pair is ever built.
Above ``WALK`` edges, ``EARLY`` such rounds come first: where lists are long they
decide most items, so that components are formed of few edges, or of none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connect
from tessera.sources.tables import discard, few, materialize

WALK = 2_000_000
EARLY = 4


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src) of the dropped items of rows (root, src, dst), sorted by root and src."""
    root = src = None
    seen: set[int] = set()
    members: list[int] = []
    lost: list[int] = []

    def decide() -> None:
        if src is not None:
            if seen.isdisjoint(members):
                seen.update(members)
            else:
                lost.append(src)

    for batch in batches:
        roots, items, targets = (batch.column(i).to_numpy() for i in range(3))
        cuts = [0, *(np.flatnonzero((np.diff(items) != 0) | (np.diff(roots) != 0)) + 1).tolist(), len(items)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (roots[a], items[a]) != (root, src):
                decide()
                if roots[a] != root:
                    seen.clear()
                root, src, members = roots[a], items[a], []
            members.extend(targets[a:b].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64())], names=["src"])
        lost.clear()
    decide()
    yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64())], names=["src"])


def dropped_items(edges: DataFrame, most: int = WALK, early: int = EARLY) -> DataFrame:
    """(src) of the items that the rule drops; edges: (src, dst), self included."""
    left, lost = edges.select("src", "dst"), []
    for _ in range(early):
        if left.count() <= most:
            break
        before, (left, out) = left, decided(left)
        if lost:
            discard(before)
        lost.append(out)
    n = left.count()
    if n > most:
        lost += by_component(left, most)
    elif n or not lost:
        one = left.select(F.lit(0).cast("long").alias("root"), "src", "dst").coalesce(1).sortWithinPartitions("src")
        lost.append(materialize(one.mapInArrow(walk, "src long"), "dropped"))
    return reduce(DataFrame.unionByName, lost)


def by_component(edges: DataFrame, most: int) -> list[DataFrame]:
    """The same, each component of at most ``most`` edges by one task."""
    roots = connect(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = edges.join(roots.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("root", "src").alias("root"), "src", "dst")
    named = materialize(named, "components")
    large = named.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root")  # at most edges / ``most`` rows
    small = named.join(F.broadcast(large), "root", "left_anti").repartition("root").sortWithinPartitions("root", "src")
    dropped = materialize(small.mapInArrow(walk, "src long"), "dropped")
    return [dropped, *rounds(materialize(named.join(F.broadcast(large), "root", "left_semi").select("src", "dst"), "greedy"))]


def rounds(left: DataFrame) -> list[DataFrame]:
    """The same for components of any size."""
    lost = []
    while left.count():
        before, (left, out) = left, decided(left)
        discard(before)
        lost.append(out)
    return lost


def decided(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the edges of the items that stay open, and (src) of those that it drops; written.

    The edges themselves are only read: what they are joined with has a row an item.
    """
    least = materialize(edges.groupBy("dst").agg(F.min("src").alias("m")), "least")
    fate = edges.join(few(least), "dst").groupBy("src").agg(F.min((F.col("m") == F.col("src")).cast("int")).alias("first"))
    kept = materialize(fate.where("first = 1").select("src"), "kept")
    claimed = materialize(edges.join(few(kept), "src", "left_semi").select("dst").distinct(), "claimed")
    rest = edges.join(few(kept), "src", "left_anti")
    out = materialize(rest.join(few(claimed), "dst", "left_semi").select("src").distinct(), "dropped")
    left = materialize(rest.join(few(out), "src", "left_anti"), "greedy")
    discard(least, kept, claimed)
    return left, out
