"""Groups of records that are linked directly or through others.

Every partition of links runs union-find and keeps only a spanning forest, at most one link per
record less one. The forests are merged in fewer and fewer partitions, each of which holds at most
`bound` links, until one partition remains. Where the records alone exceed the bound, merging cannot
end that way: then one round of randomised contraction is taken in between (every record joins the
neighbour of least random rank, links are rewritten between those), which lessens the records by a
constant factor in expectation; labels are carried back through the rounds by joins. Records with so many links
that they would fill a partition of such a join (a handful by their definition) are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.stable import settle

_LINKS = "a bigint, b bigint"


class _Forest:
    """Union-find over the links of one partition; of each tree the smallest id is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x] = top
            x = up
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b


def _spell(forest: _Forest, selfs: bool) -> Iterator[pa.RecordBatch]:
    ids = [x for x, up in forest.parent.items() if selfs or x != up]
    for i in range(0, len(ids), 100_000):
        part = ids[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])


def _pieces(batches: Iterator[pa.RecordBatch], most: int, selfs: bool) -> Iterator[pa.RecordBatch]:
    """Spanning forests of a partition's links; one that has grown to `most` records is given out and a new one begun."""
    forest = _Forest()
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            for x, y in pairs.tolist():
                forest.link(x, y)
        if len(forest.parent) >= most:
            yield from _spell(forest, selfs)
            forest = _Forest()
    yield from _spell(forest, selfs)


def _spanning(links: DataFrame, most: int, selfs: bool) -> DataFrame:
    """Links (root, record) that connect what the links of each partition connect; with `selfs` (root, root) too."""
    return links.mapInArrow(lambda batches: _pieces(batches, most, selfs), _LINKS)


#: More records than this cannot be heavy, as each heavy one holds a larger part of the rows than one in so many.
MOST_HEAVY = 10_000


def _looked_up(left: DataFrame, right: DataFrame, key: str, most: int, how: str = "inner") -> DataFrame:
    """`left` (settled) with the columns of `right` (settled), which has each `key` once.

    Keys with more than `most` rows, and more than one in MOST_HEAVY of all, are found first by a count
    folded per task; their rows stay where they are and get the few rows of `right` by broadcast.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heavy = settle(counts.where(F.col("n") > max(most, left.count() // MOST_HEAVY)).select(key))
    if heavy.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(heavy)  # MOST_HEAVY keys at most
    hot = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return left.join(few, key, "left_anti").join(right, key, how).unionByName(hot)


def _contract(links: DataFrame, seed: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """(records with the record they join, the links between different ones of those); `links` is settled."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = F.xxhash64("b", F.lit(seed))
    joins = settle(both.unionByName(links.select("a", F.col("a").alias("b"))).unionByName(links.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("record")).agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("into")))["into"].alias("into")))
    first = _looked_up(links, joins.select(F.col("record").alias("a"), F.col("into").alias("x")), "a", bound)
    moved = first.join(joins.select(F.col("record").alias("b"), F.col("into").alias("y")), "b")  # a forest lists b once per piece
    return joins, moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def groups(links: DataFrame, a: str, b: str, bound: int = 1_500_000, fan_in: int = 4) -> DataFrame:
    """(`wordid`, `groupid`): every id of a link whose two ids are non-null, with the smallest id of its group.

    Direction and repetition do not matter; an id linked only with itself is its own group. `bound` is
    the number of links a merging partition may hold, `fan_in` how many forests are merged into one.
    Links with a null id count for nothing; an empty table gives no rows.
    """
    plain = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    rounds: list[DataFrame] = []
    forest = settle(_spanning(plain, bound, True))
    count = forest.count()
    parts = max(2, forest.rdd.getNumPartitions(), -(-count // bound))
    while count > bound:
        merged = max(-(-count // bound), -(-parts // fan_in))
        if merged < parts:
            parts = merged
            forest = settle(_spanning(forest.repartition(parts), 2 * bound, not rounds))
        else:  # the records alone exceed the bound
            joins, links = _contract(forest, len(rounds), bound)
            rounds.append(joins)
            forest = settle(_spanning(links.repartition(parts), bound, False))
        count = forest.count()
    forest = settle(_spanning(forest.repartition(1), 2 * bound + 1, not rounds))  # at most `bound` links
    labels = forest.select(F.col("b").alias("wordid"), F.col("a").alias("groupid"))
    if rounds:
        for joins in reversed(rounds):  # records without links left are groups of their own
            found = _looked_up(joins, settle(labels.select(F.col("wordid").alias("into"), "groupid")), "into", bound, "left")
            labels = found.select(F.col("record").alias("wordid"), F.coalesce("groupid", "into").alias("groupid"))
        labels = settle(labels)
        least = settle(labels.groupBy("groupid").agg(F.min("wordid").alias("least")))
        labels = _looked_up(labels, least, "groupid", bound).select("wordid", F.col("least").alias("groupid"))
    return labels
