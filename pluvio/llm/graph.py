"""Connected components, of links inside one block in numpy and of edges between blocks in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import kept


class Forest:
    """Components of the places of one block; a merge rewrites the labels, a link inside a component costs nothing."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, place: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.label[others], self.label[place]))
        if len(found) > 1:
            self.label[np.isin(self.label, found[1:])] = found[0]

    def grow(self, n: int) -> None:
        """``n`` more places, each by itself."""
        self.label = np.append(self.label, np.arange(len(self.label), len(self.label) + n))

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Many links at once: components that touch take the lowest label of those they touch, until none differ."""
        while True:
            a, b = self.label[left], self.label[right]
            open_ = a != b
            if not open_.any():
                return
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(above := self.label[self.label], self.label):
                self.label = above

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each linked node with its component's first one: no more edges than nodes, and the same components."""
        inner = self.label != np.arange(len(self.label))
        return nodes[inner], nodes[self.label[inner]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach.

    Each round points every node to the smallest one it touches, and that one's own choice, and then
    replaces the ends of all edges by what they point to. Edges inside a group vanish and equal ones become
    one, so a round has at most half the nodes of the one before. Rounds are written to the shared folder.
    """

    def clean(pairs: DataFrame) -> DataFrame:
        low_high = pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return kept(low_high.distinct(), "edges")

    now, labels = clean(edges), None
    while labels is None or not now.isEmpty():
        both = now.union(now.select("b", "a"))
        points = kept(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")),
            "labels",
        )
        onward = points.select(F.col("node").alias("to"), F.col("to").alias("root"))
        points = kept(points.join(onward, "to").select("node", "root"), "labels")
        if labels is None:
            labels = points
        else:
            moved = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = kept(labels, "labels")
        left = points.select(F.col("node").alias("a"), F.col("root").alias("c"))
        right = points.select(F.col("node").alias("b"), F.col("root").alias("d"))
        now = clean(now.join(left, "a").join(right, "b").select(F.col("c").alias("a"), F.col("d").alias("b")))
    return labels
