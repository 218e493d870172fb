"""Merkle dataset manifest (operator 11): a postorder append log written by aligned builders.

Rows are the leaves, in order of their id inside each group; two neighbours become their hash, a last lone one the
hash of itself, until one node is left: the group's subroot. The subroots, in order of their groups, make the root in
the same way. A node of level ``l`` and index ``i`` covers the leaves from ``i * 2**l`` on, and is complete
when the last of them is appended. So its place in the log follows from subtree sizes alone: before its own subtree
lie the nodes that ``p = i * 2**l`` leaves complete, ``2p - popcount(p)``, and it ends its subtree.

A builder owns an aligned block of ``2**BITS`` leaves, whose nodes fill one segment of the log, and writes them in
completion order; block roots are the leaves of the next round. For a proof, a block's segment is read
once and siblings are taken from it by their places; the path above the block comes with it as rows. Hence no task
holds more than a block, a group of any size is spread over blocks, and no node is looked up by a join per leaf.

Digests are lower-case hex, and hashed as such. Null ids come first; rows of one id follow each other by leaf digest,
equal rows are interchangeable. A null group comes first; groups are compared by their text, byte by byte. A lone leaf is its
group's subroot, a lone subroot the root. An empty table has an empty log, no proofs and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup
from pluvio.llm.common import kept, ship

# Leaves of a block, as a power of two.
BITS = 12
NODES = "key string, block long, level int, idx long, position long, n long, digest string"
PROOF = "array<struct<sibling: string, left: boolean>>"


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 length and itself, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(n - 1, 0).bit_length()


def position(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of a tree of n leaves."""
    first = idx << level
    own = np.minimum(n - first, 1 << level)
    size = sum(-(-own >> k) for k in range(level + 1))
    ones = sum((first >> k) & 1 for k in range(max(n.bit_length(), 1)))
    return 2 * first - ones + size - 1


def _parent(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _top(n: int, base: int, bits: int) -> int:
    """The level a builder of the round that starts at level ``base`` reaches."""
    return min(base + bits, height(n))


def _builder(base: int, bits: int):
    """Nodes of one block above its leaves, in completion order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        name, block = (k.as_py() for k in key)
        n = table["n"][0].as_py()
        nodes = table.sort_by("rank")["digest"].to_pylist()
        levels, places, digests = [], [], []
        for level in range(base, _top(n, base, bits) + 1):
            if level > base:
                nodes = [_parent(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
            idx = (block << (base + bits - level)) + np.arange(len(nodes))
            levels.append(np.stack([np.full(len(nodes), level), idx, position(level, idx, n)]))
            digests += nodes
        level, idx, place = np.concatenate(levels, axis=1)
        order = np.argsort(place)
        return pa.table(
            {
                "key": pa.array([name] * len(order), pa.string()),
                "block": pa.array(np.full(len(order), block), pa.int64()),
                "level": pa.array(level[order], pa.int32()),
                "idx": pa.array(idx[order], pa.int64()),
                "position": pa.array(place[order], pa.int64()),
                "n": pa.array(np.full(len(order), n), pa.int64()),
                "digest": pa.array(digests, pa.string()).take(pa.array(order)),
            }
        )

    return run


def _extractor(base: int, bits: int):
    """The proof of every leaf of one block: siblings by place from its segment, then the path above the block."""

    def run(key: tuple, leaves: pa.Table, segment: pa.Table) -> pa.Table:
        places = segment["position"].to_numpy()
        order = np.argsort(places)
        places, digests = places[order], segment["sibling"].combine_chunks().take(pa.array(order))
        left = segment["left"].to_numpy(zero_copy_only=False)[order]
        n_above = int(np.searchsorted(places, 0))  # rows of the path have places below zero, the nearest one first
        n = leaves["n"][0].as_py()
        rank = leaves["rank"].to_numpy()
        picks, sides = [], []
        for level in range(base, _top(n, base, bits)):
            idx = rank >> (level - base)
            other = idx ^ 1
            there = (other << level) < n
            place = position(level, np.where(there, other, idx), n)
            picks.append(np.where(there, np.searchsorted(places, place), -1))
            sides.append(idx & 1 == 1)
        for k in range(n_above):
            picks.append(np.full(len(rank), k))
            sides.append(np.full(len(rank), bool(left[k])))
        pick = np.stack(picks, axis=1).ravel() if picks else np.zeros(0, int)
        side = np.stack(sides, axis=1).ravel() if sides else np.zeros(0, bool)
        steps = pa.StructArray.from_arrays(
            [digests.take(pa.array(pick, pa.int64(), mask=pick < 0)), pa.array(side)], ["sibling", "left"]
        )
        ends = pa.array(np.arange(len(rank) + 1) * len(picks), pa.int32())
        return leaves.drop_columns(["n"]).append_column("proof", pa.ListArray.from_arrays(ends, steps))

    return run


@dataclass
class Forest:
    """One tree for each key: its leaves (key, rank, n, digest), the nodes by round, and the roots (key, digest)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    bits: int

    def log(self) -> DataFrame:
        """(key, position, level, idx, digest): every node once; block roots come again as leaves of the next round."""
        parts = [
            nodes.filter(F.col("level") >= k * self.bits + (k > 0)).select("key", "position", "level", "idx", "digest")
            for k, nodes in enumerate(self.rounds)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``n``, the place inside the key in order of ``order`` and the digest, and the key's rows.

    The rows are sorted by ranges, so a key of any size is spread, and written with their places in each range. What
    is summed over ranges is one row for each range and key.
    """
    tie = F.monotonically_increasing_id()
    sorted_rows = rows.withColumn("tie", tie).repartitionByRange("key", "order", "digest", "tie")
    sorted_rows = sorted_rows.sortWithinPartitions("key", "order", "digest", "tie").drop("tie")
    placed = kept(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("key", part).agg(F.min("at").alias("first"), F.count("*").alias("run"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "key",
        "part",
        (F.coalesce(F.sum("run").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("run").over(Window.partitionBy("key")).alias("n"),
    )
    found = lookup(placed.withColumn("part", part), kept(runs, "runs"), ["key", "part"], how="inner", spread="at")
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift", "order")


def build(rows: DataFrame, bits: int = BITS) -> Forest:
    """The trees over rows (key, order, digest, ...), one for each key; other columns stay with the leaves."""
    ship(rows.sparkSession)
    leaves = kept(_ranked(rows), "leaves")
    now, rounds, roots = leaves.select("key", "rank", "n", "digest"), [], []
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while not rounds or (largest - 1) >> (bits * len(rounds)) > 0:
        base = bits * len(rounds)
        blocks = now.withColumn("block", F.shiftright("rank", bits)).groupBy("key", "block")
        nodes = kept(blocks.applyInArrow(_builder(base, bits), NODES), "log")
        rounds.append(nodes)
        done = F.col("n") <= F.lit(1).cast("long") * (1 << (base + bits))
        last = nodes.filter(done).groupBy("key").agg(F.max_by("digest", "position").alias("digest"))
        roots.append(last)
        now = nodes.filter(~done & (F.col("level") == base + bits)).select("key", F.col("idx").alias("rank"), "n", "digest")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(leaves, rounds, kept(out, "roots"), bits)


def extract(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with their ``proof``; ``above`` (key, proof) continues the paths of whole trees.

    A proof has one step a level: the sibling, if there is one, and whether it stands on the left.
    """
    bits, path = forest.bits, None
    for k in reversed(range(len(forest.rounds))):
        base, nodes = bits * k, forest.rounds[k]
        # under names of its own, as both sides of the grouping may come from the same nodes
        segment = nodes.select(
            F.col("key").alias("tree"), F.col("block").alias("part"), "position", F.col("digest").alias("sibling"), F.lit(False).alias("left")
        )
        ends = F.col("n") <= F.lit(1).cast("long") * (1 << (base + bits))
        tops = []
        if above is not None:
            whole = nodes.filter(ends & (F.col("level") == base) & (F.col("idx") == 0)).select("key", "block")
            tops.append(whole.join(above, "key"))
        if path is not None:
            tops.append(path.select("key", F.col("rank").alias("block"), "proof"))
        for top in tops:
            steps = top.select("key", "block", F.size("proof").alias("size"), F.posexplode("proof").alias("k", "step"))
            segment = segment.unionByName(
                steps.select(
                    F.col("key").alias("tree"), F.col("block").alias("part"), (F.col("k") - F.col("size")).cast("long").alias("position"),
                    "step.sibling", "step.left",
                )
            )
        if k == 0:
            leaves = forest.leaves
        else:
            leaves = nodes.filter(F.col("level") == base).select("key", F.col("idx").alias("rank"), "n", "digest")
        shape = leaves.drop("n").withColumn("block", F.lit(0).cast("long")).withColumn("proof", F.lit(None).cast(PROOF)).schema
        both = leaves.withColumn("block", F.shiftright("rank", bits)).groupBy("key", "block").cogroup(segment.groupBy("tree", "part"))
        found = both.applyInArrow(_extractor(base, bits), shape).drop("block")
        path = found if k == 0 else kept(found, "paths")
    return path


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(node: Column, s: Column) -> Column:
        left, right = F.concat(s["sibling"], node), F.concat(node, s["sibling"])
        pair = F.when(s["sibling"].isNull(), node).when(s["left"], left).otherwise(right)
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def group_key(group: Column) -> Column:
    """Groups as text in their order: null first, then by bytes."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


@dataclass
class Manifest:
    """The trees of the groups, the tree of their subroots, and the root."""

    groups: Forest
    top: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """(id, leaf, proof, subroot, root) and the columns kept beside them, a row for each leaf."""
        above = kept(extract(self.top).select(F.col("group").alias("key"), "proof"), "paths")
        subroots = self.groups.roots.select("key", F.col("digest").alias("subroot"))
        found = lookup(extract(self.groups, above), subroots, ["key"], spread="rank")
        return found.select(
            *[F.col(c).alias(c[2:]) for c in found.columns if c.startswith("x_")],
            F.col("digest").alias("leaf"),
            "proof",
            "subroot",
            F.lit(self.root).cast("string").alias("root"),
        )


def manifest(rows: DataFrame, leaf: Column, id: Column, group: Column, bits: int = BITS, **keep: Column) -> Manifest:
    """Builds both logs over the rows; of their columns only the id and those of ``keep`` stay, under the names given."""
    named = {"id": id, **keep}
    leaves = rows.select(
        group_key(group).alias("key"), id.alias("order"), leaf.alias("digest"), *[c.alias(f"x_{k}") for k, c in named.items()]
    )
    groups = build(leaves, bits)
    top = build(groups.roots.select(F.lit("").alias("key"), F.col("key").alias("order"), "digest", F.col("key").alias("group")), bits)
    first = top.roots.first()
    return Manifest(groups, top, first.digest if first else None)
