"""Embedding near-duplicates (operator 5): an exact metric range join.

On unit vectors a cosine of at least ``t`` is a distance of at most e = sqrt(2 - 2t). Pivots, a bounded sample of the
vectors, part the space: each vector's home is the cell of its nearest pivot. (Of pivots closer than ``APART`` only the first is
kept: scaled copies of one vector have one direction.) The vectors of a cell are dealt out by hash into blocks of about ``SIDE``, one row
each, with the mean of its vectors and the radius of the ball around it that holds them. Two blocks can have links only if their means are
no further apart than both radii and e; of such a pair only vectors within e of the other's ball take part. Every pair of blocks
is met once, by a nested loop over the blocks that copies nothing to disk; a few blocks at a time are in memory. Within a pair
single-precision products choose pairs with a margin and double precision decides.

Equal vectors are joined once and counted. Vectors that are null, zero or hold null or non-finite components
link with nothing; vectors of different lengths never link. Repeated rows (same id, same vector) count once
and get the same result each. Null ids link as others do, but don't name components unless no other id does.
Many directions at once (noise) leave little for any ball to tell apart: then all pairs of blocks are compared, which takes time by the
square of the vectors, but neither memory nor disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pluvio.llm.common import kept, ship, small_batches
from pluvio.llm.graph import Forest, components

# Vectors to a cell on average, and pivots at most.
CELL, PIVOTS = 8192, 4096
# Vectors of a block on average over the hash, and components of all of them.
SIDE, COMPONENTS = 8192, 1 << 19
# Tasks of the nested loop along each side: so many at least, and one more for so many blocks.
TASKS, BLOCKS = 12, 8
MARGIN = 1e-4
# Rounding of distances, and the least distance of two pivots, far above it.
SLACK, APART = 1e-7, 1e-2
# Rows of a product, and numbers in one of vectors and pivots.
STRIP, PRODUCT = 256, 1 << 20
BLOCK = "cell long, piece int, dim int, centre array<double>, radius double, nodes binary, times binary, vectors binary"
LINKS = "a long, b long, n long"


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows with their largest component near one, by a power of two, which is exact; so squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _separate(own: np.ndarray) -> np.ndarray:
    """Unit vectors without those closer than ``APART`` to an earlier one that stays."""
    stay = np.empty_like(own)
    n = 0
    for v in own:
        if n == 0 or np.linalg.norm(stay[:n] - v, axis=1).min() >= APART:
            stay[n] = v
            n += 1
    return stay[:n]


def _units(raw: np.ndarray) -> np.ndarray:
    unit = _scaled(raw.astype(np.float64))
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _reach(threshold: float) -> float:
    return float(np.sqrt(max(2 - 2 * threshold, 0.0)) + SLACK)


def _homes(pivots: dict[int, np.ndarray]):
    """Each vector, as bytes, with the cell of its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                centres = pivots.get(int(dim))
                if centres is None:  # no pivot of that length was drawn: one cell of its own
                    centres = np.eye(1, dim)
                places = np.flatnonzero(lengths == dim)
                step = max(1, PRODUCT // max(len(centres), int(dim)))
                for k in range(0, len(places), step):
                    some = places[k : k + step]
                    raw = flat[starts[some][:, None] + np.arange(dim)]
                    cells = (_units(raw) @ centres.T).argmax(axis=1) + dim * PIVOTS
                    ends = np.arange(0, raw.nbytes + 1, raw.itemsize * dim, dtype=np.int32)
                    vectors = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells, pa.int64()), batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some)), vectors],
                        names=["cell", "node", "n", "vector"],
                    )

    return run


def _pack(kind: str):
    """The vectors of a piece as one row, with a ball that holds them."""

    def run(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(table.num_rows, -1)
        unit = _units(raw)
        centre = unit.mean(axis=0)
        return pa.table(
            {
                "cell": table["cell"][:1],
                "piece": table["piece"][:1],
                "dim": pa.array([raw.shape[1]], pa.int32()),
                "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                "radius": [float(np.linalg.norm(unit - centre, axis=1).max())],
                "nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()),
                "times": pa.array([table["n"].to_numpy().tobytes()], pa.binary()),
                "vectors": pa.array([raw.tobytes()], pa.binary()),
            }
        )

    return run


class _Block:
    """One side of a pair, read from the row without copying it."""

    def __init__(self, row: dict[str, pa.Scalar], side: str, kind: str):
        self.at = (row[f"{side}_cell"].as_py(), row[f"{side}_piece"].as_py())
        self.centre, self.radius = np.array(row[f"{side}_centre"].as_py()), row[f"{side}_radius"].as_py()
        self.nodes, self.times = (np.frombuffer(row[f"{side}_{c}"].as_buffer(), np.int64) for c in ("nodes", "times"))
        raw = np.frombuffer(row[f"{side}_vectors"].as_buffer(), kind).reshape(len(self.nodes), -1)
        self.raw = _scaled(raw.astype(np.float64))
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.small = (self.raw / self.norm[:, None]).astype(np.float32)

    def near(self, other: _Block, reach: float) -> np.ndarray:
        """Places of vectors that reach the ball of the other."""
        squared = 1 - 2 * (self.raw @ other.centre) / self.norm + other.centre @ other.centre
        return np.flatnonzero(np.sqrt(np.maximum(squared, 0)) <= other.radius + reach)


def _linked(x: _Block, y: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both blocks of the pairs that reach the threshold, a strip at a time."""
    reach = _reach(threshold)
    asked, target = x.near(y, reach), y.near(x, reach)
    facing = y.small[target].T
    for k in range(0, len(asked) if len(target) else 0, STRIP):
        rows = asked[k : k + STRIP]
        found = np.flatnonzero((x.small[rows] @ facing >= threshold - MARGIN).ravel())
        left, right = rows[found // len(target)], target[found % len(target)]
        sure = np.zeros(len(left), bool)
        for m in range(0, len(left), 1 << 16):
            i, j = left[m : m + (1 << 16)], right[m : m + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x.raw[i], y.raw[j]) / (x.norm[i] * y.norm[j])
            sure[m : m + (1 << 16)] = (cosine >= threshold) & (x.nodes[i] != y.nodes[j])
        if sure.any():
            yield left[sure], right[sure]


def _join(threshold: float, kind: str):
    """Counts of links, and edges that hold the components together, of all pairs of a task: one row of each for a vector at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, known, counts = Forest(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first: dict[tuple[int, int], int] = {}
        left = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                if left is None or left.at != (row["a_cell"].as_py(), row["a_piece"].as_py()):
                    left = _Block(row, "a", kind)
                same = left.at == (row["b_cell"].as_py(), row["b_piece"].as_py())
                right = left if same else _Block(row, "b", kind)
                for i, j in _linked(left, right, threshold):
                    for block in (left, right):
                        if block.at not in first:
                            first[block.at] = len(known)
                            known, counts = np.append(known, block.nodes), np.append(counts, np.zeros(len(block.nodes), np.int64))
                            forest.grow(len(block.nodes))
                    a, b = i + first[left.at], j + first[right.at]
                    np.add.at(counts, a, right.times[j])
                    if not same:  # a block meets itself with both orders of each pair
                        np.add.at(counts, b, left.times[i])
                    forest.link(a, b)
        a, b = forest.edges(known)
        linked = counts > 0
        ends = np.concatenate([a, known[linked]]), np.concatenate([b, known[linked]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*ends, np.concatenate([np.zeros(len(a), np.int64), counts[linked]]))], names=["a", "b", "n"]
        )

    return run


def _pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """Each pair of blocks that can have links, once."""
    kept_columns = [f.split()[0] for f in BLOCK.split(", ")]
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in kept_columns]) for side in "ab")
    squares = F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    once = F.struct("a_cell", "a_piece") <= F.struct("b_cell", "b_piece")
    close = apart <= F.col("a_radius") + F.col("b_radius") + F.lit(_reach(threshold))
    return a.hint("shuffle_replicate_nl").join(b, (F.col("a_dim") == F.col("b_dim")) & once & close)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, n_links, component): one row per input row."""
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark)
    doubles = F.col(vector).cast("array<double>")
    fit = (
        F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(doubles, lambda x: x != 0)
        & (F.size(doubles) > 0)
    )
    # single precision stays as it is; adding 0.0 makes the two zeros one
    single = vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull)
    kind, own = ("<f4", F.col(vector)) if single else ("<f8", doubles)
    rows = vectors.select(
        F.col(id).alias("id"), F.when(fit, F.xxhash64(F.transform(doubles, lambda x: x + 0.0))).alias("node"), F.when(fit, own).alias("v")
    )
    valid = rows.filter("node IS NOT NULL").select("id", "node").distinct()
    counted = valid.groupBy("node").agg(F.count("*").alias("n"))
    distinct = kept(rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("v").alias("v")).join(counted, "node"), "vectors")
    total = distinct.count()
    wanted = min(max(-(-total // CELL), 1), PIVOTS)
    drawn = [r.v for r in distinct.orderBy(F.xxhash64(F.lit(5), "node")).limit(wanted).collect()]
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in drawn}:
        near = _scaled(np.array([v for v in drawn if len(v) == dim], dtype=np.float64))
        pivots[dim] = _separate(near / np.linalg.norm(near, axis=1, keepdims=True))
    members = distinct.select("node", "v", "n").mapInArrow(_homes(pivots), "cell long, node long, n long, vector binary")
    # a row per cell; dimensions bring a few more cells each
    side = F.greatest(F.least(F.lit(SIDE), F.floor(F.lit(COMPONENTS * int(kind[2])) / F.max(F.length("vector")))), F.lit(1))
    sizes = kept(members.groupBy("cell").agg(F.ceil(F.count("*") / side).cast("int").alias("pieces")), "cells")
    made = sizes.agg(F.sum("pieces")).first()[0] or 0
    piece = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("pieces")).cast("int")
    dealt = members.join(F.broadcast(sizes), "cell").select("cell", piece.alias("piece"), "node", "n", "vector")
    blocks = dealt.groupBy("cell", "piece").applyInArrow(_pack(kind), BLOCK).repartition(max(1, min(made, TASKS + made // BLOCKS)))
    found = kept(_pairs(blocks, threshold).mapInArrow(_join(threshold, kind), LINKS), "links")
    links = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    classes = components(found.filter("a != b").select("a", "b"))
    known = (
        valid.join(distinct.select("node", "n"), "node")
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .select("id", "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    lowest = known.groupBy("root").agg(F.min("id").alias("component"))
    judged = known.join(lowest, "root").select(F.col("id").alias("id2"), F.col("node").alias("node2"), "n_links", "component")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("node") == F.col("node2"))
    return (
        rows.join(judged, same, "left")
        .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
