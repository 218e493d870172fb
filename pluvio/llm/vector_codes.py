"""Vector code compression (operator 12): product codes by a dual-tree Lloyd iteration.

A vector's components become integers ``floor(scale * x)``; it is cut into equal parts, and each part is replaced by the
index of the nearest entry of its position's codebook. Parts are packed into blocks of bounded size, each with a balanced tree
for every position, whose nodes know their box, count and sum; blocks are written once and read by every round. The entries of a
codebook form a tree as well. Both trees are gone down together: a pair of nodes is dropped if the least distance of their boxes exceeds
the smallest greatest distance any pair of that node of parts has. A node of parts left with one entry goes to it whole, by its cached
sum; what is open at the leaves is decided by integer distances, ties by the lower index. Equal entries are one, the
first. Everything is in integers, so blocks, tasks and their order don't matter. A round sends one row for each entry and task,
and the driver holds the codebooks only.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors that can't be coded get null
code and error and train nothing: empty ones, those of another length than the first kept one has, of a length the number of parts doesn't
divide, of over 2,048 components, or with components whose integer exceeds ``2**25``. Ties of the id are settled by the vector, null ids come last; repeated rows
count each. With fewer vectors than entries all of them are entries. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.llm.common import kept, ship

# With these, squared distances of whole vectors fit in 64 bits.
LIMIT, LONGEST = 1 << 25, 2048
# Vectors of a block, and parts of a leaf of its trees.
BLOCK, LEAF = 4096, 16
PARTIAL = "part int, entry int, n long, total array<long>"


class Tree:
    """A balanced tree over points: ``order`` places them, node k of level l owns those from n*k>>l to n*(k+1)>>l."""

    def __init__(self, points: np.ndarray, levels: int):
        n, self.levels = len(points), levels
        order = np.arange(n)
        for level in range(levels):
            starts = bounds(n, level)
            placed = points[order]
            low, high = np.minimum.reduceat(placed, starts[:-1]), np.maximum.reduceat(placed, starts[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(starts))
            wide = (high - low).argmax(axis=1)
            order = order[np.lexsort((placed[np.arange(n), wide[node]], node))]
        self.order, self.points = order, points[order]
        self.low, self.high, self.total = [], [], []
        for level in range(levels + 1):
            starts = bounds(n, level)[:-1]
            self.low.append(np.minimum.reduceat(self.points, starts))
            self.high.append(np.maximum.reduceat(self.points, starts))
            self.total.append(np.add.reduceat(self.points, starts))


def bounds(n: int, level: int) -> np.ndarray:
    return n * np.arange((1 << level) + 1) >> level


def _depth(n: int, leaf: int) -> int:
    """Levels until a node holds ``leaf`` points or one more; no node is empty."""
    return max((n // leaf).bit_length() - 1, 0)


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each placed point, and the number and sum of each entry's points."""
    n, k = len(tree.points), len(entries)
    _, first = np.unique(entries, axis=0, return_index=True)
    index = np.sort(first)
    book = Tree(entries[index], _depth(len(index), 1))
    nearest = np.full(n, -1)
    count, total = np.zeros(k, np.int64), np.zeros(entries.shape, np.int64)
    q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    down_q = down_e = 0
    while True:
        low, high = tree.low[down_q][q], tree.high[down_q][q]
        other_low, other_high = book.low[down_e][e], book.high[down_e][e]
        gap = np.maximum(np.maximum(low - other_high, other_low - high), 0)
        span = np.maximum(high - other_low, other_high - low)
        least, most = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
        reach = np.full(1 << down_q, np.iinfo(np.int64).max)
        np.minimum.at(reach, q, most)
        stay = least <= reach[q]
        q, e = q[stay], e[stay]
        ends = bounds(len(index), down_e)
        alone = np.bincount(q, minlength=1 << down_q)[q] == 1
        whole = alone & (ends[e + 1] - ends[e] == 1)
        if whole.any():
            own, to = q[whole], index[book.order[ends[e[whole]]]]
            starts = bounds(n, down_q)
            np.add.at(count, to, starts[own + 1] - starts[own])
            np.add.at(total, to, tree.total[down_q][own])
            edge = np.zeros(n + 1, np.int64)  # ranges of placed points, marked by the entry plus one
            edge[starts[own]] += to + 1
            edge[starts[own + 1]] -= to + 1
            filled = np.cumsum(edge[:-1])
            nearest = np.where(filled > 0, filled - 1, nearest)
            q, e = q[~whole], e[~whole]
        if not len(q) or (down_q == tree.levels and down_e == book.levels):
            break
        if down_q < tree.levels:
            q, e, down_q = np.concatenate([2 * q, 2 * q + 1]), np.concatenate([e, e]), down_q + 1
        if down_e < book.levels:
            q, e, down_e = np.concatenate([q, q]), np.concatenate([2 * e, 2 * e + 1]), down_e + 1
    if len(q):
        _open_leaves(tree, entries, index, book, q, e, nearest, count, total)
    return nearest, count, total


def _open_leaves(tree, entries, index, book, q, e, nearest, count, total) -> None:
    """Points of uncertain leaves against each entry that is left for their leaf."""
    n = len(tree.points)
    ends, starts = bounds(len(index), book.levels), bounds(n, tree.levels)
    times = ends[e + 1] - ends[e]
    q = np.repeat(q, times)
    e = index[book.order[np.repeat(ends[e], times) + _within(times)]]
    size = starts[q + 1] - starts[q]
    point = np.repeat(starts[q], size) + _within(size)
    entry = np.repeat(e, size)
    apart = tree.points[point] - entries[entry]
    squared = (apart * apart).sum(axis=1)
    best, lowest = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    np.minimum.at(best, point, squared)
    ties = squared == best[point]
    np.minimum.at(lowest, point[ties], entry[ties])
    hit = np.flatnonzero(lowest < len(entries))
    nearest[hit] = lowest[hit]
    np.add.at(count, nearest[hit], 1)
    np.add.at(total, nearest[hit], tree.points[hit])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _packer(parts: int):
    """Blocks of vectors with their trees; a block ends with its input, so no more than one is held."""

    def pack(rows: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(rows).combine_chunks()
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), parts, -1)
        trees = [Tree(np.ascontiguousarray(values[:, p]), _depth(len(table), LEAF)) for p in range(parts)]
        file = io.BytesIO()
        np.savez(
            file,
            order=np.stack([t.order for t in trees]).astype(np.int32),
            points=np.stack([t.points for t in trees]).astype(np.int32),
            low=np.stack([np.concatenate(t.low) for t in trees]).astype(np.int32),
            high=np.stack([np.concatenate(t.high) for t in trees]).astype(np.int32),
            total=np.stack([np.concatenate(t.total) for t in trees]),
        )
        row = table["row"].combine_chunks()
        rows_of_block = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
        return pa.RecordBatch.from_arrays([rows_of_block, pa.array([file.getvalue()], pa.binary())], names=["rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            while len(table):
                piece, table = table.slice(0, BLOCK - n), table.slice(BLOCK - n)
                held.append(piece)
                n += len(piece)
                if n == BLOCK:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


def _trees(data: bytes) -> Iterator[Tree]:
    """The trees of a block, one for each position, as they were written."""
    with np.load(io.BytesIO(data)) as file:
        found = {name: file[name] for name in file.files}
    levels = (found["low"].shape[1] + 1).bit_length() - 2
    cuts = [(1 << level) - 1 for level in range(1, levels + 1)]
    for p in range(len(found["order"])):
        tree = Tree.__new__(Tree)
        tree.levels, tree.order, tree.points = levels, found["order"][p], found["points"][p].astype(np.int64)
        tree.low, tree.high, tree.total = (np.split(found[x][p].astype(np.int64), cuts) for x in ("low", "high", "total"))
        yield tree


def _sums(books: np.ndarray):
    """Number and sum of the parts nearest to each entry, over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                for p, tree in enumerate(_trees(data.as_py())):
                    _, n, s = assign(tree, books[p])
                    count[p] += n
                    total[p] += s
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    return run


def _coder(books: np.ndarray):
    """Code and error of each row of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in zip(batch.column("rows"), batch.column("trees")):
                n = len(rows)
                codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(data.as_py())):
                    nearest, _, _ = assign(tree, books[p])
                    codes[tree.order, p] = nearest
                    apart = tree.points - books[p][nearest]
                    error[tree.order] += (apart * apart).sum(axis=1)
                code = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([rows.values, code, pa.array(error)], names=["row", "code", "error"])

    return run


@dataclass
class Codes:
    """Rows (row, code, error), those that have no code among them, and the codebooks by part, entry and component."""

    rows: DataFrame
    books: np.ndarray

    def books_sha256(self) -> str:
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _seed(spark: SparkSession, rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The codebooks before the first round; bounded by the number of entries."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    values = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1) if first else np.zeros((0, parts, 0), np.int64)
    return np.ascontiguousarray(values.transpose(1, 0, 2))


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id: str = "vec_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = (),
) -> Codes:
    """Codes of the vectors; ``row`` is a struct of the id and the columns of ``keep``. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    spark = vectors.sparkSession
    ship(spark)
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(doubles, lambda x: F.floor(x * scale))
    small = F.forall(doubles, lambda x: F.abs(x * scale) <= LIMIT) & F.size(doubles).between(1, LONGEST) & (F.size(doubles) % parts == 0)
    rows = vectors.filter(finite).select(
        F.struct(F.col(id).alias("id"), *keep).alias("row"), F.size(doubles).alias("d"), F.when(small, scaled).alias("v")
    )
    lengths = rows.filter("v IS NOT NULL").select(F.col("row.id").alias("id"), "d", "v")
    lead = lengths.orderBy(F.col("id").asc_nulls_last(), "v").select("d").first()
    fits = F.col("v").isNotNull() & (F.col("d") == F.lit(lead.d if lead else -1))
    books = _seed(spark, lengths.filter(F.col("d") == F.lit(lead.d if lead else -1)), entries, parts)
    kind = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("trees", T.BinaryType())])
    blocks = kept(rows.filter(fits).select("row", "v").mapInArrow(_packer(parts), kind), "blocks")
    for _ in range(rounds if lead else 0):
        sums = blocks.select("trees").mapInArrow(_sums(books), PARTIAL)
        dim = books.shape[2]
        merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[c]).alias(f"s{c}") for c in range(dim)])
        books = books.copy()
        for r in merged.collect():  # at most a row for each entry
            books[r.part, r.entry] = [r[f"s{c}"] // r.n for c in range(dim)]
    coded = T.StructType([rows.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    done = blocks.mapInArrow(_coder(books), coded)
    uncoded = rows.filter(~fits).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(done.unionByName(uncoded), books)
