"""N-gram Jaccard join (operator 6): a blocked sparse product of documents by n-grams.

A document is the set of its word n-grams, as 64-bit hashes. Documents with equal sets are one node. Two sets link when
their intersection is at least ``num``/``den`` of their union; their difference then holds at most
(den - num) / (den + num) of both sizes together. That bound makes the blocks: hash ranges part the n-grams into more segments
than the difference can touch, so linked sets agree on a known number k of whole segments, by their content. A set
leaves out its k - 1 most frequent segments, by one order for all sets: the rarest one that a linked pair agrees on
then stays in both. Only sets that share one that stayed come into one block, so passages that many documents hold
don't chain them together. Segments are those of a size class, and so are blocks: a set is in the blocks of the two or three classes that
sizes within its reach fall into, and no chain leads from one class to another.

Each block then multiplies its document by n-gram incidence matrix with its transpose: frequent n-grams as dense
columns, the others by adding up pairs, for a panel of documents at a time, and only against sizes within the bound.
Overlaps below the bound are dropped, and what is left is handed on as a spanning forest, never as pairs.
Large blocks are split into pairs of slices, so that a task holds a bounded number of documents and n-grams.

Nulls, empty texts and texts without words have empty sets and link with nothing; texts with fewer words
than ``words`` have their whole sequence as one n-gram. Repeated rows are exact copies. Ids name components by
their least value; null ids don't unless there is no other. Hash collisions could change a set by an n-gram, at
odds of about one in 10^5 for 10^7 documents.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import Passing, fresh, kept, ship
from pluvio.llm.graph import Forest, components

# N-grams and documents of one slice of a block, on average over the hash.
SLICE_GRAMS, SLICE_DOCS = 1_600_000, 8192
PANEL = 512
# Pairs of documents and n-grams that are added up at a time.
PAIRS = 1 << 22
# N-grams in more than one of so many documents of a block are dense columns.
DENSE = 32
COLUMNS = 4096
MEMO = 1 << 17
# Low bits of a segment's hash hold its size class.
CLASS_BITS = 7
SETS = "id {id}, key long, n long, node long, segments array<long>, spare array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of a public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of n-gram hashes; ASCII letters are lower-cased and words end at ASCII white space."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        memo, hashes = self.memo, []
        for word in (text or "").encode().lower().split():
            h = memo.get(word)
            if h is None:
                if len(memo) >= MEMO:
                    memo.clear()
                h = memo[word] = xxhash.xxh64_intdigest(word)
            hashes.append(h)
        if not hashes:
            return np.empty(0, np.uint64)
        own = np.array(hashes, np.uint64)
        size = min(self.words, len(own))
        total = np.full(len(own) - size + 1, size, np.uint64)
        for k in range(size):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - size + 1 + k])
        return np.unique(total)


@functools.cache
def _bounds() -> list[int]:
    """Least set sizes of the size classes, each half as large again."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def segments(grams: np.ndarray, num: int, den: int) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of segment contents by size class, none where only equal sets link; and per class, above its number,
    how many of them the set can spare: linked sets share more than either one's spare segments."""
    bounds, n, out, spare = _bounds(), len(grams), [], []
    largest = n * den // num
    for c in range(bisect_right(bounds, n) - 1, bisect_right(bounds, largest)):
        differ = (den - num) * 2 * (bounds[c + 1] - 1) // (den + num)
        if differ == 0:
            continue
        parts = differ + 1 + max(2, (differ + 1) // 8)
        mixed = _mix(grams + np.uint64(c + 1))
        part = (mixed % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        content = np.add.reduceat(_mix(mixed[order]), first)
        # each differing n-gram spoils one segment; those empty in this set are the most that both can have empty
        spare.append(max(len(filled) - differ - 1, 0) << CLASS_BITS | c)
        if parts - len(filled) >= parts - differ:  # linked sets might agree on empty segments only
            whole = np.zeros(parts, np.uint64)
            whole[filled] = content
            filled, content = np.arange(parts), whole
        hashes = _mix(content ^ _mix(filled.astype(np.uint64) * np.uint64(1 << 8) + np.uint64(c)))
        out.append(hashes >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | np.uint64(c))
    return out, spare


def _sets(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sizes, nodes, parts, spares = [], [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingle(text)
                sizes.append(len(grams))
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63))
                own, spare = segments(grams, num, den) if len(grams) else ([], [])
                spares.append(spare)
                parts.append(np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate([*parts, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array(spares, pa.list_(pa.int64())),
                ],
                names=["id", "key", "n", "node", "segments", "spare"],
            )

    return run


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For panels of ``rows``: (first row, overlap counts)."""
    everything = np.concatenate([*rows, *columns])
    _, gram = np.unique(everything, return_inverse=True)
    split = sum(map(len, rows))
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column_of = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row_gram, column_gram = gram[:split], gram[split:]
    total = gram.max() + 1
    frequency = np.bincount(column_gram, minlength=total)
    dense = np.flatnonzero(frequency > max(len(columns) // DENSE, 1))
    number = np.full(total, -1)
    number[dense] = np.arange(len(dense))
    order = np.argsort(column_gram, kind="stable")
    start = np.concatenate([[0], np.cumsum(frequency)])
    ordered = column_of[order]
    row_start = np.searchsorted(row_of, np.arange(len(rows) + 1))
    for k in range(0, len(rows), PANEL):
        height = min(PANEL, len(rows) - k)
        cut = slice(row_start[k], row_start[k + height])
        own_row, own_gram = row_of[cut] - k, row_gram[cut]
        counts = np.zeros((height, len(columns)), np.float32)
        for m in range(0, len(dense), COLUMNS):
            width = min(COLUMNS, len(dense) - m)
            left, right = np.zeros((height, width), np.float32), np.zeros((len(columns), width), np.float32)
            at = number[own_gram] - m
            held = (at >= 0) & (at < width)
            left[own_row[held], at[held]] = 1
            at = number[column_gram] - m
            held = (at >= 0) & (at < width)
            right[column_of[held], at[held]] = 1
            counts += left @ right.T
        sparse = number[own_gram] < 0
        grams, owners = own_gram[sparse], own_row[sparse]
        times = frequency[grams]
        ends = np.cumsum(times)
        total_pairs = int(ends[-1]) if len(ends) else 0
        cuts = np.searchsorted(ends, np.arange(0, total_pairs, PAIRS), side="right")
        for a, b in zip(cuts, [*cuts[1:], len(times)]):
            some = times[a:b]
            inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            partner = ordered[np.repeat(start[grams[a:b]], some) + inner]
            place = np.repeat(owners[a:b], some) * len(columns) + partner
            counts += np.bincount(place, minlength=counts.size).reshape(counts.shape)
        yield k, counts


def _product(num: int, den: int):
    """Spanning forest of the links in one pair of slices."""

    def run(table: pa.Table) -> pa.Table:
        nodes, side = table["node"].to_numpy(), table["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["grams"].to_pylist()]
        size = np.array([len(s) for s in sets])
        # within one slice both sides are the same documents
        rows = np.flatnonzero(side == side.min())
        columns = np.flatnonzero(side == side.max())
        rows, columns = rows[np.argsort(size[rows])], columns[np.argsort(size[columns])]
        forest = Forest(len(nodes))
        for k, counts in _overlaps([sets[i] for i in rows], [sets[i] for i in columns]):
            own = size[rows[k : k + len(counts)]]
            shared = np.rint(counts).astype(np.int64)
            # sizes first, then the overlap that they ask for
            linked = (den * np.minimum(own[:, None], size[columns]) >= num * np.maximum(own[:, None], size[columns])) & (
                (den + num) * shared >= num * (own[:, None] + size[columns])
            )
            for r in np.flatnonzero(linked.any(axis=1)):
                forest.add(rows[k + r], columns[linked[r]])
        a, b = forest.edges(nodes)
        return pa.table({"a": a, "b": b})

    return run


def _classes(docs: DataFrame, words: int, num: int, den: int, id: str, text: str) -> DataFrame:
    """(id, key, n, class): one row per row of ``docs``; linked rows have one class, empty sets none."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    # segments take as much room as the texts: they are kept twice only while copies are left out, and go when the sets have met
    with ExitStack() as done:
        with Passing(source.mapInArrow(_sets(words, num, den), SETS.format(id=kind)), "sets") as every:
            # copies agree on all segments: one row of each set stands for them
            one = every.filter("n > 0").groupBy("node").agg(
                F.min(F.struct("id", "key")).alias("first"), F.max("n").alias("n"), F.first("segments").alias("segments"), F.first("spare").alias("spare")
            )
            one = done.enter_context(Passing(one, "nodes"))
            sets = kept(every.select("id", "key", "n", "node"), "ids")
        first = kept(one.select("node", "first", "n"), "firsts")
        met = _meet(one)
    blocks = components(met.select("a", "b"))
    # a vertex is a set in one size class
    vertices = met.select("node", F.col("a").alias("vertex")).union(met.select("low", "b")).distinct()
    members = kept(
        vertices.join(blocks.withColumnRenamed("node", "vertex"), "vertex").join(first.select("node", "n"), "node").select("node", "root", "n").distinct(),
        "members",
    )
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n") / SLICE_GRAMS), F.ceil(F.count("*") / SLICE_DOCS)).cast("int").alias("slices")
    )
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("own")
    places = members.join(sizes, "root").groupBy("node").agg(F.collect_list(F.struct("root", "slices", own)).alias("places"))
    grams = _grams_of(words)
    texts = (
        source.alias("d")
        .join(first.select("node", "first.*").join(places, "node").alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.key") == F.col("m.key")))
        .dropDuplicates(["node"])
        .select("node", "places", grams("text").alias("grams"))
        .select("node", "grams", F.inline("places"))
    )
    cells = texts.select("root", "node", "own", "grams", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    cells = cells.select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", F.col("own").alias("side"), "grams"
    )
    links = cells.groupBy("root", "i", "j").applyInArrow(_product(num, den), "a long, b long")
    groups = components(links)
    known = sets.select("id", "key", "n", "node").join(groups, "node", "left")
    return known.select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("class"))


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, n, component): one row per row of ``docs``; ``key`` is the hash of the text, ``n`` the set's size."""
    known = _classes(docs, words, num, den, id, text)
    lowest = known.filter("n > 0").groupBy("class").agg(F.min("id").alias("component"))
    return known.join(lowest, "class", "left").select(
        "id", "key", "n", F.coalesce("component", "id").alias("component")
    )


def _meet(first: DataFrame) -> DataFrame:
    """(node, low, a, b): sets that share a segment which neither spares, each with the lowest one of that segment; a and b
    are the two as vertices of the segment's size class."""
    parts = first.select("node", F.explode("segments").alias("segment"))
    # counted apart: its shuffle, as large as that of the join, is gone before that begins
    often = kept(parts.groupBy("segment").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    mask = F.lit((1 << CLASS_BITS) - 1)
    shared = parts.join(often, "segment").withColumn("class", F.col("segment").bitwiseAND(mask))
    spare = first.select("node", F.explode("spare").alias("s")).select(
        "node", F.col("s").bitwiseAND(mask).alias("class"), F.shiftright("s", CLASS_BITS).alias("spare")
    )
    # the segments of one document in one size class; those that no other has are the rarest and need no rank
    ordered = Window.partitionBy("node", "class").orderBy(F.desc("often"), "segment")
    ranked = shared.withColumn("rank", F.row_number().over(ordered)).join(spare, ["node", "class"])
    with Passing(ranked.filter("rank > spare").select("node", "segment"), "segments") as stay:
        lowest = stay.groupBy("segment").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
        pairs = stay.join(lowest, "segment").filter("node != low").withColumn("class", F.col("segment").bitwiseAND(mask))
        return kept(
            pairs.select("node", "low", F.xxhash64("node", "class").alias("a"), F.xxhash64("low", "class").alias("b")).distinct(), "meetings"
        )


def _grams_of(words: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingle = Shingler(words)
        for batch in batches:
            yield pd.Series([shingle(text).tobytes() for text in batch], dtype=object)

    return F.pandas_udf(run, "binary")


def deduplicate(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group, the least by id and text (null ids last); documents without words all stay."""
    key, empty = fresh(docs, "key", "empty")
    known = _classes(docs, words, num, den, id, text)
    order = F.struct(F.col("id").isNull().alias("void"), "id", "key")
    first = known.filter("n > 0").groupBy("class").agg(F.min(order).alias("first")).select("first.id", "first.key", F.lit(False).alias("bare"))
    bare = known.filter("n = 0").select("id", "key", F.lit(True).alias("bare")).distinct()
    stay = first.unionByName(bare).select(*[F.col(c).alias(f"stay.{c}") for c in ("id", "key", "bare")])
    rows = docs.withColumn(key, F.xxhash64(text))
    same = F.col(id).eqNullSafe(F.col("`stay.id`")) & (F.col(key) == F.col("`stay.key`"))
    found = rows.join(stay, same).withColumn(empty, F.col("`stay.bare`"))
    one = found.filter(~F.col(empty)).dropDuplicates([id, key])
    return one.union(found.filter(F.col(empty))).select(*[F.col(f"`{c}`") for c in docs.columns])
