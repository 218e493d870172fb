"""Suffix-array dedup (operator 2): removes every byte covered by a string of ``WINDOW`` bytes that occurs twice.

All windows of ``WINDOW`` bytes are dealt out by content: the anchor of a window is its run of ``CORE`` bytes with
the lowest hash, so equal windows have equal anchors, and neighbouring windows mostly share one. The windows of a text
with one anchor make a fragment, cut from the text with the anchor in a known place. Anchors that occur once
are dropped, and equal fragments are counted instead of being sent along.

A passage that many documents hold, each with other text around it, has as many distinct fragments at its edges. So the
windows of every anchor with several fragments are dealt again: those with the anchor at one of ``SHARE`` neighbouring places
have all but ``SHARE`` - 1 bytes in common, which become their core, and a run of them is one row, a core with the few bytes
to its left and right. Cores that occur once are dropped; what is left has equal neighbours up to those bytes. In each
bucket of one core suffixes decide: the core becomes one symbol, the strings of many buckets are put
together, and their suffix array, made by the grouping construction of ``suffix_array``, brings equal windows next to
each other, where they are compared symbol by symbol. A bucket of more than ``BUCKET`` distinct strings is dealt once more, by
``LEAST`` places; a string then has one byte on either side at most, so no bucket can hold more than 66,048 of them.

Matches never cross documents; overlapping occurrences count; windows are judged on the input. Nulls and
texts shorter than a window keep all bytes. Rows that repeat (same id, same text) are copies of each other.
Texts are read in slices, whole, and the session's batches to Python are small from here on. Anchors, fragments and cores are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup
from pluvio.llm.common import fresh, kept, ship, small_batches
from pluvio.llm.suffix_array import suffix_array

WINDOW, CORE = 400, 209
RUNS = WINDOW - CORE + 1  # places of an anchor in a window
# Neighbouring places by which windows are dealt again; each divides the one before.
SHARE, LEAST = 16, 2
# Distinct strings of one bucket sorted as dealt by SHARE places.
BUCKET = 1 << 16
# Windows of one slice of a text, and symbols sorted at once (more only within one bucket).
SLICE, SORTED = 1 << 17, 300_000
# Bits that hold a place in a slice.
PLACES = np.uint64((1 << 18) - 1)
# Odd, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, powers of the base and their inverses."""
    rng = np.random.default_rng(3)
    bytes_ = rng.integers(1, 1 << 63, 256, dtype=np.uint64)

    def powers(base: int) -> np.ndarray:
        steps = np.full(SLICE + 2 * WINDOW, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return bytes_, powers(BASE), powers(pow(BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _lowest(hashed: np.ndarray) -> np.ndarray:
    """Place of the lowest hash among each ``RUNS`` neighbours, by the upper bits, the first of equal ones.

    Minima are carried forward and backward within blocks of ``RUNS``; any ``RUNS`` neighbours end one block and begin another.
    """
    n = len(hashed)
    grid = np.full(-(-n // RUNS) * RUNS, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = (hashed & ~PLACES) | np.arange(n, dtype=np.uint64)
    grid = grid.reshape(-1, RUNS)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[: n - RUNS + 1], forward[RUNS - 1 : n]) & PLACES).astype(np.int64)


def fragments(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, fragment, start, shape) of each run of windows with one anchor.

    ``shape`` is 512 times the number of windows less one, plus the distance of the anchor from the first window.
    """
    numbers, power, inverse = _tables()
    parts: list[tuple[np.ndarray, ...]] = []
    raw = np.frombuffer(data, np.uint8)
    for first in range(0, len(raw) - WINDOW + 1, SLICE):
        own = raw[first : first + SLICE + WINDOW - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[own] * power[: len(own)], dtype=np.uint64)])
        cores = len(own) - CORE + 1
        hashed = _mix((sums[CORE:] - sums[:-CORE]) * inverse[:cores])
        windows = cores - RUNS + 1
        at = _lowest(hashed)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([start[1:], [windows]]) - 1
        shape = (last - start) * 512 + at[start] - start
        whole = (sums[last + WINDOW] - sums[start]) * inverse[start]
        parts.append((hashed[at[start]].view(np.int64), _mix(whole ^ _mix(shape.astype(np.uint64))).view(np.int64), start + first, shape))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            found = [fragments((text or "").encode()) for text in some.column(1).to_pylist()]
            rows = np.repeat(some.column(0).to_numpy(zero_copy_only=False), [len(f[0]) for f in found])
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                names=["row", "anchor", "fragment", "start", "shape"],
            )


def _repeated(bucket: list[int], left: list[bytes], right: list[bytes], times: list[int], width: int) -> list[np.ndarray]:
    """For each string, which of its windows occur twice; ``bucket`` numbers the buckets, a window is ``width`` symbols."""
    symbols: list[int] = []
    base, owner, offset, counts = [], [], [], []
    for k, (group, before, after) in enumerate(zip(bucket, left, right)):
        windows = len(before) + len(after) - width + 2
        base.append(len(symbols))
        # 0 parts strings, 1 to 256 are bytes, and the core's bytes are the bucket's own symbol
        symbols += [b + 1 for b in before]
        symbols.append(257 + group)
        symbols += [b + 1 for b in after]
        symbols.append(0)
        owner.append(np.full(windows, k))
        offset.append(np.arange(windows))
        counts.append(windows)
    owners, offsets = np.concatenate(owner), np.concatenate(offset)
    text = np.array(symbols, np.int32)
    number = np.full(len(text), -1)
    number[np.array(base)[owners] + offsets] = np.arange(len(owners))
    ordered = np.array(suffix_array(symbols), np.int64)
    ordered = ordered[number[ordered] >= 0]  # suffixes that begin with a window
    views = np.lib.stride_tricks.sliding_window_view(text, width)
    twice = np.array(times)[owners] > 1
    for k in range(0, len(ordered) - 1, 1 << 14):
        some, next_ = ordered[k : k + (1 << 14)], ordered[k + 1 : k + (1 << 14) + 1]
        equal = (views[some[: len(next_)]] == views[next_]).all(axis=1)
        twice[number[some[: len(next_)][equal]]] = True
        twice[number[next_[equal]]] = True
    return np.split(twice, np.cumsum(counts)[:-1])


def _sort_buckets(width: int):
    """Rows come sorted by core; whole buckets are sorted together up to a number of symbols."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = (rows["core"] != rows["core"].shift()).cumsum().tolist()
        left, right = rows["left"].tolist(), rows["right"].tolist()
        marks = _repeated(bucket, left, right, rows["n"].tolist(), width)
        out: list[tuple] = []
        for core, before, after, twice in zip(rows["core"], left, right, marks):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
            out += [(core, before, after, int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
        return pd.DataFrame(out, columns=["core", "left", "right", "begin", "end"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            held += int((batch["left"].str.len() + batch["right"].str.len() + 2).sum())
            if held >= SORTED:
                rows = pd.concat(waiting)
                # the last bucket may go on in the next batch
                ended = rows["core"] != rows["core"].iloc[-1]
                ready, rest = rows[ended], rows[~ended]
                sizes = (ready["left"].str.len() + ready["right"].str.len() + 2).cumsum() // SORTED
                # cut where a bucket begins
                part = sizes.where(ready["core"] != ready["core"].shift()).ffill()
                for _, own in ready.groupby(part.to_numpy()):
                    yield solve(own)
                waiting, held = [rest], 0
        rows = pd.concat(waiting) if waiting else pd.DataFrame()
        if len(rows):
            yield solve(rows)

    return run


def shared_fragments(source: DataFrame) -> DataFrame:
    """Occurrences (row, anchor, fragment, start, shape) of anchors that occur again; ``mixed`` where the anchor has several
    fragments."""
    seen = kept(
        source.mapInArrow(_occurrences, "row long, anchor long, fragment long, start int, shape int"), "fragments"
    )
    often = (
        seen.groupBy("anchor")
        .agg(F.count("*").alias("n"), (F.min("fragment") < F.max("fragment")).alias("mixed"))
        .filter("n > 1")
        .select("anchor", "mixed")
    )
    return kept(lookup(seen, often, ["anchor"], "inner", spread=["row", "start"], copies=4), "shared")


def pieces(source: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(anchor, fragment, n, shape, data): the bytes of each distinct fragment, cut from one of its texts."""
    distinct = occurrences.groupBy("anchor", "fragment").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "start", "shape")).alias("f")
    )
    wanted = distinct.groupBy(F.col("f.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "fragment", "n", "f.start", "f.shape")).alias("wanted")
    )
    cut = lambda w: F.struct(
        w["anchor"].alias("anchor"),
        w["fragment"].alias("fragment"),
        w["n"].alias("n"),
        w["shape"].alias("shape"),
        F.substring(F.col("bytes"), w["start"] + 1, F.floor(w["shape"] / 512).cast("int") + WINDOW).alias("data"),
    )
    return (
        source.join(wanted, "row")
        .dropDuplicates(["row"])
        .select(F.col("text").cast("binary").alias("bytes"), "wanted")
        .select(F.inline(F.transform("wanted", cut)))
    )


def strings(data: DataFrame) -> DataFrame:
    """Fragments as strings (anchor, fragment, n, low, core, left, right): the anchor is the core, between the bytes on its sides."""
    distance = F.col("shape") % 512
    return data.select(
        "anchor",
        "fragment",
        "n",
        F.lit(0).alias("low"),
        F.col("anchor").alias("core"),
        F.substring("data", F.lit(1), distance).alias("left"),
        F.substring("data", distance + CORE + 1, F.octet_length("data")).alias("right"),
    )


def deal(rows: DataFrame, width: int, share: int) -> DataFrame:
    """Strings whose windows take their core at ``width`` places, cut into strings of ``share`` places.

    A window with k bytes left of the core has ``width`` - 1 - k right of it. Those of one share have the bytes of the least k on the
    left, and of the greatest on the right, in common; these and the old core make the new one. ``low`` is the first window's
    number in the fragment.
    """
    before, after, last = F.octet_length("left"), F.octet_length("right"), width - 1

    def cut(j: Column) -> Column:
        least = j * share
        most = least + share - 1
        high, low = F.least(most, before), F.greatest(least, last - after)
        common = F.substring("left", before - least + 1, least), F.substring("right", F.lit(1), last - most)
        return F.struct(
            (F.col("low") + before - high).cast("int").alias("low"),
            F.xxhash64("core", j, *common).alias("core"),
            F.substring("left", before - high + 1, high - least).alias("left"),
            F.substring("right", last - most + 1, most - low).alias("right"),
        )

    shares = F.sequence(F.floor((last - after) / share).cast("int"), F.floor(before / share).cast("int"))
    return rows.select("anchor", "fragment", "n", F.inline(F.transform(shares, cut)))


def settle(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, fragment, low, high), runs of windows that occur twice, and the strings of buckets to deal once more."""
    core = ["core", "left", "right"]
    sizes = (
        rows.groupBy(*core)
        .agg(F.sum("n").alias("n"))
        .groupBy("core")
        .agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
        .filter("n > 1")
        .select("core", "distinct")
    )
    shared = kept(lookup(rows, sizes, ["core"], "inner", spread="fragment", copies=4), "cores")
    crowded = F.col("distinct") > (BUCKET if width > LEAST else 1 << 62)
    alone, mixed = shared.filter("distinct = 1"), shared.filter((F.col("distinct") > 1) & ~crowded)
    found = (
        mixed.groupBy(*core)
        .agg(F.sum("n").alias("n"))
        .repartition("core")
        .sortWithinPartitions("core")
        .mapInPandas(_sort_buckets(width), "core long, left binary, right binary, begin int, end int")
    )
    windows = F.octet_length("left") + F.octet_length("right") - width + 2
    runs = alone.select("anchor", "fragment", "low", (F.col("low") + windows - 1).alias("high")).union(
        lookup(mixed, found, core, "inner", spread="fragment", copies=4).select(
            "anchor", "fragment", (F.col("low") + F.col("begin")).alias("low"), (F.col("low") + F.col("end")).alias("high")
        )
    )
    return runs, shared.filter(crowded).drop("distinct")


def repeated_spans(docs: DataFrame, row: Column, text: str) -> DataFrame:
    """(row, spans): merged byte ranges [start, end) that strings occurring twice cover."""
    source = docs.select(row.alias("row"), F.col(text).alias("text"))
    shared = shared_fragments(source)
    mixed = shared.filter("mixed")
    found, crowded = settle(kept(deal(strings(pieces(source, mixed)), RUNS, SHARE), "strings"), SHARE)
    if not crowded.isEmpty():
        found = found.union(settle(kept(deal(crowded, SHARE, LEAST), "strings"), LEAST)[0])
    # runs of neighbouring strings become one
    sorted_ = found.groupBy("anchor", "fragment").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))
    begins = F.filter("runs", lambda r, i: (i == 0) | (F.get("runs", i - 1)["high"] != r["low"] - 1))
    ends = F.filter("runs", lambda r, i: F.coalesce(F.get("runs", i + 1)["low"] != r["high"] + 1, F.lit(True)))
    merged = sorted_.select("anchor", "fragment", F.arrays_zip(begins.alias("low"), ends.alias("high")).alias("runs"))
    span = lambda r: F.struct(
        (F.col("start") + r["low"]["low"]).alias("start"), (F.col("start") + r["high"]["high"] + WINDOW).alias("end")
    )
    covered = (
        shared.filter("NOT mixed")
        .select("row", "start", (F.col("start") + F.floor(F.col("shape") / 512) + WINDOW).cast("int").alias("end"))
        .union(
            lookup(mixed, merged, ["anchor", "fragment"], "inner", spread="row", copies=4).select(
                "row", F.inline(F.transform("runs", span))
            )
        )
    )
    return covered.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in ranges if ranges is not None else []:
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["end"])
        else:
            out.append([r["start"], r["end"]])
    return [tuple(x) for x in out]


def _cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    kept_bytes, spans = [], []
    for text, own in zip(texts, ranges):
        data, merged = (text or "").encode(), _merged(own)
        ends = [0, *(e for _, e in merged)]
        kept_bytes.append(b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(data)])))
        spans.append([{"start": s, "end": e} for s, e in merged])
    return pd.DataFrame({"kept": kept_bytes, "spans": spans})


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", out: str = "deduplicated") -> DataFrame:
    """Adds a struct of ``kept`` (the bytes left) and ``spans`` (the byte ranges removed)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    row, ranges = fresh(docs, "row", "ranges")
    key = F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit("")))
    found = repeated_spans(docs, key, text).select(F.col("row").alias(row), F.col("ranges").alias(ranges))
    cut = F.pandas_udf(_cut, "struct<kept: binary, spans: array<struct<start: int, end: int>>>")
    return docs.withColumn(row, key).join(found, row, "left").withColumn(out, cut(F.col(text), F.col(ranges))).drop(row, ranges)
