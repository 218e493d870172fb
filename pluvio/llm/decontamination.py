"""Benchmark decontamination (operator 1), DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. A window is ``n`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. Every window holds short grams at known distances: of the
grams that start at each ``stride``-th word of a document, at least one lies inside any occurrence of a window. So
the hashes of all grams of all windows make a small set that is broadcast, the document side looks up one
gram per stride, and only documents with a match have all their windows compared, by hash and then by text.

Nulls and texts without words have no windows and are never hit. Items that repeat, or share windows, all
count. Rows that repeat (same id, same text) get the same result each. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import fresh, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Rows of the benchmark side up to which it is broadcast (a row holds two hashes); larger ones are shuffled.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(hashes: Column, size: int, step: int) -> Column:
    """(start, hash) of the runs of ``size`` words that start at each ``step``-th word."""
    last = F.size(hashes) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("start"), F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]).alias("gram")),
    )


def _hashes(words_column: Column) -> Column:
    return F.transform(words_column, lambda w: F.xxhash64(w))


def _bounded(df: DataFrame) -> DataFrame:
    """The frame to be broadcast if it has few enough rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass
class Windows:
    """Windows of a benchmark: (item, size, hash, window text), and their sizes, at most ``n`` of them."""

    rows: DataFrame
    sizes: list[int]


def windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> Windows:
    split = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(0), F.size("w") - size)
    rows = (
        split.select("item", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("w"))
        .select("item", "size", F.array_join("w", " ").alias("window"), "w")
        .distinct()
    )
    return Windows(rows, sorted(r["size"] for r in rows.select("size").distinct().collect()))


def _gram_size(size: int) -> tuple[int, int]:
    """Words of a gram, and the stride at which one lies inside every window of ``size`` words."""
    gram = (size + 1) // 2
    return gram, size - gram + 1


def _every_window(words_column: Column, size: int) -> Column:
    """(start, size, window) of all runs of ``size`` words."""
    last = F.size(words_column) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("start"),
            F.lit(size).alias("size"),
            F.array_join(F.slice(words_column, i + 1, size), " ").alias("window"),
        ),
    )


def find_windows(docs: DataFrame, bench: Windows, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, start, size, item): every occurrence of a window in a text; ``key`` is the hash of the text."""
    hashed = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("key"), _hashes(words(F.col(text))).alias("h"))
    wanted = found = None
    for size in bench.sizes:
        gram, stride = _gram_size(size)
        own = bench.rows.filter(F.col("size") == size).select(F.explode(_grams(_hashes(F.col("w")), gram, 1)).alias("g"))
        own = own.select(F.lit(gram).alias("words"), "g.gram")
        seen = F.transform(_grams(F.col("h"), gram, stride), lambda g: F.struct(F.lit(gram).alias("words"), g["gram"].alias("gram")))
        wanted = own if wanted is None else wanted.union(own)
        found = seen if found is None else F.concat(found, seen)
    if found is None:
        return docs.select(
            F.col(id).alias("id"), F.xxhash64(text).alias("key"), F.lit(0).alias("start"), F.lit(0).alias("size"),
            F.lit(None).cast(bench.rows.schema["item"].dataType).alias("item"),
        ).limit(0)
    suspects = (
        hashed.select("id", "key", F.explode(found).alias("g"))
        .select("id", "key", "g.*")
        .join(_bounded(wanted.distinct()), ["words", "gram"], "left_semi")
        .select("id", "key")
        .distinct()
    )
    checked = (
        docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
        .alias("d")
        .join(suspects.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.key") == F.col("s.key")), "left_semi")
        .dropDuplicates(["id", "key"])
        .select("id", "key", words(F.col("text")).alias("w"))
    )
    every = [_every_window(F.col("w"), size) for size in bench.sizes]
    all_windows = F.concat(*every)
    return (
        checked.select("id", "key", F.inline(all_windows))
        .join(_bounded(bench.rows.select("item", "size", "window")), ["size", "window"])
        .select("id", "key", "start", "size", "item")
    )


def summarise(found: DataFrame) -> DataFrame:
    """(id, key, n_hit, items, spans): words inside windows, the items' ids sorted as strings, merged word spans."""
    starts = found.select("id", "key", "start", "size").distinct()
    order = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        order,
        empty,
        lambda done, w: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= w["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], w["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(w))),
    )
    spans = starts.groupBy("id", "key").agg(merged.alias("spans"))
    items = found.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return (
        spans.alias("a")
        .join(items.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key")))
        .select(
            "a.id",
            "a.key",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
            "items",
            "spans",
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with n_words, n_hit, items and spans (merged word spans [start, end)) added."""
    found = summarise(find_windows(docs, windows(benchmark, n), id, text))
    key, n_words, n_hit, items, spans = fresh(docs, "key", "n_words", "n_hit", "items", "spans")
    rows = docs.withColumns({key: F.xxhash64(text), n_words: F.size(words(F.col(text))).cast("long")})
    found = found.select(*[F.col(c).alias(f"found.{c}") for c in found.columns])
    same = F.col(id).eqNullSafe(F.col("`found.id`")) & (F.col(key) == F.col("`found.key`"))
    return rows.join(found, same, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(n_words),
        F.coalesce("`found.n_hit`", F.lit(0).cast("long")).alias(n_hit),
        F.coalesce("`found.items`", F.array().cast("array<string>")).alias(items),
        F.coalesce("`found.spans`", F.array().cast("array<struct<start:int,end:int>>")).alias(spans),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, spans_only: bool = False, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the hit documents, or, with ``spans_only``, with the hit words cut out of them."""
    marked = contamination(docs, benchmark, n, id, text)
    n_hit, spans = marked.columns[-3], marked.columns[-1]
    if not spans_only:
        return marked.filter(F.col(n_hit) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    # a word of the untouched text goes with the gap behind it
    any_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    parts = F.regexp_extract_all(F.col(text), F.lit(any_word + gap), F.lit(0))
    left = F.filter(parts, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(F.col(text), "^" + gap, 0), F.array_join(left, ""))
    return marked.withColumn(text, F.when(F.col(n_hit) == 0, F.col(text)).otherwise(cut)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
