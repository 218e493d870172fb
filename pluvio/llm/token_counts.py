"""Token counts without token ids (operator 10).

Texts are split into pre-tokens; each distinct pre-token of the corpus is tokenised once, and the counts are
joined to the documents' pre-token frequencies and summed. Frequent pre-tokens would make that join both
large and skewed, so the most frequent ones, at most ``HOT`` of at most ``HOT_BYTES`` bytes each, are
broadcast and summed where the document is read; the rest goes through a shuffled join. Both ways are exact.

Added tokens of the tokenizer ("special strings") count one each and split the text around them, which is the
library's default. Nulls and empty texts have no tokens; texts of any length are counted whole; every input
row gives one output row, repeated rows too; other columns pass through.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import fresh, kept, ship
from pluvio.llm.pieces import splitter

# Bound of the broadcast: so many pre-tokens of so many bytes.
HOT, HOT_BYTES = 1 << 18, 32
# Pre-tokens a task counts before it hands them on.
HELD = 300_000
# Rows of one Arrow batch.
SENT = 20_000


def tokenizer_rules(path: str) -> tuple[str, list[str]]:
    """The tokenizer file's content and its added tokens; refuses files whose pre-tokens can't be counted apart."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    rules = json.loads(text)
    pre, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
    if rules.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("a byte-level tokenizer without normalizer or added spaces is needed")
    if any(token.get(flag) for token in added for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in neighbouring characters can't be counted apart")
    return text, sorted((token["content"] for token in added), key=len, reverse=True)


def _segments(text: str, added: re.Pattern | None) -> tuple[list[str], int]:
    if added is None:
        return [text], 0
    parts = added.split(text)
    return parts, len(parts) - 1


def _added(contents: list[str]) -> re.Pattern | None:
    return re.compile("|".join(map(re.escape, contents))) if contents else None


def _piece_counts(pattern: str, contents: list[str]):
    def batches_of(seen: Counter) -> Iterator[pa.RecordBatch]:
        pieces, counts = list(seen.keys()), list(seen.values())
        for k in range(0, len(pieces), SENT):
            columns = [pa.array(pieces[k : k + SENT], pa.string()), pa.array(counts[k : k + SENT], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, added, seen = splitter(pattern), _added(contents), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for segment in _segments(text or "", added)[0]:
                    seen.update(split(segment))
                if len(seen) >= HELD:
                    yield from batches_of(seen)
                    seen = Counter()
        yield from batches_of(seen)

    return run


@functools.lru_cache(maxsize=2)
def _tokenizer(rules: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    return Tokenizer.from_str(rules)


def _tokens_of_pieces(rules):
    @F.pandas_udf("int")
    def count(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(rules.value)
        for batch in pieces:
            yield pd.Series([len(x.ids) for x in tokenizer.encode_batch(batch.tolist(), add_special_tokens=False)])

    return count


def _frequencies(pattern: str, contents: list[str], hot):
    """The sum over broadcast pre-tokens of a document, and the frequencies of the others."""

    @F.pandas_udf("struct<hot: long, piece: array<string>, n: array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        split, added, tokens_of = splitter(pattern), _added(contents), hot.value.get
        for batch in batches:
            sums, pieces, counts = [], [], []
            for text in batch:
                segments, total = _segments(text or "", added)
                seen = Counter()
                for segment in segments:
                    seen.update(split(segment))
                rest, times = [], []
                for piece, n in seen.items():
                    tokens = tokens_of(piece)
                    if tokens is None:
                        rest.append(piece)
                        times.append(n)
                    else:
                        total += tokens * n
                sums.append(total)
                pieces.append(rest)
                counts.append(times)
            yield pd.DataFrame({"hot": sums, "piece": pieces, "n": counts})

    return run


def piece_table(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(piece, n, tokens): frequency in the corpus and token count of every distinct pre-token."""
    rules, contents = tokenizer_rules(path)
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    seen = docs.select(F.col(text).alias("text")).mapInArrow(_piece_counts(pattern, contents), "piece string, n long")
    return kept(
        seen.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("tokens", _tokens_of_pieces(shared)("piece")),
        "pieces",
    )


def frequent_pieces(pieces: DataFrame) -> DataFrame:
    """All pre-tokens from a frequency on that leaves at most ``HOT`` of them."""
    short = pieces.filter(F.octet_length("piece") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")  # a few hundred levels at most
    levels = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > HOT:
            break
        least = row["level"]
    return short.filter(F.lit(False) if least is None else level >= least)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``."""
    ship(docs.sparkSession)
    ship(docs.sparkSession)
    rows, freq, total, piece, n = fresh(docs, "row", "freq", "total", "piece", "n")
    pieces = piece_table(docs, path, pattern, text)
    hot = {row.piece: row.tokens for row in frequent_pieces(pieces).select("piece", "tokens").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    contents = tokenizer_rules(path)[1]
    counted = kept(
        docs.withColumn(freq, _frequencies(pattern, contents, shared)(F.col(text))).withColumn(
            rows, F.monotonically_increasing_id()
        ).drop(text),
        "frequencies",
    )
    rest = counted.select(
        F.col(rows), F.inline(F.arrays_zip(F.col(f"{freq}.piece").alias(piece), F.col(f"{freq}.n").alias(n)))
    )
    sums = (
        rest.join(pieces.select(F.col("piece").alias(piece), "tokens"), piece)
        .groupBy(rows)
        .agg(F.sum(F.col(n) * F.col("tokens")).alias(total))
    )
    tokens = F.col(f"{freq}.hot") + F.coalesce(F.col(total), F.lit(0))
    return counted.join(sums, rows, "left").withColumn(out, tokens).drop(rows, freq, total)
