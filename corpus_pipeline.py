"""Cleaning a corpus: text operators applied to ``documents`` one after the other.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of documents,
except for the last, which adds the token ids. Results are written as Parquet and read again between stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.llm import bpe, decontamination, ngram_join, pii, toxicity
from pluvio.llm.common import fresh, kept, read

# A user of the pipeline brings a secret one.
PII_KEY = "corpus pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, by a model fitted on the labels of the training folds."""
    (score,) = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), score)
    return scored.filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a Jaccard similarity of 0.8."""
    return ngram_join.deduplicate(docs, words=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format; ``n_chars`` follows, as addresses may change in length."""
    done = pii.pseudonymise(docs, PII_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids as packed little-endian unsigned 32-bit integers, their number, and whether they decode to the text."""
    codec = bpe.SharedCodec(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, decoded, n_tokens, exact = fresh(docs, "ids", "decoded", "n_tokens", "round_trip")
    tokens = bpe.round_trip(docs, codec, ids=ids, decoded=decoded)
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return tokens.withColumns({n_tokens: F.expr(f"octet_length({ids}) div 4"), exact: same}).drop(decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("byte-level BPE", tokenise),
]

# The classifier and the components have no SQL form; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
