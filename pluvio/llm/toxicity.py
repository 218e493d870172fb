"""Toxicity (operator 7): subword bags averaged into a linear softmax.

Each word is the bag of its character 3- and 4-grams, with marks at its ends, and of itself; all of them are
hashed to ``BUCKETS`` rows of one embedding table. A word that occurs n times weighs 1 + ln n. A document is
the weighted mean of its rows, and a linear softmax over that mean gives the score. Table and softmax are trained together in numpy on the driver, on a bounded sample of
labelled documents that arrive as bags of at most ``BAG`` buckets each (of a larger one those of the lowest hash, drawn anew for
each document, in their shares), so at most ``2 * PER_CLASS * BAG`` times 8 bytes reach the driver; words never seen share the rows of their n-grams. As the softmax is linear, the
fitted model is one number per bucket, which is what the tasks that score all documents get.

Texts are read whole. Null, empty and wordless texts have the score of the bias alone. Labels of held-out
documents, source, language and id are never inputs. Without labels of both classes every score is the share of
the class there is (0 without labels). Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import ship
from pluvio.llm.labelled import training_rows

BUCKETS, WIDTH = 1 << 16, 8
# Buckets of a labelled document to train on, at most; scores always use all of a text.
BAG = 4096
# Scale of the mean, so that single words of long documents can move the softmax.
GAIN = 100.0
# Empty rows that take part in every mean, so that a few words don't decide as surely as a thousand.
PAD = 150
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.01, 0.0
MEMO = 1 << 17
WORD = re.compile(r"[\w@$]+")


def grams(word: str) -> list[int]:
    marked = f"<{word}>"
    found = [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(gram.encode()) % BUCKETS for gram in [*found, f"={marked}"]]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their counts."""
    seen: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for g in grams(word):
            seen[g] += 1 + math.log(n)
    return np.fromiter(seen.keys(), np.int32, len(seen)), np.fromiter(seen.values(), np.float32, len(seen))


def drawn(buckets: np.ndarray, counts: np.ndarray, most: int = BAG) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` buckets of a bag, in the order of the bag; the draw depends on the bag alone."""
    if len(buckets) <= most:
        return buckets, counts
    # an odd factor and a shift by the whole bag mix the bits; the rank of the mixed value draws
    seed = zlib.crc32(buckets.tobytes())
    mixed = ((buckets.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    kept = np.sort(np.argsort(mixed, kind="stable")[:most])
    return buckets[kept], counts[kept]


def _bags(texts: pd.Series) -> pd.DataFrame:
    made = [drawn(*bag(text)) for text in texts]
    return pd.DataFrame({"buckets": [b.tobytes() for b, _ in made], "counts": [c.tobytes() for _, c in made]})


@dataclass
class Model:
    """What each bucket adds to the difference of the two logits, and the bias."""

    weights: np.ndarray
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, class_weights: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax trained jointly by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    head = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.maximum(class_weights * np.bincount(labels, minlength=2), 1e-9)).astype(np.float32)
    params = [table, head, bias]
    # one step size for the whole table: scaled one by one, rare n-grams would learn their few documents by heart
    first, second = [np.zeros_like(p) for p in params], [np.zeros(1), np.zeros_like(head), np.zeros_like(bias)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            sizes = np.array([len(bags[i][0]) for i in rows])
            ids = np.concatenate([bags[i][0] for i in rows])
            share = np.concatenate([bags[i][1] / (bags[i][1].sum() + PAD) for i in rows]) * GAIN
            owner = np.repeat(np.arange(len(rows)), sizes)
            pooled = np.stack(
                [np.bincount(owner, share * table[ids, d], minlength=len(rows)) for d in range(WIDTH)], axis=1
            ).astype(np.float32)
            logits = pooled @ head + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = odds / odds.sum(axis=1, keepdims=True)
            slope[np.arange(len(rows)), labels[rows]] -= 1
            weight = class_weights[labels[rows]]
            slope *= (weight / weight.sum())[:, None]
            back = slope @ head.T
            grads = [
                np.stack([np.bincount(ids, share * back[owner, d], minlength=BUCKETS) for d in range(WIDTH)], axis=1),
                pooled.T @ slope,
                slope.sum(axis=0),
            ]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * ((g * g if v.shape == g.shape else (g * g).mean()) - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model((GAIN * (table @ (head[:, 1] - head[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text") -> Model:
    ship(docs.sparkSession)
    rows, totals = training_rows(docs, labels, label, id, text)
    if len(totals) < 2:
        known = {0: -20.0, 1: 20.0}[next(iter(totals), 0)]
        return Model(np.zeros(BUCKETS, np.float32), known)
    sample = rows.select("id", "label", F.pandas_udf(_bags, "struct<buckets: binary, counts: binary>")("text").alias("bag")).collect()
    # sorted here, as a sort by range would make every bag twice
    sample.sort(key=lambda r: r.id)
    bags = [(np.frombuffer(r.bag.buckets, np.int32), np.frombuffer(r.bag.counts, np.float32)) for r in sample]
    marks = np.array([r.label for r in sample], dtype=np.int64)
    # the sample may hold the classes in other shares than the labels do
    weights = np.array([totals[k] / max((marks == k).sum(), 1) for k in (0, 1)], dtype=np.float32)
    return train(bags, marks, weights / weights.max())


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds the probability that a text is toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias, memo = shared.value.weights.astype(np.float64), shared.value.bias, {}

        def logit(content: str | None) -> float:
            total, n = 0.0, 0
            for word, times in Counter(WORD.findall((content or "").lower())).items():
                known = memo.get(word)
                if known is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    own = grams(word)
                    known = memo[word] = (float(weights[own].sum()), len(own))
                weight = 1 + math.log(times)
                total += weight * known[0]
                n += weight * known[1]
            return bias + total / (n + PAD)

        for batch in batches:
            logits = np.array([logit(content) for content in batch], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -60, 60))))

    return docs.withColumn(out, run(F.col(text)))
