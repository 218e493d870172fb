"""Quality classifier (operator 8): random-indexing word vectors, pooled, under a two-layer network.

Every token (a run of letters and digits, or of other signs) is hashed to one of ``WORDS`` entries. An entry
has a fixed sparse random index vector, and its word vector is the sum of the index vectors of all tokens found within
``WINDOW`` places of it, over all documents: tasks sum their part, Spark adds the parts up, and the result has a
fixed size. A document is the mean and the spread of its tokens' normalised word vectors. A network with one
hidden layer, trained in numpy on a bounded sample of labelled documents, gives a logit, which a temperature fitted on a
part of the sample kept aside turns into a calibrated probability.

Texts are read whole. Null, empty and tokenless texts pool to zeros and are scored as such. Labels of
held-out documents, source, language and id are never inputs. Without labels of both classes every score is
the share of the class there is (0 without labels). Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import ship
from pluvio.llm.labelled import training_rows

WORDS, WIDTH, NONZERO, WINDOW = 1 << 13, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 0.01, 1e-4
# One in so many sampled rows is kept aside for the temperature.
ASIDE = 5
HELD = 1 << 20
MEMO = 1 << 17
TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, one per entry."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS + 1, WIDTH), np.float32)  # the last entry parts documents
    for row in out[:-1]:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


class Entries:
    """Entries of a text's tokens, with a bounded memory of earlier ones."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> list[int]:
        memo, out = self.memo, []
        for token in TOKEN.findall(text or ""):
            entry = memo.get(token)
            if entry is None:
                if len(memo) >= MEMO:
                    memo.clear()
                entry = memo[token] = zlib.crc32(token.encode()) % WORDS
            out.append(entry)
        return out


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    entries, index = Entries(), index_vectors()
    sums, waiting, n = np.zeros((WORDS + 1, WIDTH)), [], 0

    def add() -> None:
        ids = np.concatenate(waiting)
        for d in range(WIDTH):
            signs = index[ids, d]
            near = np.zeros(len(ids), np.float32)
            for k in range(1, WINDOW + 1):
                near[k:] += signs[:-k]
                near[:-k] += signs[k:]
            sums[:, d] += np.bincount(ids, near, minlength=WORDS + 1)

    gap = np.full(WINDOW, WORDS, np.int32)
    for batch in batches:
        for text in batch["text"]:
            own = entries(text)
            waiting += [np.array(own, np.int32), gap]
            n += len(own) + WINDOW
            if n >= HELD:
                add()
                waiting, n = [], 0
    if waiting:
        add()
    used = np.flatnonzero(np.abs(sums[:-1]).sum(axis=1))
    yield pd.DataFrame({"entry": used} | {f"v{d}": np.rint(sums[used, d]).astype(np.int64) for d in range(WIDTH)})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Normalised word vector of every entry, from all documents; the table has a fixed size."""
    ship(docs.sparkSession)
    names = [f"v{d}" for d in range(WIDTH)]
    parts = docs.select(F.col(text).alias("text")).mapInPandas(_contexts, "entry int, " + ", ".join(f"{v} long" for v in names))
    rows = parts.groupBy("entry").agg(*[F.sum(v).alias(v) for v in names]).toPandas()
    out = np.zeros((WORDS, WIDTH), np.float32)
    out[rows["entry"].to_numpy(dtype=np.int64)] = rows[names].to_numpy(dtype=np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return (np.tanh((pooled - mean) / scale @ w1 + b1) @ w2 + b2)[:, 0] / self.temperature


def pool(vectors: np.ndarray, ids: list[int]) -> np.ndarray:
    """Mean and spread of the tokens' vectors."""
    if not ids:
        return np.zeros(2 * WIDTH)
    seen, times = np.unique(np.array(ids, np.int32), return_counts=True)
    own, share = vectors[seen].astype(np.float64), times / times.sum()
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))])


def pooled_column(docs: DataFrame, vectors: np.ndarray, text: str):
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries = Entries()
        for batch in batches:
            yield pd.Series([pool(shared.value, entries(content)) for content in batch], dtype=object)

    return run(F.col(text))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> tuple[list[np.ndarray], float]:
    """Layers fitted by Adam, and the temperature with the least loss on the rows kept aside."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % ASIDE == 0
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    params = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    fitted, step = np.flatnonzero(~aside), 0
    for _ in range(EPOCHS):
        order = rng.permutation(fitted)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            chance = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -60, 60)[:, 0]))
            slope = ((chance - y[rows]) * weight[rows] / weight[rows].sum())[:, None]
            back = (slope @ params[2].T) * (1 - hidden * hidden)
            grads = [z[rows].T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    layers = [mean, scale, *params]
    raw, truth, w = Model(np.empty(0), layers, 1.0).logits(x[aside]), y[aside], weight[aside]

    def loss(t: float) -> float:
        return float((w * (np.logaddexp(0, raw / t) - truth * raw / t)).sum())

    return layers, min(np.geomspace(0.25, 8, 61), key=loss)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> Model:
    rows, totals = training_rows(docs, labels, label, id, text)
    if len(totals) < 2:
        known = {0: -20.0, 1: 20.0}[next(iter(totals), 0)]
        flat = [np.zeros(2 * WIDTH), np.ones(2 * WIDTH), np.zeros((2 * WIDTH, 1)), np.zeros(1), np.zeros((1, 1)), np.array([known])]
        return Model(np.zeros((WORDS, WIDTH), np.float32), flat, 1.0)
    vectors = word_vectors(docs, text)
    sample = rows.select("id", "label", pooled_column(docs, vectors, "text").alias("pooled")).orderBy(F.xxhash64("id"), "id").collect()
    y = np.array([r.label for r in sample], dtype=np.float64)
    weight = np.where(y > 0, totals[1] / max((y > 0).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    layers, temperature = train(np.array([r.pooled for r in sample]), y, weight)
    return Model(vectors, layers, float(temperature))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds the calibrated probability that a text is of good quality."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries, fitted = Entries(), shared.value
        for batch in batches:
            pooled = np.array([pool(fitted.vectors, entries(content)) for content in batch]).reshape(-1, 2 * WIDTH)
            yield pd.Series(1 / (1 + np.exp(-np.clip(fitted.logits(pooled), -60, 60))))

    return docs.withColumn(out, run(F.col(text)))
