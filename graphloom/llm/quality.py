"""Operator 3: quality classifier with supervised subword embeddings.

Words and character n-grams are hashed into a table of learned vectors. A document is the average of the vectors
of all its features, over its whole text; a softmax over the average gives its classes. The vectors and the softmax
are trained by stochastic gradient descent in numpy, on the driver, on a bounded sample of labelled documents.

At scoring time the softmax weights are folded into the table: the average of a linear map is the linear map of the
average, so each feature needs one number. Scoring is one pass of batches without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, labelled_sample

#: Labelled documents per class in the training sample.
PER_CLASS = 2500
BUCKETS_LOG2 = 16
DIM = 12
EPOCHS = 6
CHAR_NGRAMS = (2, 3, 4)
THRESHOLD = 0.7

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Feature buckets of a text: its words, repeated words and character n-grams, as int64 indices into 2 ** bits buckets.

    Characters are UTF-8 bytes; runs of ASCII white space part words. An empty or null text has no features.
    """

    def __init__(self, bits: int = BUCKETS_LOG2, sizes=CHAR_NGRAMS):
        self.shift, self.sizes = np.uint64(64 - bits), sizes
        self._pow = self._inv = np.empty(0, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        n = len(raw)
        if not n:
            return np.empty(0, dtype=np.int64)
        b = raw.astype(np.uint64)
        if n > len(self._pow):
            self._pow, self._inv = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        out, gram = [], b
        for k in range(2, max(self.sizes) + 1):
            if n < k:
                break
            gram = gram[:-1] | (b[k - 1 :] << np.uint64(8 * (k - 1)))
            if k in self.sizes:
                out.append(((gram + np.uint64(k)) * _MIX) >> self.shift)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b + np.uint64(1)) * self._pow[:n])])
            words = ((total[ends] - total[starts]) * self._inv[starts] ^ np.uint64(0x5851F42D4C957F2D)) * _MIX
            out.append(words >> self.shift)
            # word bigrams back off to whether a word repeats the one before: one bucket of its own
            out.append(np.zeros(int((words[1:] == words[:-1]).sum()), dtype=np.uint64))
        return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def train(texts: list[str], labels: np.ndarray, prior: float, *, bits=BUCKETS_LOG2, dim=DIM, epochs=EPOCHS, rate=0.8, seed=7) -> tuple[np.ndarray, float]:
    """Train the embeddings and the softmax; return (logit per bucket, bias) with classes reweighted to ``prior``.

    The logit of a document is the mean of its buckets' logits plus the bias. Without both classes in the sample,
    the logit is that of the prior alone.
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    edge = float(np.clip(prior, 1e-3, 1 - 1e-3))
    offset = np.log(edge / (1 - edge))
    if share in (0.0, 1.0):
        return np.zeros(1 << bits, dtype=np.float32), offset
    rng = np.random.default_rng(seed)
    hasher = Hasher(bits)
    docs = []
    for t in texts:
        ids, counts = np.unique(hasher(t), return_counts=True)
        docs.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    table = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            mean = part @ table[ids] if len(ids) else np.zeros(dim, dtype=np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            lr = np.float32(rate * (1 - done / steps) * weight[i])
            back = soft @ p
            soft -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            if len(ids):
                # a document's features share one gradient; scaled up, as the mean spreads it thinly
                table[ids] -= (lr * np.float32(20.0)) * part[:, None] * back[None, :]
            done += 1
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + offset


def fit(documents: DataFrame, labels: DataFrame, *, label="quality", mod=4, held=2, per_class=PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled documents outside the held-out fold; without labels every score is 0.5."""
    rows, prior = labelled_sample(documents, labels, label, mod=mod, held=held, per_class=per_class)
    return train(rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64), 0.5 if prior is None else prior)


def score(documents: DataFrame, model: tuple[np.ndarray, float], *, mod=4, held=2, threshold=THRESHOLD, keep=()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of ``keep``, for every row over its whole text.

    A null or empty text has no features and gets the score of the bias. Repeated ids and null ids are scored row by row; an empty table gives no rows.
    """
    logits, bias = model
    bits = int(np.log2(len(logits)))
    d = documents.select("doc_id", fold_bucket(F.col("doc_id"), mod).eqNullSafe(F.lit(held)).alias("held_out"), F.col("text").alias("_text"), *[F.col(c).alias(f"_k_{c}") for c in keep])

    def run(batches):
        hasher = Hasher(bits)
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, t in enumerate(pdf["_text"]):
                ids = hasher(t)
                out[i] = bias + (float(logits[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
            s = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pdf.drop(columns="_text").assign(score=s, predicted=(s >= threshold).astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_text").schema)
    res = d.mapInPandas(run, f"{fields}, score double, predicted int")
    return res.withColumnsRenamed({f"_k_{c}": c for c in keep})


def op3_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def accept(documents: DataFrame, model: tuple[np.ndarray, float], *, threshold=THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns as they are.

    Every row is judged by its text alone, so repeated rows and null ids are as any other; a null or empty text has the score of the bias. An empty table stays empty.
    """
    logits, bias = model
    bits = int(np.log2(len(logits)))
    least = np.log(threshold / (1 - threshold))

    def run(batches):
        hasher = Hasher(bits)
        for batch in batches:
            keep = []
            for t in batch.column("text"):
                ids = hasher(t.as_py())
                keep.append(bias + (float(logits[ids].mean(dtype=np.float64)) if len(ids) else 0.0) >= least)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
