"""Operator 2: toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are the words of the lower-cased text and their first letters (``PREFIXES`` bytes of longer words), which stand for stems. All terms of a
bounded sample of labelled examples make the vocabulary; no term of an example is left out. Document frequencies are counted over all documents.
Examples are TF-IDF vectors of unit length, each term's idf times its relevance factor log2(2 + examples of label 1 that hold
it / those of label 0), which is at least 1. Their inverted index is searched exactly: postings of the query's rarer terms are added up; for
the ``HEAVY`` terms of the longest postings each block of examples has the largest weight of each term, which bounds what a block's examples can
still gain; only examples whose bound reaches the k-th best cosine are completed. The distance-weighted vote of the k nearest is calibrated by a
logistic fit on left-one-out votes of the examples themselves. The index is bounded by the sample and goes to every task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, labelled_sample
from .packing import SpanHasher

#: Labelled examples per class in the index.
PER_CLASS = 1500
#: Bytes of a word's beginnings that are terms of their own.
PREFIXES = (4, 6)
#: Terms of the longest postings, which are bounded by block instead of added up.
HEAVY = 256
#: Examples of a block.
BLOCK = 64
K = 15
_KEEP = np.array([i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], dtype=np.uint8).tobytes()
_SPANS = SpanHasher()


def terms_of(text: str | None) -> np.ndarray:
    """Terms of a whole text as 64-bit hashes, with repeats: words of letters and digits, and beginnings of longer words."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(_KEEP)
    b = np.frombuffer(raw, dtype=np.uint8)
    solid = np.zeros(len(b) + 2, dtype=np.int8)
    solid[1:-1] = b != 32
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    hasher = _SPANS.of(b)
    out = [hasher(start, end, 0)]
    for k in PREFIXES:
        longer = start[end - start > k]
        out.append(hasher(longer, longer + k, k))
    return np.concatenate(out)


class Vocabulary:
    """All terms of some texts, in order; a term's position is its number."""

    def __init__(self, texts):
        held = [np.unique(terms_of(t)) for t in texts]
        self.terms = np.unique(np.concatenate(held)) if held else np.empty(0, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.terms)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the text's terms that are known, each once, and how often they come."""
        terms, count = np.unique(terms_of(text), return_counts=True)
        if not len(terms) or not len(self.terms):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return at[known], count[known]


class Index:
    """Block-max inverted index of unit TF-IDF vectors: the postings of term t are ``ptr[t]`` to ``ptr[t + 1]``.

    Examples are kept by label and by their strongest heavy term, so that a block's examples are alike.
    """

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids, texts, y):
        self.vocabulary = vocabulary
        y = np.asarray(y, dtype=np.float64)
        held = [vocabulary.of(t) for t in texts]
        n = np.zeros((2, len(vocabulary)), dtype=np.int64)
        for (t, _), label in zip(held, y, strict=True):
            n[int(label), t] += 1
        # relevance: a term typical of label 1 counts for more, none for less than 1
        self.idf = idf.astype(np.float64) * np.log2(2 + n[1] / np.maximum(n[0], 1))
        n = n.sum(axis=0)
        heavy = np.sort(np.argsort(-n, kind="stable")[:HEAVY])
        self.column = np.full(len(vocabulary), -1, dtype=np.int32)
        self.column[heavy] = np.arange(len(heavy))
        vectors = [self._unit(*h) for h in held]
        strongest = [int(self.column[t][np.argmax(np.where(self.column[t] >= 0, w, -1))]) if len(t) else -1 for t, w in vectors]
        self.order = np.lexsort((strongest, y))
        self.y, self.ids = y[self.order], np.asarray(ids)[self.order]
        vectors = [vectors[i] for i in self.order]
        self.ptr = np.concatenate([[0], np.cumsum(n)])
        self.row, self.w = np.empty(self.ptr[-1], dtype=np.int32), np.empty(self.ptr[-1])
        free = self.ptr[:-1].copy()
        for i, (t, w) in enumerate(vectors):
            self.row[free[t]], self.w[free[t]] = i, w
            free[t] += 1
        self.dense = np.zeros((len(y), len(heavy)))
        for c, t in enumerate(heavy.tolist()):
            at = slice(self.ptr[t], self.ptr[t + 1])
            self.dense[self.row[at], c] = self.w[at]
        self.block = np.arange(len(y)) // BLOCK
        self.most = np.stack([self.dense[lo : lo + BLOCK].max(axis=0) for lo in range(0, len(y), BLOCK)], axis=1)
        self.a, self.b = 1.0, 0.0

    def _unit(self, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(c)) * self.idf[t]
        norm = np.sqrt((w * w).sum())
        return t, w / norm if norm > 0 else w

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self._unit(*self.vocabulary.of(text))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a positive cosine: exact, ties by row."""
        column = self.column[t]
        rare = column < 0
        start, n = self.ptr[t[rare]], self.ptr[t[rare] + 1] - self.ptr[t[rare]]
        at = np.repeat(start - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        cos = np.bincount(self.row[at], weights=self.w[at] * np.repeat(w[rare], n), minlength=len(self.y))
        q = np.zeros(self.dense.shape[1])
        q[column[~rare]] = w[~rare]
        bound = cos + (q @ self.most)[self.block]
        if len(bound) > 2 * k:
            sure = np.argpartition(bound, -2 * k)[-2 * k :]
            least = np.partition(cos[sure] + self.dense[sure] @ q, -k)[-k]
            rows = np.flatnonzero(bound >= least - 1e-9)
        else:
            rows = np.arange(len(bound))
        cos = cos[rows] + self.dense[rows] @ q
        best = np.lexsort((rows, -cos))[:k]
        best = best[cos[best] > 0]
        return rows[best], cos[best]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by the inverse of their distance 1 - cosine; 0 without neighbours."""
        weight = 1 / np.maximum(1 - cos, 1e-3)
        return float(weight @ self.y[rows] / weight.sum()) if len(rows) else 0.0

    def calibrate(self, texts, prior: float, k: int = K) -> "Index":
        """Fit score = sigmoid(a * logit(vote) + b) on votes of the examples, classes reweighted to ``prior``.

        Neither an example nor its twins (other rows of its id, equal texts) are among its own neighbours.
        """
        texts = [texts[i] for i in self.order]
        twin = np.unique(np.array([hash(t) for t in texts]), return_inverse=True)[1]
        most = int(np.bincount(twin).max()) + int(np.unique(self.ids, return_counts=True)[1].max())
        v, wt = [], []
        share = float(np.clip(self.y.mean(), 1e-3, 1 - 1e-3))
        for i, text in enumerate(texts):
            rows, cos = self.nearest(*self.vector(text), k + most)
            other = (twin[rows] != twin[i]) & (self.ids[rows] != self.ids[i])
            v.append(self.vote(rows[other][:k], cos[other][:k]))
            wt.append(prior / share if self.y[i] else (1 - prior) / (1 - share))
        x = self._logit(np.array(v))
        y, wt = self.y, np.array(wt)
        a, b = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(wt * (p - y) * x).sum() + 1e-2 * (a - 1), (wt * (p - y)).sum() + 1e-2 * b])
            h = wt * p * (1 - p)
            hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.a, self.b = max(a, 0.05), b
        return self

    @staticmethod
    def _logit(v):
        v = np.clip(v, 1e-2, 1 - 1e-2)
        return np.log(v / (1 - v))

    def score(self, texts) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, rows and cosines of each text."""
        out = []
        for text in texts:
            rows, cos = self.nearest(*self.vector(text))
            z = self.a * float(self._logit(np.array(self.vote(rows, cos)))) + self.b
            out.append((float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), rows, cos))
        return out


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary term, over all documents, and the number of documents.

    A task sends one row for each term that it has seen, at most the size of the vocabulary.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        n = np.zeros(len(known) + 1, dtype=np.int64)
        for pdf in batches:
            n[-1] += len(pdf)
            for t in pdf["text"]:
                n[known.of(t)[0]] += 1
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"term": seen, "n": n[seen]})

    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    counts = documents.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(documents: DataFrame, labels: DataFrame, *, mod=5, held=0, per_class=PER_CLASS) -> Index | None:
    """Index and calibration from a bounded sample outside the held-out fold; None without labels. Rows given twice count once."""
    rows, prior = labelled_sample(documents, labels, "toxic", mod=mod, held=held, per_class=per_class)
    if rows.empty:
        return None
    texts, y = rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64)
    vocabulary = Vocabulary(texts)
    df, n = document_frequencies(documents, vocabulary)
    index = Index(vocabulary, np.log((n + 1) / (df + 1)) + 0.1, rows["doc_id"].to_numpy(), texts, y)
    return index.calibrate(texts, float(np.clip(prior, 1e-3, 1 - 1e-3)))


def score(documents: DataFrame, index: Index | None, *, mod=5, held=0, threshold=0.5, evidence=3) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the nearest examples (ids and cosines), for every row.

    Texts without a term of any example (empty and null ones too) have no neighbour: their vote is 0, calibrated
    as any other. Without labels every score is 0. Repeated rows and null ids are scored row by row; an empty table gives no rows; other columns are ignored.
    """
    d = documents.select("doc_id", fold_bucket(F.col("doc_id"), mod).eqNullSafe(F.lit(held)).alias("held_out"), F.col("text").alias("_text"))

    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for pdf in batches:
            got = index.score(pdf["_text"].tolist()) if index else [(0.0, np.empty(0, dtype=np.int64), np.empty(0))] * len(pdf)
            s = np.array([g[0] for g in got], dtype=float)
            yield pdf[["doc_id", "held_out"]].assign(
                score=s,
                predicted=(s >= threshold).astype(np.int32),
                neighbours=[index.ids[g[1][:evidence]].astype(np.int64) if index else [] for g in got],
                cosines=[g[2][:evidence] for g in got],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "held_out", "score", "predicted")
