"""Operator 8: language identification with a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length. In a window, each byte is embedded, filters of several
widths slide over it, each filter's largest response (rectified) is kept, and a softmax gives the languages.
Embeddings, filters and softmax are trained in numpy on the driver, on a bounded sample of labelled texts.

For scoring, the trained embedding and filters are tabulated by byte pairs: a filter of width 4 is the sum of two
table rows. That is the same network with fewer operations. All windows of a text count, weighted by their letters.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, stratified_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
PER_LANGUAGE = 1200
#: Training windows per sampled text, spread evenly over the whole text.
WINDOWS_PER_TEXT = 3
EPOCHS = 4
CHUNK = 1024
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """All windows of a text as rows of bytes; the last one is padded with zero bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, size)


class ByteCNN:
    """Embedding, filters of the widths, max pooling over a window, softmax."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = list(classes)
        f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "out": f(FILTERS * len(WIDTHS), len(classes)), "bias": np.zeros(len(classes), dtype=np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"], self.p[f"b{w}"] = f(w * EMBED, FILTERS), np.zeros(FILTERS, dtype=np.float32)

    def _forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        pooled, keep = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
            r = cols @ self.p[f"k{w}"] + self.p[f"b{w}"]
            top = r.argmax(axis=1)
            best = np.take_along_axis(r, top[:, None], axis=1)[:, 0]
            pooled.append(np.maximum(best, 0))
            keep.append((cols, top, best))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["out"] + self.p["bias"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True), h, keep

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> "ByteCNN":
        """Adam on shuffled mini-batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                xb = x[i]
                q, h, keep = self._forward(xb)
                d = q.copy()
                d[np.arange(len(i)), y[i]] -= 1
                d /= len(i)
                g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
                dh = d @ self.p["out"].T
                rows = np.arange(len(i))[:, None]
                for j, w in enumerate(WIDTHS):
                    cols, top, best = keep[j]
                    part = dh[:, j * FILTERS : (j + 1) * FILTERS] * (best > 0)
                    picked = cols[rows, top]  # batch, filter, width * EMBED
                    g[f"k{w}"] = np.einsum("bfc,bf->cf", picked, part)
                    g[f"b{w}"] = part.sum(axis=0)
                    back = part[:, :, None] * self.p[f"k{w}"].T[None]
                    where = xb[rows[:, :, None], top[:, :, None] + np.arange(w)]
                    np.add.at(g["emb"], where.reshape(-1), back.reshape(-1, EMBED))
                step += 1
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def tables(self) -> dict:
        """Filters by byte pair: for width 2 one table, for 3 a pair and a byte, for 4 two pairs."""
        e = self.p["emb"]
        one = {(w, i): e @ self.p[f"k{w}"][i * EMBED : (i + 1) * EMBED] for w in WIDTHS for i in range(w)}
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, FILTERS).astype(np.float32)  # noqa: E731  index: first + 256 * second
        return {"t2": pair(one[2, 0], one[2, 1]), "t3": pair(one[3, 0], one[3, 1]), "t3c": one[3, 2].astype(np.float32), "t4": pair(one[4, 0], one[4, 1]), "t4c": pair(one[4, 2], one[4, 3])}

    def predict(self, x: np.ndarray, t: dict) -> np.ndarray:
        """Class probabilities of windows (rows of bytes), with :meth:`tables`."""
        out = np.empty((len(x), len(self.classes)), dtype=np.float32)
        for at in range(0, len(x), 64):
            b = x[at : at + 64].astype(np.int32)
            two = b[:, :-1] + (b[:, 1:] << 8)
            r2 = t["t2"][two].max(axis=1)
            r3 = (t["t3"][two[:, :-1]] + t["t3c"][b[:, 2:]]).max(axis=1)
            r4 = (t["t4"][two[:, :-2]] + t["t4c"][two[:, 2:]]).max(axis=1)
            h = np.maximum(np.concatenate([r + self.p[f"b{w}"] for w, r in zip(WIDTHS, (r2, r3, r4))], axis=1), 0)
            z = h @ self.p["out"] + self.p["bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 64] = q / q.sum(axis=1, keepdims=True)
        return out


def training_windows(texts: list[str], per_text: int = WINDOWS_PER_TEXT) -> tuple[np.ndarray, np.ndarray]:
    """Windows spread over each whole text and the index of their text."""
    rows, owner = [np.empty((0, WINDOW), dtype=np.uint8)], []
    for i, t in enumerate(texts):
        w = windows_of(t)
        pick = np.unique(np.linspace(0, len(w) - 1, per_text).round().astype(int))
        rows.append(w[pick])
        owner += [i] * len(pick)
    return np.concatenate(rows), np.array(owner, dtype=np.int64)


def fit(documents: DataFrame, *, mod=5, held=0, per_language=PER_LANGUAGE) -> ByteCNN | None:
    """Train on a bounded sample of rows with letters and a language outside the held-out fold; None if there are none.

    Each language is sampled by itself, the rare ones whole; only training windows leave the executors.
    """
    d = documents.select("doc_id", "text", F.col("lang").alias("_y")).where(F.col("text").isNotNull() & F.col("_y").isNotNull() & ~fold_bucket(F.col("doc_id"), mod).eqNullSafe(F.lit(held)))
    d = d.where(F.col("text").rlike(r"\p{L}"))
    some = stratified_sample(d, "_y", "doc_id", per_language).select("_u", "doc_id", "_y", "text")

    def run(batches):
        for pdf in batches:
            x, owner = training_windows(pdf["text"].tolist())
            yield pdf.iloc[owner][["_u", "_y"]].assign(window=[w.tobytes() for w in x])

    languages = max(1, some.select("_y").distinct().count())
    most = int(1.2 * per_language * WINDOWS_PER_TEXT * languages) + 1
    rows = some.mapInPandas(run, f"_u double, _y {documents.schema['lang'].dataType.simpleString()}, window binary").orderBy("_u", "window").limit(most).toPandas()
    if rows.empty:
        return None
    classes = sorted(rows["_y"].unique())
    x = np.frombuffer(b"".join(rows["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    y = rows["_y"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    return ByteCNN(classes).fit(x, y) if len(classes) > 1 else ByteCNN(classes)


def identify(documents: DataFrame, model: ByteCNN | None, *, mod=5, held=0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row over its whole text.

    Null texts and texts without a letter, and all texts where nothing could be learned, are ``und`` with score 0. Repeated rows and null
    ids are judged row by row; an empty table gives no rows; other columns are ignored.
    """
    d = documents.select("doc_id", fold_bucket(F.col("doc_id"), mod).eqNullSafe(F.lit(held)).alias("held_out"), F.col("text").alias("_text"))

    def run(batches):
        tables = model.tables() if model else None
        for pdf in batches:
            n = len(pdf)
            acc = np.zeros((n, len(model.classes) if model else 1))
            pend, size, known = [], 0, np.zeros(n, dtype=bool)

            def flush():
                if pend:
                    x = np.concatenate([w for _, w in pend])
                    owner = np.repeat([i for i, _ in pend], [len(w) for _, w in pend])
                    np.add.at(acc, owner, model.predict(x, tables) * (_IS_LETTER[x].sum(axis=1) + 1e-3)[:, None])
                    pend.clear()

            for i, t in enumerate(pdf["_text"]):
                if model is None or not t or not _LETTER.search(t):
                    continue
                known[i] = True
                w = windows_of(t)
                pend.append((i, w))
                size += len(w)
                if size >= CHUNK:
                    flush()
                    size = 0
            flush()
            total = acc.sum(axis=1, keepdims=True)
            p = acc / np.where(total > 0, total, 1)
            best = p.argmax(axis=1)
            lang = [model.classes[b] if k else "und" for b, k in zip(best, known)]
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=lang, score=np.where(known, p.max(axis=1), 0.0))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, fit(documents))
