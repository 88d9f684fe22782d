"""Operator 5: embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. On each line they are sorted, and around each query lies a window of the
half-width within which a linked vector's projection falls with a known probability. Pairs that collide in at least a
count of windows are verified by cosine in double precision; width and count are chosen by the binomial law so that a pair
exactly at the threshold is missed with a probability of at most ``MISS``.

At this threshold a window on one line holds nearly half of all vectors, so collisions are not written out as rows: they are counted by rank,
a byte per pair and only inside a task. Vectors with one label and one number of components form a group. A group is dealt into blocks by a hash, and each
pair of blocks is one task of bounded size, however large the group: a label that holds a third of all vectors only has more
pairs of blocks. Equal vectors are one class from the start. Tasks return link counts and spanning stars, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _union_find, connected_components

THRESHOLD = 0.93
LINES = 32
#: Half-width of a window, in standard deviations of the projected difference of a pair at the threshold.
WIDTH = 1.6
#: Probability of missing a pair exactly at the threshold.
MISS = 1e-4
#: Vectors per block, on average.
BLOCK = 2048
_CHUNK = 256


def least_collisions(lines: int = LINES, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss or more."""
    p = math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while count <= lines:
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            return count
        count += 1
    return lines


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(20_011 + dim).normal(size=(dim, lines))


def _collisions(pa: np.ndarray, pb: np.ndarray, half: float):
    """For chunks of queries: (first query, counts of window collisions with every row of pb)."""
    n, lines = pb.shape
    rank, low, size = np.empty((lines, n), dtype=np.uint16), [], []
    for j in range(lines):
        order = np.argsort(pb[:, j], kind="stable")
        rank[j, order] = np.arange(n)
        line = pb[order, j]
        lo, hi = np.searchsorted(line, pa[:, j] - half, "left"), np.searchsorted(line, pa[:, j] + half, "right")
        low.append(lo.astype(np.uint16)), size.append((hi - lo).astype(np.int64))
    for at in range(0, len(pa), _CHUNK):
        count = np.zeros((min(_CHUNK, len(pa) - at), n), dtype=np.uint8)
        for j in range(lines):
            lo, m = low[j][at : at + _CHUNK], size[j][at : at + _CHUNK]
            # rank - low wraps around below the window
            inside = (rank[j][None, :] - lo[:, None]) <= np.maximum(m - 1, 0).astype(np.uint16)[:, None]
            count += inside & (m > 0)[:, None]
        yield at, count


def links_between(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, same: bool = False):
    """Row pairs of two blocks of vectors (doubles, not zero) that collide often enough and have the cosine; with ``same``, i < j only."""
    # powers of two: exact, and norms of very large or small components neither overflow nor vanish
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    ua, ub = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    lines = directions(a.shape[1])
    half = WIDTH * math.sqrt(2 - 2 * threshold)
    need = least_collisions()
    xs, ys = [], []
    for at, count in _collisions(ua @ lines, ub @ lines, half):
        x, y = np.nonzero(count >= need)
        x = x + at
        if same:
            x, y = x[x < y], y[x < y]
        for i in range(0, len(x), 65536):
            p, q = x[i : i + 65536], y[i : i + 65536]
            cos = np.einsum("ij,ij->i", a[p], b[q]) / (np.linalg.norm(a[p], axis=1) * np.linalg.norm(b[q], axis=1))
            ok = cos >= threshold
            xs.append(p[ok]), ys.append(q[ok])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spanning(x: np.ndarray, y: np.ndarray):
    nodes, roots = _union_find(x, y)
    keep = nodes != roots
    return nodes[keep], roots[keep]


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Link counts (kind 0: rep, links) and spanning edges (kind 1: rep, root) of one pair of blocks."""
    i, j = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    left = pdf[pdf["block"] == i] if i != j else pdf
    right = pdf[pdf["block"] == j] if i != j else pdf
    if left.empty or right.empty:
        return pd.DataFrame({"kind": np.empty(0, np.int32), "rep": np.empty(0, np.int64), "other": np.empty(0, np.int64)})
    a, b = np.stack(left["vec"].to_numpy()).astype(np.float64), np.stack(right["vec"].to_numpy()).astype(np.float64)
    ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
    ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
    x, y = [], []
    for lo in range(0, len(b), 1 << 15):  # ranks are 16 bits wide
        p, q = links_between(a, b[lo : lo + (1 << 15)]) if i != j or len(b) > 1 << 15 else links_between(a, b, same=True)
        x.append(p), y.append(q + lo)
    x, y = np.concatenate(x), np.concatenate(y)
    if i == j and len(b) > 1 << 15:
        x, y = x[x < y], y[x < y]
    ids = np.concatenate([ra[x], rb[y]])
    links, inv = np.unique(ids, return_inverse=True)
    n = np.bincount(inv, weights=np.concatenate([cb[y], ca[x]]).astype(float), minlength=len(links)).astype(np.int64)
    nodes, roots = _spanning(ra[x], rb[y]) if len(x) else (np.empty(0, np.int64),) * 2
    return pd.concat([pd.DataFrame({"kind": np.int32(0), "rep": links, "other": n}), pd.DataFrame({"kind": np.int32(1), "rep": nodes, "other": roots})])


def near_duplicates(embeddings: DataFrame, scratch: Scratch, *, id_col="vec_id", vec_col="embedding", label_col="label", threshold=THRESHOLD) -> DataFrame:
    """id, n_links (other vectors linked directly), component (smallest id reachable by links) and kept of every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label or id link with
    nothing. Components may be as large or small as doubles are. Vectors with different numbers of components are not compared. Rows that repeat an id are vectors of their own, linked
    if equal, with one component. An empty table gives no rows.
    """
    if threshold != THRESHOLD:
        raise ValueError("the widths are calibrated for THRESHOLD")
    e = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = e.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    good = good.withColumn("key", F.sha2(F.concat(F.col("label").cast("string"), F.lit("|"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")), 256))
    reps = good.groupBy("key", "label").agg(F.min(F.struct("id", "vec")).alias("m"), F.count("*").alias("copies"))
    reps = scratch.write(reps.select("key", "label", F.col("m.id").alias("rep"), F.col("m.vec").alias("vec"), F.size("m.vec").alias("dim"), "copies"), "classes")
    group = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    b = reps.join(group, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda k: F.struct(F.least("block", k).alias("bi"), F.greatest("block", k).alias("bj")))
    dealt = b.select("label", "dim", "rep", "vec", "copies", "block", F.explode(pairs).alias("p")).select("label", "dim", "rep", "vec", "copies", "block", "p.bi", "p.bj")
    found = scratch.write(dealt.groupBy("label", "dim", "bi", "bj").applyInPandas(_block_pair, "kind int, rep long, other long"), "found")
    links = found.where("kind = 0").groupBy("rep").agg(F.sum("other").alias("links"))
    comps = connected_components(found.where("kind = 1").select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    of_class = reps.select("key", "rep", "copies").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = good.select("id", "key").unionByName(e.where(F.col("id").isNull() | F.col("label").isNull() | ~fine).select("id", F.lit(None).cast("string").alias("key")))
    out = rows.join(of_class, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component")))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op5"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


OP5_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
