"""Operator 6: substring dedup by level-wise doubling.

Windows of ``base`` words that occur once are dropped; windows that repeat are extended to twice their length, and so
on, until the wanted length: a longer window can repeat only where its halves do. On the first level only the
minimizers of the wanted windows are compared (the smallest name among the base windows inside one): equal windows have equal minimizers at equal
places, so no repeat is lost and a sixth of the positions is shuffled. Names are 64-bit hashes, and the bucket adds
independent bits.

Inside a batch, repeats of a name are settled at once; only the earliest place of each name is sent on. A passage that
a third of all documents share costs a bucket one entry per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .packing import as_array, bucket_of, double, hashes, slices, space_words, window_names

WINDOW = 20
BASE = 10
#: Words of the corpus per bucket of the packed shuffles.
WORDS_PER_BUCKET = 2_000_000
#: Words of the corpus per group in which places return to their documents.
WORDS_PER_HOME = 4_000_000
#: Words of a batch that are packed together at most.
WORDS_PER_PACK = 1_200_000
_PACKED = "bucket long, kind int, ids binary, hs binary, doc binary, pos binary, name binary"
_HOMES = "home long, ids binary, hs binary, doc binary, pos binary"
_PLACES = "_id long, _h long, places binary"


def _pack(ids, hs, doc, pos, name, buckets: int, tag: int):
    """Rows of a packed shuffle. kind 0: the earliest place of each name, to be compared; kind 1: places known to repeat a name.

    ``tag`` 0 marks every place of a repeated name, the earliest one too; 1 marks the later places alone. Places compare as (id, position).
    """
    order = np.lexsort((pos, ids[doc], name))
    doc, pos, name = doc[order], pos[order], name[order]
    first = np.ones(len(name), dtype=bool)
    first[1:] = name[1:] != name[:-1]
    run = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    again = ~first
    if tag:
        # places equal to the earliest one (a row given twice) are not later
        again &= (ids[doc] != ids[doc[head[run]]]) | (pos != pos[head[run]])
    else:
        again = np.bincount(run, minlength=len(head))[run] > 1
    known = np.zeros(len(head), dtype=bool)
    known[run[again]] = True
    same_place = ~first & ~again if tag else np.zeros(len(name), dtype=bool)
    out = []

    def rows(pick, bucket, kind):
        d = doc[pick]
        used, local = np.unique(d, return_inverse=True)
        return (bucket, kind, ids[used].tobytes(), hs[used].tobytes(), local.astype(np.int32).tobytes(), pos[pick].astype(np.int32).tobytes(), name[pick].tobytes() if kind == 0 else b"")

    send = np.flatnonzero(first | same_place)
    b = bucket_of(name[send], buckets)
    by = np.argsort(b, kind="stable")
    for value, lo, hi in slices(b[by]):
        out.append(rows(send[by[lo:hi]], value, 0))
    if again.any():
        spread = buckets + int(name[0] % np.uint64(max(1, buckets))) if len(name) else buckets
        out.append(rows(np.flatnonzero(again), spread, 1))
    return pd.DataFrame(out, columns=["bucket", "kind", "ids", "hs", "doc", "pos", "name"])


def _packer(entries, buckets: int, tag: int):
    """mapInPandas function: ``entries(pdf row)`` gives (positions, names, words seen) of a document."""

    def run(batches):
        for pdf in batches:
            ids, hs, doc, pos, name, seen = [], [], [], [], [], 0

            def flush():
                if pos:
                    n = [len(p) for p in pos]
                    yield _pack(np.array(ids, dtype=np.int64), np.array(hs, dtype=np.int64), np.repeat(np.arange(len(ids)), n), np.concatenate(pos), np.concatenate(name), buckets, tag)

            for row in pdf.itertuples(index=False):
                p, x, words = entries(row)
                if len(p):
                    ids.append(row._0)
                    hs.append(row._1)
                    pos.append(p)
                    name.append(x)
                    seen += words
                if seen > WORDS_PER_PACK:
                    yield from flush()
                    ids, hs, doc, pos, name, seen = [], [], [], [], [], 0
            yield from flush()

    return run


def _compare(tag: int, homes: int):
    """applyInPandas function on a bucket: the places whose name repeats (tag 0), or repeats an earlier place (tag 1).

    They go back to their documents packed, one row per home: a document has places in many buckets, and a row for each
    pair of document and bucket would grow with the number of buckets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, hs, pos = [], [], []
        parts = []
        for r in pdf.itertuples(index=False):
            i, h, d, p = as_array(r.ids, np.int64), as_array(r.hs, np.int64), as_array(r.doc, np.int32), as_array(r.pos, np.int32)
            if r.kind:
                ids.append(i[d]), hs.append(h[d]), pos.append(p)
            else:
                parts.append((i[d], h[d], p, as_array(r.name, np.uint64)))
        if parts:
            i, h, p, x = (np.concatenate([q[k] for q in parts]) for k in range(4))
            order = np.lexsort((p, i, x))
            i, h, p, x = i[order], h[order], p[order], x[order]
            first = np.ones(len(x), dtype=bool)
            first[1:] = x[1:] != x[:-1]
            run_no = np.cumsum(first) - 1
            if tag:
                head = np.flatnonzero(first)
                pick = (i != i[head[run_no]]) | (p != p[head[run_no]])
            else:
                pick = np.bincount(run_no)[run_no] > 1
            ids.append(i[pick]), hs.append(h[pick]), pos.append(p[pick])
        if not ids or not sum(map(len, ids)):
            return pd.DataFrame(columns=["home", "ids", "hs", "doc", "pos"])
        i, h, p = np.concatenate(ids), np.concatenate(hs), np.concatenate(pos)
        home = bucket_of(i.view(np.uint64) ^ h.view(np.uint64), homes)
        order = np.lexsort((h, i, home))
        i, h, p, home = i[order], h[order], p[order], home[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1])
        out = []
        for value, lo, hi in slices(home):
            head = lo + np.flatnonzero(new[lo:hi])
            out.append((value, i[head].tobytes(), h[head].tobytes(), (np.cumsum(new[lo:hi]) - 1).astype(np.int32).tobytes(), p[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=["home", "ids", "hs", "doc", "pos"])

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function on a home: one row per document with all its places, each once."""
    parts = [(as_array(r.ids, np.int64), as_array(r.hs, np.int64), as_array(r.doc, np.int32), as_array(r.pos, np.int32)) for r in pdf.itertuples(index=False)]
    i, h, p = np.concatenate([q[0][q[2]] for q in parts]), np.concatenate([q[1][q[2]] for q in parts]), np.concatenate([q[3] for q in parts])
    order = np.lexsort((p, h, i))
    i, h, p = i[order], h[order], p[order]
    cut = np.flatnonzero((i[1:] != i[:-1]) | (h[1:] != h[:-1])) + 1
    starts = np.concatenate([[0], cut])
    return pd.DataFrame({"_id": i[starts], "_h": h[starts], "places": [np.unique(x).tobytes() for x in np.split(p, cut)]})


def _minimizers(names: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` names, the place of its smallest one (the leftmost of equals)."""
    if len(names) < span:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(names, span)
    return view.argmin(axis=1) + np.arange(len(view))


def repeated_windows(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", window=WINDOW, base=BASE) -> DataFrame:
    """(_id, _h, places): per document (id and text hash) with any, the starts of its windows that also start earlier, as int32 bytes.

    ``window`` must be ``base`` times a power of two.
    """
    levels = []
    while (length := base << len(levels)) < window:
        levels.append(length)
    if length != window or not levels:
        raise ValueError("window must be base times a power of two, and longer than base")
    d = _keyed(documents, id_col, text_col)
    chars = documents.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(8, int(chars // (6 * WORDS_PER_BUCKET)) + 1)
    homes = max(8, int(chars // (6 * WORDS_PER_HOME)) + 1)
    span = window - base + 1

    def anchors(row):
        words = space_words(row._2)
        if len(words) < window:
            return (), (), 0
        names = window_names(hashes(words), base)
        at = np.unique(_minimizers(names, span))
        return at, names[at], len(words)

    def compared(packed: DataFrame, tag: int) -> DataFrame:
        back = packed.groupBy("bucket").applyInPandas(_compare(tag, homes), _HOMES)
        return back.groupBy("home").applyInPandas(_gather, _PLACES)

    places = compared(d.toDF("_0", "_1", "_2").mapInPandas(_packer(anchors, buckets, 0), _PACKED), 0)
    # later levels: windows of each length whose anchor and halves repeat
    for level, length in enumerate(levels):
        last = length * 2 == window
        held = scratch.write(places, f"places{length}")
        again = d.join(held, ["_id", "_h"]).select("_id", "_h", "_text", "places").toDF("_0", "_1", "_2", "_3")

        def longer(row, length=length, level=level):
            words = space_words(row._2)
            names = window_names(hashes(words), base)
            mine = np.zeros(len(names), dtype=bool)
            mine[as_array(row._3, np.int32)] = True
            if level == 0:
                # wanted windows with a repeated anchor; on this level every window inside one
                want = mine[_minimizers(names, span)]
            else:
                want = np.zeros(max(0, len(words) - window + 1), dtype=bool)
                half = mine[: len(words) - length + 1]
                for i in range(0, window - length + 1, length):
                    part = half[i : i + len(want)]
                    want[: len(part)] |= part
                    want &= np.pad(part, (0, len(want) - len(part)))
            for k in range(level + 1):
                names = double(names, base << k)
            if length * 2 == window:
                at = np.flatnonzero(want)
            else:
                cover = np.zeros(len(names) + 1, dtype=np.int32)
                starts = np.flatnonzero(want)
                np.add.at(cover, starts, 1)
                np.add.at(cover, np.minimum(starts + window - 2 * length + 1, len(names)), -1)
                at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            return at, names[at], len(words)

        places = compared(again.mapInPandas(_packer(longer, buckets, int(last)), _PACKED), int(last))
    return places


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h: hash of the text, _text); a null id sorts before all others."""
    low = F.lit(-(1 << 63)).cast("long")
    d = documents.select(F.coalesce(F.col(id_col).cast("long"), low).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    return d


def remove_repeats(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", window=WINDOW, base=BASE) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 of every row.

    A word goes if a window of ``window`` words covers it whose words also start earlier (smaller id, or the same id and
    an earlier start). Null and empty texts have no words; shorter texts lose nothing. Rows that repeat an id are one document:
    equal places are not earlier than each other, so a row given twice keeps its words twice. Null ids come first.
    """
    places = repeated_windows(documents, scratch, id_col=id_col, text_col=text_col, window=window, base=base)
    spans = scratch.write(places, "repeats")
    d = _keyed(documents, id_col, text_col).join(spans, ["_id", "_h"], "left").select("_id", "_text", "places")

    def run(batches):
        for pdf in batches:
            out = []
            for i, text, places in pdf.itertuples(index=False):
                words = space_words(text)
                gone = 0
                n = len(words)
                if places is not None:
                    cover = np.zeros(n + 1, dtype=np.int32)
                    starts = as_array(places, np.int32)
                    cover[starts] += 1
                    np.add.at(cover, starts + window, -1)
                    keep = np.cumsum(cover[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    gone = n - len(words)
                kept = b" ".join(words)
                out.append((None if i == -(1 << 63) else i, n, gone, kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            res = pd.DataFrame(out, columns=["_id", "n_words", "n_removed", "kept", "kept_sha256"])
            res["_id"] = res["_id"].astype("Int64")
            yield res

    return d.mapInPandas(run, "_id long, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("_id", id_col)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op6"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM dup)
), word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
