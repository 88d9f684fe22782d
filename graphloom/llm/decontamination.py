"""Operator 7 [native]: benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``window`` consecutive words, a window a sequence of word shingles. All of
a window's shingles are necessary for its occurrence, so its rarest one alone is joined (the necessary prefix of a
containment of 100 %). Rarity is counted over all documents. Positions give the start that an occurrence would
have; starts outside the document's length are dropped, and the rest is verified word by word on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Characters between words, after lower-casing A-Z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Most benchmark shingles (distinct 8-byte hashes) that are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win): windows of each item; an item of fewer words is one window, of no words none."""
    b = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return b.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()


def _shingles(words: Column, q: int) -> Column:
    """Array of (w0..wq-1) structs, the last q - 1 of them with null words."""
    return F.arrays_zip(*[(words if i == 0 else F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0)))).alias(f"w{i}") for i in range(q)])


def _hash(q: int) -> Column:
    return F.xxhash64(F.lit(q), *[F.col(f"w{i}") for i in range(q)])


def _rows(df: DataFrame, keep: list[str], words: str, q: int) -> DataFrame:
    """(keep, pos from 0, h) for each whole shingle of q words."""
    z = _shingles(F.col(words), q)
    r = df.select(*keep, F.posexplode(z).alias("pos", "z"))
    r = r.select(*keep, "pos", *[F.col("z").getField(f"w{i}").alias(f"w{i}") for i in range(q)])
    return r.where(F.col(f"w{q - 1}").isNotNull()).select(*keep, "pos", _hash(q).alias("h"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", window=WINDOW, keep=()) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids as strings), spans (start, length in words), columns of ``keep``.

    A document word is hit if an occurrence of a benchmark window covers it. Null and empty texts have no words; an
    empty benchmark hits nothing; repeated documents (with one id or many) are each reported; repeated items count
    once by their id; a null item id counts as the text ``null``.
    """
    spark = documents.sparkSession
    benchmark = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    wins = scratch.write(benchmark_windows(benchmark, window).withColumn("wid", F.xxhash64("win")), "windows")
    shapes = wins.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("q")).distinct().collect()  # at most SHINGLE values
    distinct = wins.select("wid", "win").distinct()
    d = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    d = d.withColumn("_r", F.xxhash64("_id", "_text")).withColumn("_r2", F.hash("_text", "_id"))

    # every occurrence in the corpus of a shingle that some window has
    found, own = None, None
    for q in sorted(r["q"] for r in shapes):
        mine = distinct.where(F.least(F.size("win"), F.lit(SHINGLE)) == q)
        of_win = _rows(mine.withColumn("len", F.size("win")), ["wid", "len"], "win", q)
        of_doc = _rows(d.select("_r", "_r2", words_of(F.col("_text")).alias("w")).withColumn("n", F.size("w")), ["_r", "_r2", "n"], "w", q)
        keys = scratch.write(of_win.select("h").distinct(), f"keys{q}")
        small = keys.count() <= BROADCAST_SHINGLES
        hit = of_doc.join(F.broadcast(keys) if small else keys, "h")
        found = hit if found is None else found.unionByName(hit)
        own = of_win if own is None else own.unionByName(of_win)
    if found is None:
        found = d.limit(0).select("_r", "_r2", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"))
        own = distinct.limit(0).select("wid", F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"))
    found = scratch.write(found, "found")
    own = scratch.write(own, "own")

    # the rarest shingle of each window; a window with an absent shingle occurs nowhere
    df = found.groupBy("h").agg(F.count("*").alias("df"))
    rare = own.join(df, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos").alias("offset"), "h", "len")).alias("p"))
    rare = rare.where("p.df > 0").select("wid", "p.offset", "p.h", "p.len")
    cand = found.join(rare, "h").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 AND start + len <= n")
    cand = cand.select("_r", "_r2", "wid", "start", "len").distinct()
    cand = cand.join(distinct, "wid").select("_r", "_r2", F.struct("start", "len", "wid", "win").alias("c"))
    cand = cand.groupBy("_r", "_r2").agg(F.collect_list("c").alias("cs"))

    out = d.join(cand, ["_r", "_r2"], "left").withColumn("w", words_of(F.col("_text"))).drop("_text")
    real = F.filter(F.coalesce("cs", F.array().cast(cand.schema["cs"].dataType)), lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["win"])
    out = out.withColumn("real", real).withColumn("n_words", F.size("w").cast("long")).drop("w", "cs")
    spans = F.array_sort(F.array_distinct(F.transform("real", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("length")))))
    hits = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    out = out.withColumn("spans", spans).withColumn("n_hit", hits.cast("long"))
    out = out.withColumn("wids", F.array_distinct(F.transform("real", lambda c: c["wid"]))).drop("real")

    # items of the windows that occur, for the few documents that have any
    some = scratch.write(out, "judged")
    pairs = some.where("n_hit > 0").select("_r", "_r2", F.explode("wids").alias("wid")).distinct().join(wins.select("wid", "item_id"), "wid").select("_r", "_r2", "item_id").distinct()
    items = pairs.groupBy("_r", "_r2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    res = some.join(items, ["_r", "_r2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return res.select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", "spans", *[F.col(f"_k_{c}").alias(c) for c in keep if c != id_col])


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    d = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op7"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM wins
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), occ AS (
  SELECT doc_id, grams.k, i, item_id FROM grams JOIN wins ON grams.k = wins.k AND grams.win = wins.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
