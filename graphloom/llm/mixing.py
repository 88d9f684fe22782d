"""Operator 10 [native]: mixing sources to target weights by a time-varying curriculum.

Each source has a word target. A weight schedule per source says how densely its words are asked for along
training time t in [0, 1]. The schedule is integrated, the cumulative demand of a source is inverted at the
cumulative word count of each of its documents, and documents are range-sorted by the times found.

Everything is DataFrame functions. Cumulative sums run in two levels (bins of a hash order, then inside a bin), so
a source that holds a third of all rows is spread over as many windows as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, Scratch, default_partitions

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of a source that the mix may take, as a multiple of what the source has.
MAX_EPOCHS = 3
#: Linear demand densities along t, dealt like the weights: density at t=0 and t=1; their mean is 1.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: Documents per bin of the hash order, on average.
BIN_ROWS = 20_000
LEAST_BINS = 64


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _dealt(rank: Column, values) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(rank % len(values) == i, F.lit(v)).otherwise(out)
    return out


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add rank, weight and target to one row per source (source, source_size).

    Targets share the sum of all sizes by weight and stop at ``max_epochs`` times a source's size; the excess is
    reshared by weight until none is above. That fixed point is a water level: with sources ordered by the level
    at which they stop, it is found by prefix sums. One row per source enters the window, never documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", _dealt(F.col("rank"), weights).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("stop", F.col("cap") / F.col("weight"))
    order = W.orderBy("stop", "rank")
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the first source, in the order of stops, that the level does not reach its stop fixes the level
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(everything)["level"]
    s = s.withColumn("lambda", level)
    target = F.when(F.col("lambda").isNull() | (F.col("stop") < F.col("lambda")), F.col("cap").cast("double")).otherwise(F.col("lambda") * F.col("weight"))
    return s.withColumn("target", target.cast("double")).select("source", "source_size", "rank", "weight", "target")


def _order_key(id_col: str, text_col: str) -> Column:
    """An order of documents that their source and size do not tell: md5 of id and text, so that rows of one id, or of none, are spread too."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))


def demand_time(share: Column, start: Column, end: Column) -> Column:
    """Invert the integral of a linear density from ``start`` to ``end`` at ``share`` of its total: a time in [0, 1]."""
    slope = end - start
    total = (start + end) / 2
    root = (-start + F.sqrt(F.greatest(start * start + 2 * slope * share * total, F.lit(0.0)))) / slope
    t = F.when(F.abs(slope) < 1e-12, share).otherwise(root)
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def mix(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """One row per document: id, source, size, source_size, weight, target, taken, copies, the times of its copies, and a hash of the text.

    ``taken`` is how many words the mix takes: whole epochs of its source, and in the last, partial epoch the
    documents that come first in an md5 order of id and text, the last of them in part, so that a source's words sum to its
    target but for less than one word. ``times`` holds one training time per copy, the partial one last.

    Null text has size 0 and is never taken; null source is a source of its own, after the others; repeated ids are
    rows of their own; an empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    sized = documents.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_h"), _order_key(id_col, text_col).alias("_key"))
    sized = scratch.write(sized, "sizes")
    n = sized.count()
    bins = max(LEAST_BINS, 1 << (n // BIN_ROWS).bit_length())
    sources = scratch.write(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "sources")

    keyed = sized.withColumn("_bin", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * bins / (1 << 32))
    keyed = keyed.withColumn("_bin", F.floor("_bin").cast("long"))
    per_bin = keyed.groupBy("source", "_bin").agg(F.sum("size").alias("_in_bin"))
    upto = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bin.withColumn("_start", F.coalesce(F.sum("_in_bin").over(upto), F.lit(0))).drop("_in_bin")
    starts = starts.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = W.partitionBy("source", "_bin").orderBy("_key", "_id", "size", "_h").rowsBetween(W.unboundedPreceding, -1)
    d = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    starts = starts.withColumnsRenamed({"source": "_s", "_bin": "_b"})
    d = d.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).drop("_s", "_b")

    d = d.withColumn("_before", F.col("_start") + F.col("_inside"))
    d = d.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    left = F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long")
    d = d.withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("_before"))))
    d = d.withColumn("taken", F.col("_epochs") * F.col("size") + F.col("_part"))
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("_epochs") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0).cast("long")))
    start, end = _dealt(F.col("rank"), [float(a) for a, _ in schedules]), _dealt(F.col("rank"), [float(b) for _, b in schedules])
    middle = F.col("_before") + F.col("size") / 2.0
    at = lambda copy: demand_time(F.least((middle + copy * F.col("source_size")) / F.col("target"), F.lit(1.0)), start, end)
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    d = d.withColumn("times", times)
    return d.select(F.col("_id").alias(id_col), "source", "size", "source_size", "weight", "target", "taken", "copies", "times", F.col("_h").alias("row_hash"))


def in_training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of a mix as rows (id, copy, position), range-sorted by position; untaken documents are left out."""
    rows = plan.select(id_col, F.posexplode("times").alias("copy", "position"))
    return rows.repartitionByRange(default_partitions(plan.sparkSession), "position", id_col, "copy").sortWithinPartitions("position", id_col, "copy")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed; rows are range-sorted by the first training time, untaken ones last."""
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op10"))
    first = F.coalesce(F.try_element_at("times", F.lit(1)), F.lit(2.0))
    rows = plan.withColumn("_at", first).repartitionByRange(default_partitions(spark), "_at", "doc_id").sortWithinPartitions("_at", "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), s1 AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s0
), s2 AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS stop FROM s1
), s3 AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY stop, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2
), s4 AS (
  SELECT *, (SELECT level FROM s3 WHERE level <= stop ORDER BY stop, rank LIMIT 1) AS lvl FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN lvl IS NULL OR stop < lvl THEN CAST(cap AS DOUBLE) ELSE lvl * weight END AS target FROM s4
), d AS (
  SELECT z.doc_id, z.size, s5.source_size, s5.target,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(CASE WHEN s5.source_size > 0 THEN floor(s5.target / s5.source_size) ELSE 0 END AS BIGINT) AS epochs
  FROM sized z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM d
"""
