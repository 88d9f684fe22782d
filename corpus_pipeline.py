"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard, mixing, quality, tokens
from graphloom.llm.common import Scratch, bounded, default_partitions

#: Sequences within which the last stage permutes: the order of training that mixing has made survives between segments.
SEGMENT = 16 * tokens.SHARD_ROWS


def quality_classifier(spark, docs, sf_dir):
    """Documents that the quality classifier, trained on the labelled ones among ``docs``, does not accept go.

    Every row is judged by its whole text alone: null ids, repeated rows and null texts (which get the score of the classifier's bias) too.
    Without labels all scores are 0.5 and nothing is accepted. An empty table stays empty. Columns come back as they are.
    """
    return quality.accept(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark, docs, sf_dir):
    """Of each group of near copies the row of the smallest id stays; of rows equal in id and text one.

    Rows with a null id and texts without words are no copies and stay. A row whose text is unlinked stays even if its id is repeated elsewhere.
    """
    return jaccard.keep_one(docs, Scratch(spark, "pipeline-jaccard"))


def benchmark_decontamination(spark, docs, sf_dir):
    """Rows with a word covered by a benchmark window go, whatever their id (null or repeated): the text decides. Null and empty texts stay."""
    rows = docs.withColumns({"_graphloom_h": F.xxhash64("text"), "_graphloom_h2": F.hash("text")})
    scratch = Scratch(spark, "pipeline-decontamination")
    d = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch, keep=("_graphloom_h", "_graphloom_h2"))
    dirty = scratch.write(d.where("n_hit > 0").select("_graphloom_h", "_graphloom_h2").distinct(), "dirty")
    return rows.join(bounded(dirty), ["_graphloom_h", "_graphloom_h2"], "left_anti").select(docs.columns)


def source_mixing(spark, docs, sf_dir):
    """Sources mixed to their target weights; documents come as often as the mix takes them, range-partitioned and sorted by training time.

    A last, partial copy counts as a copy when at least half of its words are taken. Null ids are taken as any other; of rows equal in id, text
    and source, one stands for all, as often as all are taken together; texts without words are never taken. An empty table stays empty.
    """
    scratch = Scratch(spark, "pipeline-mixing")
    plan = mixing.mix(docs, scratch)
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    plan = plan.select("doc_id", F.col("row_hash").alias("h"), "source", F.slice("times", 1, F.least(whole, F.size("times"))).alias("t")).where(F.size("t") > 0)
    plan = plan.groupBy("doc_id", "h", "source").agg(F.flatten(F.sort_array(F.collect_list("t"))).alias("_graphloom_times"), F.count("*").alias("_graphloom_n"))
    plan = scratch.write(plan.withColumnsRenamed({"doc_id": "_graphloom_id", "h": "_graphloom_text", "source": "_graphloom_source"}), "plan")
    rows = docs.withColumn("_graphloom_h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_graphloom_id")) & (F.col("_graphloom_h") == F.col("_graphloom_text")) & F.col("source").eqNullSafe(F.col("_graphloom_source"))
    again = scratch.write(plan.where("_graphloom_n > 1").select("_graphloom_id", "_graphloom_text", "_graphloom_source"), "again")
    if not again.isEmpty():
        one = rows.join(bounded(again), same, "left_semi").dropDuplicates(["doc_id", "_graphloom_h", "source"])
        rows = rows.join(bounded(again), same, "left_anti").unionByName(one)
    taken = rows.join(plan, same).select(*docs.columns, F.explode("_graphloom_times").alias("_graphloom_at"))
    parts = default_partitions(spark)
    part = F.least(F.floor(F.col("_graphloom_at") * parts), F.lit(parts - 1)).cast("int")
    return taken.repartitionById(parts, part).sortWithinPartitions("_graphloom_at", "doc_id").drop("_graphloom_at")


def token_output(spark, docs, sf_dir):
    """Fixed-stride token sequences in training order, read back from the shards they are written to.

    ``docs`` are numbered in the order in which the stage before has written them, and sequences are permuted inside segments of it. Docs that
    are not read from files go by a hash of id and text. Null and empty texts are an end mark alone; an empty table gives no rows.
    """
    return tokens.through_shards(docs, Scratch(spark, "pipeline-tokens"), order=tokens.file_order(docs), segment=SEGMENT)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: The classifier and the tokenizer are beyond SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; between stages, docs are a table written in the shared checkpoint folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
