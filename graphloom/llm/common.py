"""Shared helpers of the training-data operators: scratch tables, bounded broadcasts, word rules, components."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Setting by which Spark deletes a query's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a warehouse folder where the setting is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom_scratch"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a missing one is fine."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables in the shared checkpoint folder. They cut lineage and survive lost executors.

    Shuffle files of a writing are deleted at its end. Tables stay until :meth:`drop`, or until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/graphloom-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return it read back with the same schema."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(SHUFFLE_CLEANUP, None)
        conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_graphloom_path", None):
                remove_path(self.spark, path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                remove_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone at interpreter exit
            pass


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of numbers that :func:`bounded` lets go to every task; some tens of MB.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of numbers, to be broadcast if it is counted to have at most ``most`` rows; beyond, its join is a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def ascii_lower(c):
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_bucket(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def _union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member of each node's component, over edges a-b: (nodes, roots)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches):
    """Replace the edges of each batch by stars around the smallest node: same components, fewer edges."""
    for pdf in batches:
        if len(pdf):
            nodes, roots = _union_find(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            keep = nodes != roots
            yield pd.DataFrame({"a": nodes[keep], "b": roots[keep]})


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as long pairs (a, b).

    Returns (node, component) for every node of an edge, component being the smallest node reachable.
    Edges are first contracted batch by batch, which leaves a hub at most one edge per batch and neighbour; then large-star and small-star steps alternate until nothing
    changes. Each step is a written table. Minima are combined map-side, and joined with the edges by broadcast where they are counted to be
    few; beyond, both sides of the join are plain shuffles, which skew handling can split. Nothing is collected but counts and a checksum.
    Empty input gives an empty frame; self loops and repeated edges are harmless.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = scratch.write(pairs.mapInPandas(_contract, "a long, b long"), "edges")
    seen = None
    for _ in range(max_rounds if not e.isEmpty() else 0):
        # large star: every larger neighbour moves to the smallest neighbour
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = scratch.write(both.where("v > u").join(bounded(low), "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "large")
        # small star: smaller neighbours and the node itself move to the smallest one
        low2 = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(bounded(low2), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt = scratch.write(small, "stars")
        stats = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(e, low, large, low2)
        e = nxt
        if stats == seen:
            break
        seen = stats
    else:
        if seen:
            raise RuntimeError("connected components did not converge")
    low = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return low.unionAll(roots)


#: Most distinct labels that a sample is taken for; more are an error.
MAX_CLASSES = 4096


def stratified_sample(df: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label or fewer, chosen by a hash of the id: the rows of ``df`` and their number ``_u`` in [0, 1).

    Rows without a label are left out. Fractions come from counts over all rows, and every label gets its own. More than ``MAX_CLASSES``
    labels raise an error.
    """
    df = df.where(F.col(label).isNotNull())
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    kind = df.schema[label].dataType.simpleString()
    shares = df.sparkSession.createDataFrame([(r["_label"], min(1.0, per_class / r["_n"])) for r in counts], f"_label {kind}, _share double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), id_col), 11) / F.lit(float(1 << 53))
    return df.withColumn("_u", u).join(F.broadcast(shares), F.col(label) == F.col("_label")).where("_u < _share").drop("_label", "_share")


#: Characters of a training sample that go to the driver at most.
SAMPLE_CHARS = 64_000_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *, mod: int, held: int, per_class: int) -> tuple[pd.DataFrame, float | None]:
    """(doc_id, text, y) of a bounded sample of labelled documents outside the held-out fold, and the share of label 1 among all of these.

    At most about ``per_class`` labels of each value, twice as many documents in all (an id may name several; of rows equal in id and text one
    counts) and ``SAMPLE_CHARS`` characters, in the order of a hash. Several labels of an id: the largest counts. Null ids have no label;
    null texts are empty. Without labels the sample is empty and the share None.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (fold_bucket(F.col("doc_id"), mod) != held))
    lab = lab.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    prior = lab.agg(F.avg(F.col("_y").cast("double"))).first()[0]
    if prior is None:
        return pd.DataFrame({"doc_id": [], "text": [], "y": []}), None
    chosen = stratified_sample(lab, "_y", "_id", per_class).orderBy("_u", "_id").limit(int(2.4 * per_class) + 1)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("_h")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sizes = rows.select("_h", F.length("text").alias("_n")).distinct().orderBy("_h").limit(4 * per_class)
    keys = sizes.withColumn("_upto", F.sum("_n").over(W.orderBy("_h"))).where(F.col("_upto") <= SAMPLE_CHARS).select("_h")
    out = rows.join(F.broadcast(keys), "_h").select("doc_id", "text", F.col("_y").alias("y"), "_h").toPandas()
    return out.drop_duplicates("_h").sort_values(["doc_id", "_h"]).drop(columns="_h").reset_index(drop=True), float(prior)
