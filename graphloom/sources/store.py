"""Graph stores and files: Parquet partitioned by type and step, JSON collections, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.errors import InvalidFileError
from .files import exists, read_json, write_json


class ParquetStore:
    """Objects of one kind below a path, partitioned by ``_type`` and ``step_id``: both access paths are partition pruning.

    A run adds a set of files with every write, so later flushes of a step lose nothing of earlier ones, and :meth:`publish` makes the run the one that
    other stores of the path read. An unpublished run is seen by its own store alone.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500_000):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file
        self._run: str | None = None

    def write(self, objects: DataFrame, spread: bool = False) -> None:
        """Add objects. With ``spread`` rows are first dealt evenly to all tasks: for sources of a few large pieces, whose shuffle costs less than the idle cores."""
        self._run = self._run or uuid.uuid4().hex
        rows = objects.hint("rebalance") if spread else objects
        rows.write.mode("append").option("maxRecordsPerFile", self.rows_per_file).option("compression", "zstd").partitionBy("_type", "step_id").parquet(self._folder(self._run))

    def publish(self) -> None:
        """Make what this store has written the current run of the path."""
        if self._run is None:
            raise InvalidFileError(f"nothing was written to {self.path}")
        write_json(self.spark, f"{self.path}/current.json", {"run": self._run})

    def _folder(self, run: str) -> str:
        return f"{self.path}/runs/{run}"

    def read(self) -> DataFrame:
        run = self._run
        if run is None:
            if not exists(self.spark, f"{self.path}/current.json"):
                raise InvalidFileError(f"nothing was published at {self.path}")
            run = read_json(self.spark, f"{self.path}/current.json")["run"]
        return self.spark.read.parquet(self._folder(run))

    def by_type(self, type: str) -> DataFrame:
        return self.read().where(F.col("_type") == type)

    def by_step(self, step: str) -> DataFrame:
        return self.read().where(F.col("step_id") == step)


class MemoryStore:
    """The same interface over frames held by the session. An empty store reads as an empty frame."""

    def __init__(self):
        self._parts: list[DataFrame] = []

    def write(self, objects: DataFrame) -> None:
        self._parts.append(objects)

    def read(self) -> DataFrame:
        if not self._parts:
            return SparkSession.active().createDataFrame([], "_key string, _type string, step_id string")
        out = self._parts[0]
        for p in self._parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def by_type(self, type: str) -> DataFrame:
        return self.read().where(F.col("_type") == type)


#: Objects of a line of a collection file, on average.
CHUNK_ROWS = 5_000


def write_collection(objects: DataFrame, path: str, name: str = "entities") -> None:
    """JSON files ``{name: [...]}``: one line of a chunk of objects each; a type has as many chunks as its rows ask for."""
    chunks = objects.groupBy("_type").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("_chunks"))
    rows = objects.join(chunks.withColumnRenamed("_type", "_t"), F.col("_type").eqNullSafe(F.col("_t"))).withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.col("_chunks")))
    rows.groupBy("_type", "_chunk").agg(F.collect_list(F.struct(*objects.columns)).alias(name)).select(name).write.mode("overwrite").json(path)


def read_collection(spark: SparkSession, path: str, schema: str, name: str = "entities") -> DataFrame:
    """Objects of the JSON files that carry the collection; other files are skipped, malformed ones raise."""
    try:
        df = spark.read.schema(f"{name} array<struct<{schema}>>").option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    except Exception as e:
        raise InvalidFileError(str(e)) from e
    return df.where(F.col(name).isNotNull()).select(F.inline(name))


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns of dotted names, arrays as JSON text: a form that CSV can hold."""
    cols = []

    def walk(schema, path, label):
        for f in schema:
            p, n = [*path, f.name], f"{label}.{f.name}" if label else f.name
            c = F.col(".".join(f"`{x}`" for x in p))
            if f.dataType.typeName() == "struct":
                walk(f.dataType, p, n)
            elif f.dataType.typeName() in ("array", "map"):
                cols.append(F.to_json(c).alias(n))
            else:
                cols.append(c.alias(n))

    walk(df.schema, [], "")
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("_type").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
