"""Streams: batch-wise upload and keyed deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upload_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[Exception, DataFrame], None] | None = None):
    """Feed micro-batches to a sink until the available input is used up. A failing batch is reported and the stream goes on."""

    def each(df: DataFrame, epoch: int) -> None:
        try:
            sink(df, epoch)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e, df)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def distinct_keys(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key, remembered for ``delay`` of event time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def read_table_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
