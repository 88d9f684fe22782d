"""Files below a storage root through Hadoop's file system: documents, sizes, removal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..model.errors import InvalidFileError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder or file; what is at the new path is replaced."""
    fs, p = _fs(spark, old)
    _, to = _fs(spark, new)
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise InvalidFileError(f"cannot move {old} to {new}")


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """One small text file; missing folders are made, a file at the path is replaced. ``.gz`` compresses."""
    fs, p = _fs(spark, path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p)
    out = fs.create(p, True)
    out = codec.createOutputStream(out) if codec else out
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, data: object, pretty: bool = False) -> None:
    write_file(spark, path, json.dumps(data, ensure_ascii=False, indent=2 if pretty else None))


def read_json(spark: SparkSession, path: str) -> object:
    """One JSON document, small enough for the driver; collections are read by :func:`~.store.read_collection`."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    try:
        (row,) = rows
        return json.loads(row["value"])
    except ValueError as e:
        raise InvalidFileError(f"{path}: {e}") from e


def write_frame(df: DataFrame, path: str, readable: bool = False) -> None:
    """A table as Parquet, or as JSON lines to look at."""
    w = df.write.mode("overwrite").option("compression", "gzip" if readable else "zstd")
    w.json(path) if readable else w.parquet(path)


def storage_bytes(spark: SparkSession, root: str) -> int:
    """Bytes of all files below a folder; 0 where it is missing."""
    fs, p = _fs(spark, root)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def remove_storage(spark: SparkSession, root: str) -> None:
    """Delete what an earlier run left; a missing folder is fine."""
    fs, p = _fs(spark, root)
    fs.delete(p, True)
