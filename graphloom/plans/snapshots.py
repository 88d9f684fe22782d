"""Synchronisation as snapshots: a job stages what is uploaded, and at its end the staged objects become the current snapshot.

What a snapshot lacks is deleted, but for types that are partial datasets, of which nothing is deleted. A job that is aborted changes nothing. Tables are
Parquet below one path; the manifest of a job and the pointer to the current snapshot are small files, written last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.errors import UploadAfterJobEndedError
from ..sources.files import exists, read_json, remove_storage, write_json
from .config import check_sync, job_fields

AWAITING, FINISHED, ABORTED = "AWAITING_UPLOADS", "FINISHED", "ABORTED"


class Snapshots:
    """Jobs and snapshots of one kind of objects below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def initiate(self, source: str, scope: str | None = None, instance: str | None = None) -> str:
        """Open a job and return its id; the options must fit the source."""
        check_sync(source, scope, instance)
        job = uuid.uuid4().hex
        self._state(job, AWAITING, **job_fields(source, scope, instance, job))
        return job

    def _state(self, job: str, status: str, **more) -> dict:
        old = self.status(job) if exists(self.spark, f"{self.path}/jobs/{job}.json") else {}
        new = {**old, **more, "id": job, "status": status}
        write_json(self.spark, f"{self.path}/jobs/{job}.json", new)
        return new

    def status(self, job: str) -> dict:
        return read_json(self.spark, f"{self.path}/jobs/{job}.json")

    def _open(self, job: str) -> str:
        if self.status(job)["status"] != AWAITING:
            raise UploadAfterJobEndedError(f"job {job} takes no more uploads")
        return f"{self.path}/staged/{job}"

    def upload(self, job: str, objects: DataFrame) -> None:
        """Add objects to a job; of a key uploaded twice the snapshot keeps one."""
        objects.write.mode("append").parquet(self._open(job))

    def current(self) -> DataFrame | None:
        """The current snapshot, None before the first."""
        pointer = f"{self.path}/current.json"
        return self.spark.read.parquet(read_json(self.spark, pointer)["path"]) if exists(self.spark, pointer) else None

    def actions(self, job: str, properties: list[str], partial: list[str] = ()) -> DataFrame:
        """(_key, _type, action) of what publishing does: created, updated, unchanged, deleted, or kept_partial."""
        new = self.spark.read.parquet(self._open(job)).dropDuplicates(["_key"])
        old = self.current()
        n = new.select("_key", F.col("_type").alias("_nt"), F.struct(*properties).alias("n"))
        o = (old if old is not None else new.limit(0)).select("_key", F.col("_type").alias("_ot"), F.struct(*properties).alias("o"))
        gone = F.when(F.col("_ot").isin(list(partial)), "kept_partial").otherwise("deleted") if partial else F.lit("deleted")
        action = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), gone).when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated")
        return o.join(n, "_key", "full_outer").select("_key", F.coalesce("_nt", "_ot").alias("_type"), action.alias("action"))

    def finalize(self, job: str, partial: list[str] = ()) -> DataFrame:
        """Publish: staged objects, and of partial types what was there before under other keys. Returns the new snapshot."""
        new = self.spark.read.parquet(self._open(job)).dropDuplicates(["_key"])
        old = self.current()
        if old is not None and partial:
            kept = old.where(F.col("_type").isin(list(partial))).join(new.select("_key"), "_key", "left_anti")
            new = new.unionByName(kept, allowMissingColumns=True)
        path = f"{self.path}/snapshots/{job}"
        new.write.mode("overwrite").parquet(path)
        write_json(self.spark, f"{self.path}/current.json", {"path": path})
        self._state(job, FINISHED)
        remove_storage(self.spark, f"{self.path}/staged/{job}")
        return self.spark.read.parquet(path)

    def abort(self, job: str, reason: str | None = None) -> dict:
        """Drop what a job has staged; the current snapshot stays."""
        remove_storage(self.spark, self._open(job))
        return self._state(job, ABORTED, reason=reason)
