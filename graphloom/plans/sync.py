"""A synchronisation job: upload of bounded batches with retries, status, abort, waiting, timing.

Batches are uploaded by the executors that hold them. A batch is named by job and number, so that a receiver can drop the second
copy that a retried task sends.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..model.errors import GraphError, SyncResponseError, SyncUnexpectedError, UploadAfterJobEndedError, UploadFailedError
from ..operators.batching import shrink
from ..sources.client import Call
from ..sources.paginated import Response

UPLOAD_ATTEMPTS, UPLOAD_DELAY, UPLOAD_FACTOR, UPLOAD_BYTES = 5, 0.2, 1.05, 6_000_000
TOO_LARGE, ENDED = 413, "JOB_NOT_AWAITING_UPLOADS"
FINISHED, ABORTED = "FINISHED", "ABORTED"

Transport = Callable[[Call], Response]


def error_body(r: Response) -> dict | None:
    """The ``error`` object of a response, if it has one."""
    e = r.body.get("error") if isinstance(r.body, dict) else None
    return e if isinstance(e, dict) else None


def sync_error(r: Response | None, message: str) -> GraphError:
    """One of two errors: the service stated a reason, or it did not."""
    if r is not None and (e := error_body(r)):
        return SyncResponseError(f'{message} (API response: code={e.get("code") or r.status}, message="{e.get("message") or "<none>"}").')
    return SyncUnexpectedError(message)


def upload_call(url: str, kind: str, batch: list[dict], tag: str) -> Call:
    """The call that uploads a batch; uploads of objects, and no other calls, are compressed."""
    body = json.dumps({kind: batch}, ensure_ascii=False, separators=(",", ":")).encode()
    return Call("POST", f"{url}/{kind}", {"content-type": "application/json", "content-encoding": "gzip", "x-batch": tag}, gzip.compress(body, mtime=0))


def upload_chunk(transport: Transport, url: str, kind: str, batch: list[dict], tag: str, *, limit: int = UPLOAD_BYTES, sleep=time.sleep) -> int:
    """Upload one batch and return the attempts it took.

    A batch that is too large has its raw data shrunk before the next attempt; a job that takes no more uploads is a fatal error.
    """
    for i in range(1, UPLOAD_ATTEMPTS + 1):
        r = transport(upload_call(url, kind, batch, tag))
        if r.status < 400:
            return i
        if r.status == TOO_LARGE:
            batch = shrink(batch, limit)
        elif (error_body(r) or {}).get("code") == ENDED:
            raise UploadAfterJobEndedError("the job has already ended")
        if i < UPLOAD_ATTEMPTS:
            sleep(UPLOAD_DELAY * UPLOAD_FACTOR ** (i - 1))
    raise UploadFailedError(f"{kind} batch {tag}: status {r.status} after {UPLOAD_ATTEMPTS} attempts")


def upload(rows: DataFrame, connect: Callable[[], Transport], url: str, kind: str, *, batch: str = "batch", payload: str = "payload") -> DataFrame:
    """(batch, rows, attempts) of rows packed by :func:`~..operators.batching.pack_batches`; payloads are JSON objects.

    ``connect`` makes the transport on the executor. The result is lazy: writing it down is what uploads.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf[batch].iloc[0])
        tries = upload_chunk(connect(), url, kind, [json.loads(p) for p in pdf[payload]], str(number))
        return pd.DataFrame({"batch": [number], "rows": [len(pdf)], "attempts": [tries]})

    return rows.select(batch, payload).groupBy(batch).applyInPandas(run, "batch long, rows long, attempts int")


def _ask(transport: Transport, call: Call, message: str) -> dict:
    r = transport(call)
    if r.status >= 400:
        raise sync_error(r, message)
    return r.body["job"]


def status(transport: Transport, url: str) -> dict:
    return _ask(transport, Call("GET", url), "cannot read the job")


def abort(transport: Transport, url: str, reason: str | None = None, terminal: str = ABORTED) -> dict:
    body = json.dumps({"reason": reason, "terminalStatus": terminal}).encode()
    return _ask(transport, Call("POST", f"{url}/abort", {"content-type": "application/json"}, body), "cannot abort the job")


def wait(transport: Transport, url: str, *, every: float = 5.0, progress: Callable[[dict], None] = lambda job: None, sleep=time.sleep) -> dict:
    """Ask until the job is finished; an aborted job raises."""
    while (job := status(transport, url))["status"] != FINISHED:
        progress(job)
        if job["status"] == ABORTED:
            raise SyncUnexpectedError("the job was aborted")
        sleep(every)
    return job


@contextlib.contextmanager
def timed(publish: Callable[[dict], None], name: str, clock=time.monotonic, **dimensions) -> Iterator[None]:
    """Publish the duration of a block in milliseconds, also when it fails."""
    began = clock()
    try:
        yield
    finally:
        publish({"name": name, "unit": "Milliseconds", "value": round((clock() - began) * 1000), "dimensions": dimensions})
