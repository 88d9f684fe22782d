"""Size-bounded batches, and shrinking of raw data that is too large."""

from __future__ import annotations

import heapq
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model.errors import UploadFailedError


def chunk_ids(rows: DataFrame, order: list[str], size: int, partition: list[str] = ()) -> DataFrame:
    """Number the rows of each group in order and cut them into chunks of ``size``."""
    w = W.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def pack_batches(rows: DataFrame, *, group: list[str], order: str, size: str, limit: int, raw: str | None = None, payload: str | None = None) -> DataFrame:
    """Greedy sequential packing inside each group: a new batch starts when the row would bring the batch to the limit.

    ``raw`` names the size of a row's raw data, a part of ``size``, and ``payload`` its entity as JSON. A row beyond the limit goes
    without its raw data: ``raw_removed`` is true, ``size`` is what is left, and the payload has no ``_rawData``. Rows beyond the limit even so are left out,
    see :func:`skipped_rows`; empty batches are not numbered. The fold resets as it goes, which no window frame
    does and which an array fold does in quadratic time, so each group is one pass of pandas: choose groups (a step and
    a chunk of it) of bounded size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, filled, out = 0, 0, []
        for s in pdf[size].tolist():
            if filled and filled + s >= limit:
                batch, filled = batch + 1, 0
            filled += s
            out.append(batch)
        if payload and raw:
            pdf[payload] = [_without_raw(p) if cut else p for p, cut in zip(pdf[payload], pdf["raw_removed"], strict=True)]
        return pdf.assign(batch=out)

    whole, small, cut = _sizes(size, raw, limit)
    extra = [F.col(payload)] if payload else []
    if raw:
        extra.append(cut.alias("raw_removed"))
    kept = rows.where(small <= limit).select(*group, order, F.when(cut, small).otherwise(whole).alias(size), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.groupBy(*group).applyInPandas(run, f"{fields}, batch long")


def skipped_rows(rows: DataFrame, *, size: str, limit: int, raw: str | None = None) -> DataFrame:
    """The rows that :func:`pack_batches` leaves out: beyond the limit without raw data too, or of unknown size."""
    _, small, _ = _sizes(size, raw, limit)
    return rows.where(small.isNull() | (small > limit))


def _sizes(size: str, raw: str | None, limit: int) -> tuple[Column, Column, Column]:
    """(size, size without raw data, whether raw data has to go)."""
    whole = F.col(size).cast("long")
    small = whole - F.coalesce(F.col(raw).cast("long"), F.lit(0)) if raw else whole
    return whole, small, whole > limit


def _without_raw(payload: str | None) -> str | None:
    if payload is None:
        return None
    return json.dumps({k: v for k, v in json.loads(payload).items() if k != "_rawData"}, ensure_ascii=False, separators=(",", ":"))


def _bytes(x) -> int:
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())


def shrink(entities: list[dict], limit: int) -> list[dict]:
    """Cut raw fields of a batch to ``TRUNCATED`` until its JSON fits; raises when nothing is left to cut.

    Each time it is the largest field of the largest payload of the entity with the most raw data; the first of equals.
    """
    batch = json.loads(json.dumps(entities))
    if error := _shrink(batch, limit):
        raise UploadFailedError(error)
    return batch


def _shrink(batch: list[dict], limit: int) -> str | None:
    """:func:`shrink` in place; says why the batch does not fit after all cuts, if so."""
    total, cut = _bytes(batch), _bytes("TRUNCATED")
    if total <= limit:
        return None
    most = [(-_bytes(e["_rawData"]), i) for i, e in enumerate(batch) if e.get("_rawData")]
    heapq.heapify(most)
    while total > limit:
        if not most:
            return "payload is too large and cannot shrink"
        raw, i = most[0]
        entry = largest_raw_entry(batch[i]["_rawData"])["rawData"] or {}
        key, size = largest_item(entry)
        if key is None or size <= cut:
            return "payload is still too large after performing as much shrinking as possible"
        entry[key] = "TRUNCATED"
        total -= size - cut
        heapq.heapreplace(most, (raw + size - cut, i))
    return None


def largest_raw_entry(raw: list[dict]) -> dict:
    """The payload of the largest JSON among an entity's raw data, the first of equals."""
    return max(raw, key=lambda r: _bytes(r.get("rawData")))


def largest_item(payload: dict) -> tuple[str | None, int]:
    """Name and JSON bytes of the largest field, the first of equals."""
    return max(((k, _bytes(v)) for k, v in payload.items()), key=lambda x: x[1], default=(None, 0))


def shrink_batches(rows: DataFrame, batch: str, payload: str, limit: int, order: str | None = None) -> DataFrame:
    """(batch, rows, bytes, truncated, error) after :func:`shrink` of each batch; payloads are JSON entities, by ``order`` and then by their text.

    A batch that cannot shrink to the limit fails alone: ``error`` says why, and the other columns are those after all its cuts; null is the error of
    the others. Batches are bounded by packing.
    """
    by = [(c, "ascending") for c in (order, payload) if c]

    def run(group: pa.Table) -> pa.Table:
        out = [json.loads(p) for p in group.sort_by(by).column(payload).to_pylist()]
        error = _shrink(out, limit)
        text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
        values = [group.column(batch)[0].as_py(), len(out), len(text.encode()), text.count('"TRUNCATED"'), error]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 4 + [pa.string()], strict=True)], [batch, "rows", "bytes", "truncated", "error"])

    return rows.select(batch, *[c for c, _ in by]).groupBy(batch).applyInArrow(run, f"{batch} long, rows long, bytes long, truncated long, error string")
