"""Operator 4: token-ID output in training order.

Texts become token ids of a public byte-level BPE vocabulary, and each text's ids (with an end mark) sequences of a fixed
length, the last one padded. Documents are put in an order of their own (by default that of a hash of id and text; a caller may name another),
and their sequences are numbered densely in it, so numbers depend on the rows alone, not on how the input is split into tasks. A keyed
Feistel permutation with cycle-walking gives each number a global slot: a bijection of [0, N), or of each segment of it where a
caller's order is to survive at large (a curriculum). Training order needs no sort keys and no shuffle buffer. Slots fall into shards, ranges of equal size; range
partitions of slots are sorted, and each shard is written as a flat file of fixed stride, so slot s is found at byte
(s - first slot of its shard) * stride, and a reader resumes from any slot. Results are what is read back from those files.

Tokenising happens once. Each step ends in a written table, and tables and shuffle files of steps that are over are deleted.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_partitions
from .packing import slices

#: Where the vocabulary lies by default; any file of lines "base64-token rank" will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE = 512
SHARD_ROWS = 4096
KEY = 20_240_607
ROUNDS = 6


class Tokenizer:
    """Token ids as bytes: 2 bytes an id up to 65,536 ids, else 4."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.end = max(ranks.values()) + 1
        self.kind = np.uint16 if self.end < 1 << 16 else np.uint32
        self._code = "H" if self.kind is np.uint16 else "I"
        self._encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.encode("utf-8", "replace").decode("utf-8")
        return array(self._code, self._encode(text)).tobytes()


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: bytes) -> Tokenizer:
    return Tokenizer(vocabulary)


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of sequence numbers: a keyed bijection of [0, n).

    A balanced Feistel network permutes the smallest domain of 4**k numbers that holds n; a number sent outside [0, n) is sent on until
    it falls inside (cycle-walking), fewer than four steps on average.
    """
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permute_segments(index: np.ndarray, n: int, key: int = KEY, segment: int | None = None) -> np.ndarray:
    """:func:`permute` of [0, n), or of each run of ``segment`` numbers in it by itself, under a key of its own."""
    if segment is None or segment >= n:
        return permute(index, n, key)
    index = np.asarray(index, dtype=np.int64)
    out = np.empty(len(index), dtype=np.int64)
    which = index // segment
    for s in np.unique(which):
        mine = which == s
        lo = int(s) * segment
        out[mine] = lo + permute(index[mine] - lo, min(segment, n - lo), key + int(s))
    return out


def hash_order(id_col: str, text_col: str) -> tuple[Column, list[Column]]:
    """(place in [0, 1), sort keys) of the order by a hash of id and text; rows equal in both have equal tokens."""
    k = F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1)
    return k / F.lit(float(1 << 63)), [k, F.col(id_col).cast("long")]


def file_order(documents: DataFrame) -> tuple[Column, list[Column]] | None:
    """The order in which Spark has written the files that ``documents`` is read from; None if it isn't read from such files.

    The number in a part file's name orders the files of one writing, and a row's number its rows.
    """
    try:
        rows = documents.select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
        last = rows.agg(F.max(_part_number(F.col("f")))).first()[0]
    except AnalysisException:
        return None
    if last is None:
        return None
    number = _part_number(F.col("_metadata.file_name"))
    return F.coalesce(number, F.lit(0)) / F.lit(float(last + 1)), [F.coalesce(number, F.lit(0)), F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def _part_number(name: Column) -> Column:
    return F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")


def tokenize(documents: DataFrame, scratch: Scratch, *, vocabulary=VOCABULARY, sequence=SEQUENCE, id_col="doc_id", text_col="text", order=None) -> DataFrame:
    """A written table (part, first, id, sequences, tokens): ids with an end mark, and where the text's sequences start in their part.

    Parts are ranges of the order, numbered from 0. Null texts and empty ones are the end mark alone, one sequence. Repeated rows are texts of their own.
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    place, keys = order or hash_order(id_col, text_col)
    parts = default_partitions(documents.sparkSession)
    part = F.least(F.floor(place * parts), F.lit(parts - 1)).cast("int")
    names = [f"o{i}" for i in range(len(keys))]
    d = documents.select(part.alias("part"), *[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        tok = _tokenizer(shared.value)
        end = np.array([tok.end], dtype=tok.kind).tobytes()
        stride = sequence * len(end)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                piece = pdf.iloc[lo : lo + 1000]
                blobs = [tok(t) + end for t in piece["text"]]
                n = np.array([-(-len(b) // stride) for b in blobs], dtype=np.int64)
                yield piece.drop(columns="text").assign(id=piece["id"].astype("Int64"), sequences=n, tokens=blobs)

    def number(batches):
        now, at = None, 0
        for batch in batches:
            n = batch.column("sequences").to_numpy()
            first = np.empty(len(n), dtype=np.int64)
            for p, lo, hi in slices(batch.column("part").to_numpy()):
                if p != now:
                    now, at = p, 0
                first[lo:hi] = at + np.cumsum(n[lo:hi]) - n[lo:hi]
                at += int(n[lo:hi].sum())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(first), *(batch.column(c) for c in ("id", "sequences", "tokens"))], ["part", "first", "id", "sequences", "tokens"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.drop("text").schema)
    t = d.mapInPandas(run, f"{fields}, sequences long, tokens binary")
    t = t.repartitionById(parts, "part").sortWithinPartitions("part", *names, "tokens").select("part", "id", "sequences", "tokens")
    return scratch.write(t.mapInArrow(number, "part int, first long, id long, sequences long, tokens binary"), "tokens")


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary column start in its data, and the end of the last."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), data]).cast(pa.binary())


def sequences(documents: DataFrame, scratch: Scratch, *, vocabulary=VOCABULARY, sequence=SEQUENCE, shard_rows=SHARD_ROWS, key=KEY, id_col="doc_id", text_col="text", order=None, segment=None) -> DataFrame:
    """One row per sequence (shard, slot, id, seq, n_tokens, tokens), in ranges of whole shards and sorted by slot.

    ``tokens`` are ids, little-endian, not padded yet. Slots are 0 to N - 1, each once. They depend on the rows and the key
    alone. An empty table gives no rows.
    """
    t = tokenize(documents, scratch, vocabulary=vocabulary, sequence=sequence, id_col=id_col, text_col=text_col, order=order)
    sizes = {r["part"]: r["n"] for r in t.groupBy("part").agg(F.sum("sequences").alias("n")).collect()}  # a row for each partition of the order
    base = np.zeros(max(sizes, default=-1) + 2, dtype=np.int64)
    for p, n in sizes.items():
        base[p + 1] = n
    base = np.cumsum(base)
    total = int(base[-1])
    width = np.dtype(_kind_and_end(vocabulary)[0]).itemsize
    stride = sequence * width

    def run(batches):
        for batch in batches:
            n = batch.column("sequences").to_numpy()
            if not len(n):
                continue
            seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = permute_segments(np.repeat(base[batch.column("part").to_numpy()] + batch.column("first").to_numpy(), n) + seq, total, key, segment)
            at = _offsets(batch.column("tokens"))
            # the texts' ids lie one after the other: cutting them moves no data
            cut = np.append(np.repeat(at[:-1], n) + seq * stride, at[-1])
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), ids, pa.array(seq), pa.array((np.diff(cut) // width).astype(np.int32)), _binary(cut, batch.column("tokens").buffers()[2])], ["shard", "slot", id_col, "seq", "n_tokens", "tokens"])

    out = t.mapInArrow(run, f"shard long, slot long, {id_col} long, seq long, n_tokens int, tokens binary")
    out = _in_ranges(out, -(-total // shard_rows)).sortWithinPartitions("shard", "slot")
    out._graphloom_path = t._graphloom_path
    return out


@functools.lru_cache(maxsize=8)
def _kind_and_end(vocabulary: str) -> tuple[type, int]:
    """Type of the ids of a vocabulary file, and its end mark: the first free id."""
    with open(vocabulary, "rb") as f:
        end = max(int(line.split()[1]) for line in f if line.strip()) + 1
    return (np.uint16 if end < 1 << 16 else np.uint32), end


def _padded(data, used: np.ndarray, sequence: int, kind, end: int) -> bytes:
    """Sequences of the given numbers of ids at a fixed stride, filled with the end mark."""
    out = np.full((len(used), sequence), end, dtype=kind)
    out[np.arange(sequence)[None, :] < used[:, None]] = np.frombuffer(data, dtype=kind)
    return out.tobytes()


def materialize(documents: DataFrame, scratch: Scratch, *, vocabulary=VOCABULARY, sequence=SEQUENCE, **options) -> DataFrame:
    """:func:`sequences` with ``tokens`` at the fixed stride of ``sequence`` ids, padded with the end mark."""
    kind, end = _kind_and_end(vocabulary)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column, used = batch.column("tokens"), batch.column("n_tokens").to_numpy()
            at = _offsets(column)
            data = _padded(column.buffers()[2][at[0] : at[-1]], used, sequence, kind, end)
            stride = sequence * np.dtype(kind).itemsize
            yield batch.set_column(batch.schema.get_field_index("tokens"), "tokens", _binary(np.arange(len(used) + 1) * stride, pa.py_buffer(data)))

    rows = sequences(documents, scratch, vocabulary=vocabulary, sequence=sequence, **options)
    return rows.mapInArrow(run, rows.schema)


def _in_ranges(rows: DataFrame, shards: int) -> DataFrame:
    """Deal ranges of whole shards to tasks, in order. Slots are dense, so the bounds are known without sampling."""
    parts = default_partitions(rows.sparkSession)
    return rows.repartitionById(parts, F.floor(F.col("shard") * parts / max(shards, 1)).cast("int"))


#: A record of the file beside a shard: whether the id is known, the id, the sequence's number in its text, its tokens.
_ORIGIN = np.dtype([("known", "<i1"), ("id", "<i8"), ("seq", "<i8"), ("n_tokens", "<i4")])


def pack_shards(rows: DataFrame, *, id_col="doc_id") -> DataFrame:
    """One row per shard of :func:`sequences`: (shard, first_slot, rows, data, origin), ids one after the other and where they come from.

    It must follow :func:`sequences` directly, whose partitions hold whole shards in order. No rows give no shards.
    """
    names = ["shard", "first_slot", "rows", "data", "origin"]

    def run(batches):
        now, first, data, origin = None, 0, [], []

        def row():
            whole = np.concatenate(origin)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([len(whole)]), pa.array([b"".join(data)], pa.binary()), pa.array([whole.tobytes()], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, slot = batch.column("id"), batch.column("slot").to_numpy()
            at, raw = _offsets(batch.column("tokens")), memoryview(batch.column("tokens").buffers()[2])
            about = np.empty(batch.num_rows, dtype=_ORIGIN)
            about["known"], about["id"] = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            about["seq"], about["n_tokens"] = batch.column("seq").to_numpy(), batch.column("n_tokens").to_numpy()
            for shard, lo, hi in slices(batch.column("shard").to_numpy()):
                if shard != now:
                    if now is not None:
                        yield row()
                    now, first, data, origin = shard, int(slot[lo]), [], []
                data.append(bytes(raw[at[lo] : at[hi]]))
                origin.append(about[lo:hi])
        if now is not None:
            yield row()

    some = rows.select("shard", "slot", F.col(id_col).cast("long").alias("id"), "seq", "n_tokens", "tokens")
    return some.mapInArrow(run, "shard long, first_slot long, rows long, data binary, origin binary")


def write_shards(packed: DataFrame, path: str, *, vocabulary=VOCABULARY, sequence=SEQUENCE) -> DataFrame:
    """Write the shards of :func:`pack_shards` as flat binary files into a folder that all executors share; return (shard, first_slot, rows, stride, sha256).

    A file holds its slots in order at the fixed stride of ``sequence`` ids, padded with the end mark; a smaller one beside it says in the same order
    where each came from. A file is written under another name and renamed, so a task that is run again replaces it whole. ``path`` is a URI that
    pyarrow can open (file, hdfs, s3). No shards, no files.
    """
    stamp = hashlib.blake2b(path.encode(), digest_size=4).hexdigest()
    kind, end = _kind_and_end(vocabulary)
    stride = sequence * np.dtype(kind).itemsize

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                data = _padded(r["data"], np.frombuffer(r["origin"], dtype=_ORIGIN)["n_tokens"], sequence, kind, end)
                for suffix, what in (("idx", r["origin"]), ("bin", data)):
                    tmp = f"{root}/.{stamp}-{r['shard']}-{TaskContext.get().taskAttemptId()}.{suffix}"
                    with store.open_output_stream(tmp) as f:
                        f.write(what)
                    store.move(tmp, f"{root}/shard-{r['shard']:08d}.{suffix}")
                yield pa.RecordBatch.from_pylist([{"shard": r["shard"], "first_slot": r["first_slot"], "rows": r["rows"], "stride": stride, "sha256": hashlib.sha256(data).hexdigest()}])

    return packed.mapInArrow(run, "shard long, first_slot long, rows long, stride long, sha256 string")


def read_slots(path: str, manifest: DataFrame, start: int, count: int):
    """Token bytes of ``count`` slots from ``start``, read in order by seeking: how a trainer resumes."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    shards = manifest.where((F.col("first_slot") + F.col("rows") > start) & (F.col("first_slot") < start + count)).orderBy("shard").toLocalIterator()
    for s in shards:
        lo, hi = max(start, s["first_slot"]), min(start + count, s["first_slot"] + s["rows"])
        with store.open_input_file(f"{root}/shard-{s['shard']:08d}.bin") as f:
            f.seek((lo - s["first_slot"]) * s["stride"])
            for _ in range(hi - lo):
                yield f.read(s["stride"])


def read_shards(path: str, manifest: DataFrame, *, id_col="doc_id") -> DataFrame:
    """The rows of :func:`materialize` from the files of :func:`write_shards`, in slot order across tasks. A shard that is short or changed is an error."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{root}/shard-{r['shard']:08d}.bin") as f:
                    data = f.read()
                with store.open_input_file(f"{root}/shard-{r['shard']:08d}.idx") as f:
                    origin = np.frombuffer(f.read(), dtype=_ORIGIN)
                if len(origin) != r["rows"] or hashlib.sha256(data).hexdigest() != r["sha256"]:
                    raise OSError(f"shard {r['shard']} is not what was written")
                n, stride = r["rows"], r["stride"]
                ids = pa.array(origin["id"], mask=origin["known"] == 0)
                columns = [pa.array(np.full(n, r["shard"])), pa.array(r["first_slot"] + np.arange(n)), ids, pa.array(origin["seq"]), pa.array(origin["n_tokens"]), _binary(np.arange(n + 1) * stride, pa.py_buffer(data))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", id_col, "seq", "n_tokens", "tokens"])

    shards = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return _in_ranges(manifest, shards).sortWithinPartitions("shard").mapInArrow(run, f"shard long, slot long, {id_col} long, seq long, n_tokens int, tokens binary")


def through_shards(documents: DataFrame, scratch: Scratch, *, vocabulary=VOCABULARY, sequence=SEQUENCE, id_col="doc_id", **options) -> DataFrame:
    """The rows of :func:`materialize`, written as shards into the shared folder and read back from them. An empty table gives no rows."""
    path = scratch.path("shards")
    rows = sequences(documents, scratch, vocabulary=vocabulary, sequence=sequence, id_col=id_col, **options)
    packed = scratch.write(pack_shards(rows, id_col=id_col), "packed")
    scratch.drop(rows)
    manifest = scratch.write(write_shards(packed, path, vocabulary=vocabulary, sequence=sequence), "manifest")
    scratch.drop(packed)
    return read_shards(path, manifest, id_col=id_col)


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride token sequences in training order, read back from their shards."""
    return through_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op4")).drop("shard")
