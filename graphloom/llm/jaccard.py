"""Operator 1: n-gram Jaccard join with parity sketches.

A document is its set of word shingles. The shingle hashes are dealt over n cells and XOR-ed inside each: a parity
sketch. A shingle in one set alone changes one cell, so the number of cells that differ (the Hamming distance of the
sketches by cells) is at most the symmetric difference, which two linked sets bound by (1 - t) / (1 + t) times
the sum of their sizes. Sizes fall into bands with one n each. By the pigeonhole principle linked sketches agree in more
than n - d - 1 of n cells, so among the d + 1 first cells of each in any common order there is one in common. The order is
by rarity of a cell's shingles, counted over the corpus, so that shared passages come last.

Equal sets are one class from the start. Where few classes share a cell, all their pairs are candidates, kept if their sketches of
one bit per cell, of sizes that follow the sets', are near enough; the connected components of these near pairs are groups. A cell that many classes share is crowded:
it goes to the group of its most central class, so that the many cells that one crowd of near copies shares make one group. A group is dealt into
blocks of bounded size and each pair of blocks is a task, which verifies all its pairs on the exact sets by matrix products and returns
links per class and a spanning forest, never pairs. Near pairs whose component is too sparse for that (a long chain) are verified one by
one. So every link is verified and counted, a class's set is sent about once per group, and rows grow with the classes, not with their pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _union_find, bounded, connected_components
from .packing import as_array, bucket_of, mix, shingles, space_words

SHINGLE = 5
#: A link: DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Classes sharing a cell that are paired outright.
FEW = 24
#: Classes, and shingles, of a block of a group; two blocks are a task.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_COLUMNS = 4096
#: Words of the corpus per bucket of the packed shuffle.
WORDS_PER_BUCKET = 2_000_000
WORDS_PER_PACK = 1_200_000
RARITY_BITS = 17
#: Fewest 64-bit words of the sketches that a candidate pair must be near by; larger sets get two to four bits a shingle.
SKETCH_WORDS = 32
_EMPTY = np.uint64(0x9FB21C651E98DF25)
_SCHEME = 0xD6E8FEB86659FD93
_LOW = np.uint64(0xFFFF)


def _bound(a, b):
    """Largest symmetric difference of two linked sets of these sizes."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def band(size: int) -> int:
    """Band k holds the sizes in (2**k, 2**(k + 1)]; its sketches have 2**k cells. Size 1 is in band 0."""
    return max(0, (size - 1).bit_length() - 1)


def cells(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Names of the cells of a set (sorted 64-bit hashes) that it must offer to meet every set it can be linked with.

    A set whose partners reach into the next band offers the cells of that band's sketch too.
    """
    n = len(s)
    largest = n * DEN // NUM
    k = band(n)
    freq = rarity[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
    out = []
    for scheme in range(k, band(largest) + 1):
        count = 1 << scheme
        top = min(largest, 2 * count)
        need = _bound(n, top) + 1
        part = (s & np.uint64(count - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p = part[order]
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        salt = np.uint64((scheme + 1) * _SCHEME & (1 << 64) - 1)
        name = mix(np.bitwise_xor.reduceat(s[order], start) ^ mix(p[start].astype(np.uint64) + salt))
        rare = np.minimum.reduceat(freq[order], start)
        if len(name) > need:
            name = name[np.lexsort((name, rare))[:need]]
        elif len(name) < need and len(name) < count:
            # cells without a shingle come last in the order
            used = np.zeros(count, dtype=bool)
            used[p] = True
            empty = np.sort(mix(np.flatnonzero(~used).astype(np.uint64) + salt + _EMPTY))
            name = np.concatenate([name, empty[: need - len(name)]])
        out.append(name)
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of one bit per cell: bit h mod m is flipped for each shingle; m is a power of two."""
    bits = max(64 * SKETCH_WORDS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches, at most the symmetric difference of their sets. The longer is folded to the shorter's size."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _class(s: np.ndarray) -> bytes:
    """Name of a set: a 64-bit hash and its size."""
    return hashlib.blake2b(s.tobytes(), digest_size=8).digest() + np.int32(len(s)).tobytes()


def _describe(shingle: int):
    """Per document (id, hash of the text, size, class), and the rarity counts of the whole task by hash bucket."""

    def run(batches):
        total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for pdf in batches:
            n, key = [], []
            for t in pdf["text"]:
                s = shingles(space_words(t, lower=True), shingle)
                n.append(len(s))
                key.append(_class(s) if len(s) else None)
                total += np.bincount((s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total)) if len(s) > 4096 else 0
                if 0 < len(s) <= 4096:
                    np.add.at(total, (s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
            yield pd.DataFrame({"kind": 0, "id": pdf["id"].astype("Int64"), "h": pdf["h"].astype("Int64"), "n": n, "cls": key})
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"kind": 1, "id": pd.array(seen, dtype="Int64"), "h": pd.array([pd.NA] * len(seen), dtype="Int64"), "n": total[seen], "cls": None})

    return run


def _offer(rarity: np.ndarray, buckets: int, shingle: int, few: int):
    """Packed cells of the distinct sets of a batch. kind 0: to be compared; kind 1: cells crowded already in the batch."""

    def pack(keys, names, owner):
        value = (names & ~_LOW) | owner.astype(np.uint64)
        b = bucket_of(names & ~_LOW, buckets)
        order = np.lexsort((value, b))
        value, b = value[order], b[order]
        cell = value & ~_LOW
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        count = np.diff(np.concatenate([start, [len(cell)]]))
        crowded = np.repeat(count > few, count)
        head = np.zeros(len(cell), dtype=bool)
        head[start] = True
        out = []
        send = ~crowded | head
        kb, ks, hot = b[send], value[send], (crowded & head)[send]
        cut = np.flatnonzero(np.concatenate([[True], kb[1:] != kb[:-1]]))
        for lo, hi in zip(cut, np.concatenate([cut[1:], [len(kb)]]), strict=True):
            v = ks[lo:hi]
            used, local = np.unique((v & _LOW).astype(np.int64), return_inverse=True)
            v = (v & ~_LOW) | local.astype(np.uint64)
            out.append((int(kb[lo]), 0, b"".join(keys[i] for i in used), v.tobytes(), np.flatnonzero(hot[lo:hi]).astype(np.int32).tobytes()))
        rest = crowded & ~head
        if rest.any():
            v = value[rest]
            used, local = np.unique((v & _LOW).astype(np.int64), return_inverse=True)
            v = (v & ~_LOW) | local.astype(np.uint64)
            out.append((buckets + int(v[0] % np.uint64(buckets)), 1, b"".join(keys[i] for i in used), v.tobytes(), b""))
        return pd.DataFrame(out, columns=["bucket", "kind", "keys", "cells", "hot"])

    def run(batches):
        for pdf in batches:
            keys, names, known, words = [], [], set(), 0
            for t in pdf["text"]:
                s = shingles(space_words(t, lower=True), shingle)
                if not len(s) or (key := _class(s)) in known:
                    continue
                known.add(key)
                keys.append(key)
                names.append(cells(s, rarity))
                words += len(s)
                if words > WORDS_PER_PACK or len(keys) == 1 << 16:
                    yield pack(keys, np.concatenate(names), np.repeat(np.arange(len(keys)), [len(x) for x in names]))
                    keys, names, known, words = [], [], set(), 0
            if keys:
                yield pack(keys, np.concatenate(names), np.repeat(np.arange(len(keys)), [len(x) for x in names]))

    return run


_NO_ROWS = {"kind": np.empty(0, np.int32), "a": [], "b": [], "cell": np.empty(0, np.int64), "n": np.empty(0, np.int32)}


def _meet(pdf: pd.DataFrame, few: int = FEW) -> pd.DataFrame:
    """Candidates of a bucket. kind 0: pairs of classes (a, b); kind 1: (cell, class a of size n) of crowded cells."""
    key, size, cell, own, hot = [], [], [], [], []
    at = 0
    passed = []
    for r in pdf.itertuples(index=False):
        k = np.frombuffer(r.keys, dtype="V12")
        n = as_array(r.keys, np.int32)[2::3]
        v = as_array(r.cells, np.uint64)
        local = (v & _LOW).astype(np.int64)
        if r.kind:
            passed.append(pd.DataFrame({"kind": np.int32(1), "a": [x.tobytes() for x in k[local]], "b": None, "cell": (v & ~_LOW).view(np.int64), "n": n[local]}))
            continue
        key.append(k), size.append(n), cell.append(v & ~_LOW), own.append(local + at)
        hot.append((v & ~_LOW)[as_array(r.hot, np.int32)])
        at += len(k)
    if not key:
        return pd.concat(passed) if passed else pd.DataFrame(_NO_ROWS)
    key, first, same = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
    size, cell, own, hot = np.concatenate(size)[first], np.concatenate(cell), same[np.concatenate(own)], np.unique(np.concatenate(hot))
    order = np.lexsort((own, cell))
    cell, own = cell[order], own[order]
    fresh = np.ones(len(cell), dtype=bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])
    cell, own = cell[fresh], own[fresh]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    count = np.diff(np.concatenate([start, [len(cell)]]))
    crowded = (count > few) | np.isin(cell[start], hot)
    x, y = [], []
    for c in np.unique(count[~crowded & (count > 1)]):
        rows = start[~crowded & (count == c)][:, None] + np.arange(c)
        i, j = np.triu_indices(c, 1)
        x.append(own[rows[:, i]].ravel()), y.append(own[rows[:, j]].ravel())
    out = passed
    if x:
        pair = np.unique(np.concatenate(x) * len(key) + np.concatenate(y))
        x, y = pair // len(key), pair % len(key)
        fit = DEN * np.minimum(size[x], size[y]).astype(np.int64) >= NUM * np.maximum(size[x], size[y]).astype(np.int64)
        out.append(pd.DataFrame({"kind": np.int32(0), "a": [k.tobytes() for k in key[x[fit]]], "b": [k.tobytes() for k in key[y[fit]]], "cell": np.int64(0), "n": np.int32(0)}))
    if crowded.any():
        mine = np.repeat(crowded, count)
        out.append(pd.DataFrame({"kind": np.int32(1), "a": [k.tobytes() for k in key[own[mine]]], "b": None, "cell": cell[mine].view(np.int64), "n": size[own[mine]]}))
    return pd.concat(out) if out else pd.DataFrame(_NO_ROWS)


def _check_pairs(batches):
    """Links among candidate rows (a, b, sa, sb: exact sets)."""
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf["sa"], pdf["sb"], strict=True)):
            x, y = as_array(x, np.uint64), as_array(y, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep[i] = DEN * both >= NUM * (len(x) + len(y) - both)
        yield pdf.loc[keep, ["a", "b"]]


def _check_sketches(batches):
    """The pairs (a, b, na, nb, sa, sb: sketches) that may be links."""
    for pdf in batches:
        apart = np.array([distance(as_array(x, np.uint64), as_array(y, np.uint64)) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)], dtype=np.int64)
        yield pdf.loc[apart * (DEN + NUM) <= (DEN - NUM) * (pdf["na"] + pdf["nb"]).to_numpy(), ["a", "b", "na", "nb"]]


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: products of the incidence of shared members, some columns at a time."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    values, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = code[: na.sum()], code[na.sum() :]
    shared = (np.bincount(ca, minlength=len(values)) > 0) & (np.bincount(cb, minlength=len(values)) > 0)
    column = np.cumsum(shared) - 1

    def cut(c, n):
        rows, keep = np.repeat(np.arange(len(n)), n), shared[c]
        rows, c = rows[keep], column[c[keep]]
        order = np.argsort(c, kind="stable")
        return rows[order], c[order]

    (ra, ca), (rb, cb) = cut(ca, na), cut(cb, nb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), _COLUMNS):
        x, y = np.zeros((len(a), _COLUMNS), dtype=np.float32), np.zeros((len(b), _COLUMNS), dtype=np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            at = slice(*np.searchsorted(c, [lo, lo + _COLUMNS]))
            m[r[at], c[at] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks of a group. kind 0: (class node, links to other classes, by their copies); kind 1: spanning edges (node, node).

    ``seen`` are the groups that come before: a pair of classes that have one in common is counted there.
    """
    i, j = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    pdf = pdf.drop_duplicates("node")
    left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
    none = np.empty(0, dtype=np.int64)
    if not len(left) or not len(right):
        return pd.DataFrame({"kind": none.astype(np.int32), "node": none, "other": none})
    a, b = ([as_array(m, np.uint64) for m in x["members"]] for x in (left, right))
    both = _intersections(a, b)
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    link = DEN * both >= NUM * (na + nb - both)
    seen = [[np.asarray(x, dtype=np.int64).view(np.uint64) for x in y["seen"]] for y in (left, right)]
    if any(map(len, seen[0])) and any(map(len, seen[1])):
        link &= _intersections(*seen) == 0
    if i == j:
        link = np.triu(link, 1)
    x, y = np.nonzero(link)
    ra, rb = left["node"].to_numpy(), right["node"].to_numpy()
    ids, inv = np.unique(np.concatenate([ra[x], rb[y]]), return_inverse=True)
    n = np.bincount(inv, weights=np.concatenate([right["copies"].to_numpy()[y], left["copies"].to_numpy()[x]]).astype(float), minlength=len(ids)).astype(np.int64)
    nodes, roots = _union_find(ra[x], rb[y]) if len(x) else (none, none)
    tree = nodes != roots
    return pd.concat([pd.DataFrame({"kind": np.int32(0), "node": ids, "other": n}), pd.DataFrame({"kind": np.int32(1), "node": nodes[tree], "other": roots[tree]})])


def _read_sets(shingle: int, exact: bool):
    """(class, size, members or sketch) of texts."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                sets = (shingles(space_words(t, lower=True), shingle) for t in pdf["text"][lo : lo + 500])
                yield pd.DataFrame([(_class(s), len(s), (s if exact else sketch(s)).tobytes()) for s in sets if len(s)], columns=["cls", "n", "data"])

    return run


def classes(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", shingle=SHINGLE) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(documents: id, h, n, cls), (classes: cls, rep, node, copies) and the rarity counts.

    Rows with null ids have no class; h is a hash of the text. A class's node is its smallest id, or a number of its own where classes share
    that id, as rows may repeat an id with other texts.
    """
    d = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    described = scratch.write(d.mapInPandas(_describe(shingle), "kind int, id long, h long, n long, cls binary"), "described")
    rarity = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    for r in described.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        rarity[r["id"]] = r["n"]
    docs = described.where("kind = 0").select("id", "h", "n", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls"))
    reps = scratch.write(docs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    shared = scratch.write(reps.groupBy("rep").count().where("count > 1").select("rep", F.lit(True).alias("shared")), "shared-ids")
    node = F.when(F.col("shared"), -F.shiftrightunsigned(F.xxhash64("cls"), 1) - 1).otherwise(F.col("rep"))
    return docs, reps.join(shared, "rep", "left").select("cls", "rep", node.alias("node"), "copies"), rarity


def jaccard_join(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", shingle=SHINGLE, few=FEW, block=BLOCK) -> DataFrame:
    """id, n_shingles, component (smallest id reachable by links, itself included), n_links (other rows linked directly) and text_hash of every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space. A text of fewer words than a shingle is one shingle; without
    words the set is empty and linked with nothing, as is a row with a null id, whose component is null. Rows that repeat an id
    are linked if their texts are. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    chars = documents.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(8, int(chars // (6 * WORDS_PER_BUCKET)) + 1)
    docs, reps, rarity = classes(documents, scratch, id_col=id_col, text_col=text_col, shingle=shingle)
    d = documents.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    packed = d.mapInPandas(_offer(rarity, buckets, shingle, few), "bucket long, kind int, keys binary, cells binary, hot binary")
    met = scratch.write(packed.groupBy("bucket").applyInPandas(lambda pdf: _meet(pdf, few), "kind int, a binary, b binary, cell long, n int"), "met")
    pairs = scratch.write(met.where("kind = 0").select("a", "b").distinct(), "pairs")
    crowded = scratch.write(met.where("kind = 1").select("cell", F.col("a").alias("cls"), "n").distinct(), "crowded")
    scratch.drop(met)

    # a crowded cell goes to the group of the class with the largest share of crowded cells
    central = scratch.write(crowded.groupBy("cls").agg((F.count("*") / F.first("n")).alias("share")), "central")
    heads = scratch.write(crowded.join(central, "cls").groupBy("cell").agg(F.max(F.struct("share", F.xxhash64("cls").alias("g"))).alias("h")).select("cell", "h.g"), "heads")
    groups = scratch.write(crowded.join(heads, "cell").select("g", "cls", "n").distinct(), "groups")
    member_of = scratch.write(groups.groupBy("cls").agg(F.collect_set("g").alias("gs")), "member-of")

    texts = documents.select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).alias("text"))
    reps = scratch.write(reps, "nodes")

    def read(wanted: DataFrame, name: str, exact: bool) -> DataFrame:
        """Sketches or sets of the wanted classes (cls), from their representatives' texts; a class may be read from several rows."""
        ids = scratch.write(wanted.distinct().join(reps, "cls").select(F.col("rep").alias("_rep")).distinct(), f"ids-{name}")
        return scratch.write(texts.join(bounded(ids), "_rep", "left_semi").select("text").mapInPandas(_read_sets(shingle, exact), "cls binary, n int, data binary"), name)

    # few: pairs near by sketch that no group holds
    short = read(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "sketches", False).dropDuplicates(["cls"])
    near = pairs.join(short.toDF("a", "na", "sa"), "a").join(short.toDF("b", "nb", "sb"), "b").mapInPandas(_check_sketches, "a binary, b binary, na int, nb int")
    near = near.join(member_of.toDF("a", "ga"), "a", "left").join(member_of.toDF("b", "gb"), "b", "left")
    near = near.where(~F.coalesce(F.arrays_overlap("ga", "gb"), F.lit(False)))
    of = lambda x: reps.select(F.col("cls").alias(x), F.col("node").alias(f"v{x}"), F.col("copies").alias(f"c{x}"))
    near = scratch.write(near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "va", "vb", "ca", "cb"), "near")
    parts = scratch.write(connected_components(near.select(F.col("va").alias("a"), F.col("vb").alias("b")), scratch), "near-components")

    # a component goes block by block where that sends no more sets than its pairs would
    near = near.join(parts.withColumnRenamed("node", "va"), "va")
    ends = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("na").alias("n")), F.struct(F.col("b").alias("cls"), F.col("nb").alias("n"))))
    members = near.select("component", ends.alias("e")).select("component", "e.cls", "e.n").distinct()
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    dense = members.groupBy("component").agg(blocks, F.count("*").alias("m")).join(near.groupBy("component").agg(F.count("*").alias("p")), "component").where("m * blocks <= 2 * p").select("component", "blocks")
    dense = scratch.write(dense, "dense")
    sparse = scratch.write(near.join(dense, "component", "left_anti"), "sparse")
    many = groups.join(scratch.write(groups.groupBy("g").agg(blocks), "weights"), "g").select("g", "cls", "blocks")
    dealt = many.join(member_of, "cls").withColumn("seen", F.filter("gs", lambda x: x < F.col("g"))).drop("gs")
    few_ = members.join(dense, "component").select(F.xxhash64(F.lit("near"), "component").alias("g"), "cls", "blocks").join(member_of.withColumnRenamed("gs", "seen"), "cls", "left")
    dealt = scratch.write(dealt.unionByName(few_.withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))), "dealt")

    sets = read(dealt.select("cls").unionAll(sparse.select(F.explode(F.array("a", "b")).alias("cls"))), "sets", True)
    alone = sets.join(bounded(scratch.write(sparse.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "sparse-classes")), "cls", "left_semi").drop("n")
    both = sparse.select("a", "b").join(alone.toDF("b", "sb"), "b").join(alone.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
    links = both.mapInPandas(_check_pairs, "a binary, b binary").distinct()
    links = scratch.write(links.join(of("a"), "a").join(of("b"), "b").select("va", "ca", "vb", "cb"), "links")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("bi"), F.greatest("block", k).alias("bj")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("p", F.explode(every)).drop("blocks")
    dealt = dealt.join(reps.select("cls", "node", "copies"), "cls").join(sets.select("cls", F.col("data").alias("members")), "cls").select("g", "p.bi", "p.bj", "block", "seen", "node", "copies", "members")
    found = scratch.write(dealt.groupBy("g", "bi", "bj").applyInPandas(_compare, "kind int, node long, other long"), "found")
    scratch.drop(sets)

    edges = links.select(F.col("va").alias("a"), F.col("vb").alias("b")).unionAll(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    comps = connected_components(edges, scratch)
    ends = links.select(F.explode(F.array(F.struct(F.col("va").alias("node"), F.col("cb").alias("n")), F.struct(F.col("vb").alias("node"), F.col("ca").alias("n")))).alias("e"))
    degree = ends.select("e.node", "e.n").unionAll(found.where("kind = 0").select("node", F.col("other").alias("n"))).groupBy("node").agg(F.sum("n").alias("others"))
    linked = scratch.write(comps.join(reps.select("node", "rep"), "node").join(degree, "node", "left"), "linked-classes")
    least = scratch.write(linked.groupBy("component").agg(F.min("rep").alias("least")), "least")
    linked = linked.join(least, "component").select("node", "least", "others")
    each = reps.join(linked, "node", "left").select("cls", F.coalesce("least", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    each = scratch.write(each, "by-class")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component", "n_links", F.col("h").alias("text_hash")]
    alone = docs.where("cls IS NULL").withColumn("component", F.col("id")).withColumn("n_links", F.lit(0).cast("long"))
    return docs.where("cls IS NOT NULL").join(each, "cls").select(columns).unionAll(alone.select(columns))


def keep_one(documents: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents without near copies: of each component one row stays, the one of the smallest id, with all its columns.

    Rows go by id and text: another row of a repeated id with an unlinked text stays, as do rows with a null id and texts without words. Of
    rows equal in id and text one stays. An empty table gives no rows.
    """
    rows = jaccard_join(documents, scratch, id_col=id_col, text_col=text_col).where(F.col("n_links") > 0).select(F.col(id_col).alias("_graphloom_id"), F.col("text_hash").alias("_graphloom_h"), "component")
    rows = scratch.write(rows, "linked")
    first = scratch.write(rows.groupBy("component").agg(F.min(F.struct("_graphloom_id", "_graphloom_h")).alias("_graphloom_first")), "first")
    rows = rows.join(first, "component")
    stays = F.struct("_graphloom_id", "_graphloom_h") == F.col("_graphloom_first")
    gone = scratch.write(rows.where(~stays).select("_graphloom_id", "_graphloom_h").distinct(), "gone")
    again = scratch.write(rows.where(stays).groupBy("_graphloom_id", "_graphloom_h").count().where("count > 1").select("_graphloom_id", "_graphloom_h"), "again")
    on = (F.col(id_col) == F.col("_graphloom_id")) & (F.xxhash64(text_col) == F.col("_graphloom_h"))
    out = documents.join(bounded(gone), on, "left_anti")
    if again.isEmpty():
        return out
    twice = out.join(bounded(again), on, "left_semi").withColumn("_graphloom_h", F.xxhash64(text_col)).dropDuplicates([id_col, "_graphloom_h"])
    return out.join(bounded(again), on, "left_anti").unionAll(twice.drop("_graphloom_h"))


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    out = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op1"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) k USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)
"""
