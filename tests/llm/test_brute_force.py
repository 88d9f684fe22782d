"""Whole queries against plain versions of them, and odd rows for every operator."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, decontamination, embeddings, jaccard, language, mixing, quality, tokens, toxicity
from graphloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
D = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def plain_score(model, text):
    """The quality score, feature by feature."""
    logits, bias = model
    shift = 64 - int(np.log2(len(logits)))
    raw = (text or "").encode("utf-8", "replace")
    found = []
    for k in quality.CHAR_NGRAMS:
        for i in range(len(raw) - k + 1):
            found.append((int.from_bytes(raw[i : i + k], "little") + k) * 0x9E3779B97F4A7C15 % (1 << 64) >> shift)
    words = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        h = sum((c + 1) * pow(0xD6E8FEB86659FD93, j, 1 << 64) for j, c in enumerate(w)) & M64
        words.append((h ^ 0x5851F42D4C957F2D) * 0x9E3779B97F4A7C15 & M64)
    found += [w >> shift for w in words] + [0] * sum(a == b for a, b in itertools.pairwise(words))
    z = bias + (float(np.mean([float(logits[f]) for f in found])) if found else 0.0)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_quality_query_is_the_plain_score(spark):
    d, lab = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = quality.fit(d, lab)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in quality.op3_quality(spark, D).collect():
        want = plain_score(model, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-5 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_query_is_the_plain_network(spark):
    d = spark.read.parquet(f"{D}/documents.parquet")
    net = language.fit(d)
    got = {r["doc_id"]: r for r in language.op8_language(spark, D).collect()}
    for r in d.collect():
        t, x = r["text"], got[r["doc_id"]]
        if not t or not re.search(r"[^\W\d_]", t):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        w = language.windows_of(t)
        weight = np.array([sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in row) + 1e-3 for row in w.tolist()])
        p = weight @ net._forward(w)[0] / weight.sum()
        assert abs(x["score"] - p.max()) < 1e-3 and (x["lang_pred"] == net.classes[p.argmax()] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)


def plain_permutation(x, n, key):
    """A Feistel network and cycle-walking in plain integers."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(tokens.ROUNDS):
            k = int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")
            f = (right + k) * 0x9E3779B97F4A7C15 & M64
            f = (f ^ f >> 29) * 0xBF58476D1CE4E5B9 & M64
            left, right = right, left ^ (f >> 32 & mask)
        x = left << half | right
        if x < n:
            return x


def plain_sequences(texts, size=tokens.SEQUENCE, segment=None):
    """Rows (slot, id, seq, n_tokens, ids) of texts (id, text) in their order."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.VOCABULARY, "rb"))}
    encode = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = []
    for i, t in texts:
        ids = [*encode((t or "").encode("utf-8", "replace").decode()), 50256]
        rows += [(i, s, ids[at : at + size]) for s, at in enumerate(range(0, len(ids), size))]
    n = len(rows)
    step = segment if segment and segment < n else n
    out = []
    for k, (i, s, ids) in enumerate(rows):
        lo = k // step * step
        slot = lo + plain_permutation(k - lo, min(step, n - lo), tokens.KEY + (k // step if step < n else 0))
        out.append((slot, i, s, len(ids), ids + [50256] * (size - len(ids))))
    return sorted(out)


def shown(rows):
    return sorted((r["slot"], r["doc_id"], r["seq"], r["n_tokens"], np.frombuffer(r["tokens"], np.uint16).tolist()) for r in rows)


def test_token_query_has_every_slot(spark):
    d = spark.read.parquet(f"{D}/documents.parquet")
    keyed = d.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("k")).collect()
    want = plain_sequences([(r["doc_id"], r["text"]) for r in sorted(keyed, key=lambda r: (r["k"], r["doc_id"]))])
    assert shown(tokens.op4_tokens(spark, D).collect()) == want
    some = [(i, " ".join(f"w{j}" for j in range(i % 9 * 5))) for i in range(90)]
    rows = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in some], DOCS)
    order = (F.col("doc_id") / 90.0, [F.col("doc_id")])
    a = tokens.through_shards(rows, Scratch(spark, "t"), order=order, segment=16, sequence=8, shard_rows=4).collect()
    b = tokens.through_shards(rows.repartition(7), Scratch(spark, "t"), order=order, segment=16, sequence=8, shard_rows=4).collect()
    assert shown(a) == shown(b) == plain_sequences(some, 8, 16)


def plain_links(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def shingle_set(t, words=r"[^\x20\x09-\x0D]+"):
    w = re.findall(words, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_contaminated(t, items):
    w = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for x in (t, *items)]
    windows = {tuple(x[i : i + 10]) for x in w[1:] if x for i in range(max(len(x) - 9, 1))}
    return any(tuple(w[0][i : i + len(x)]) == x for x in windows for i in range(len(w[0]) - len(x) + 1))


def plain_mix(docs):
    """(training time, document) of every copy, in order."""
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    names = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[id(r)] for r in docs if r["source"] == s) for s in names}
    target, left, rest = {}, dict(total), float(sum(total.values()))
    while left:
        level = rest / sum(weight[s] for s in left)
        full = [s for s in left if 3 * total[s] < level * weight[s]]
        for s in full or list(left):
            target[s] = 3.0 * total[s] if full else level * weight[s]
            del left[s]
        rest = sum(total.values()) - sum(target.values())
    out = []
    for n, s in enumerate(names):
        a, b = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))[n % 3]
        before, epochs = 0, int(target[s] // total[s]) if total[s] else 0
        more = int(target[s] - epochs * total[s] + 1e-9)
        key = lambda r: (hashlib.md5(f'{"" if r["doc_id"] is None else r["doc_id"]}|{hashlib.md5((r["text"] or "").encode()).hexdigest()}'.encode()).hexdigest(), r["doc_id"] or 0, size[id(r)])
        for r in sorted((r for r in docs if r["source"] == s), key=key):
            words = size[id(r)]
            part = max(0, min(words, more - before))
            taken = epochs * words + part
            copies = min(int(taken / max(words, 1) + 0.5), epochs + (part > 0)) if words else 0
            for c in range(copies):
                share = min((before + words / 2 + c * total[s]) / target[s], 1.0)
                slope, mean = b - a, (a + b) / 2
                t = share if abs(slope) < 1e-12 else (-a + max(a * a + 2 * slope * share * mean, 0.0) ** 0.5) / slope
                out.append((min(max(t, 0.0), 1.0), r))
            before += words
    return [r for _, r in sorted(out, key=lambda x: (x[0], x[1]["doc_id"] if x[1]["doc_id"] is not None else -1))]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Tables in which each stage has something to do, with null and repeated ids."""
    r = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "sor", "vel") for c in ("a", "is", "o", "un")]
    text = lambda n: " ".join(r.choice(vocabulary) + str(r.randrange(50)) for _ in range(n))
    bench = [text(14), text(12), "only four words here"]
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 3
        t = text(r.randrange(20, 90)) if good else " ".join("@@##" * r.randrange(1, 4) for _ in range(40))
        if good and i % 11 == 0:
            t = text(8) + " " + bench[i % 2] + " " + text(8)
        if good and i % 13 == 0:
            t = rows[i - 3][1] if i > 3 and rows[i - 3][1] else t
        rows.append([i, t, "en", ["a", "b", None][i % 3] if i % 5 else "c", len(t)])
        labels.append((i, int(good), 0))
    rows[8][0] = None
    rows[20][0] = 16  # an id with two texts
    rows.append([None, text(30) + " " + bench[0], "en", "a", 1])
    rows.append([rows[40][0], rows[40][1], "en", rows[40][3], 1])
    rows += [[500, None, "en", "a", 0], [501, "", "en", "b", 0]]
    d = tmp_path_factory.mktemp("fixture")
    spark.createDataFrame([tuple(x) for x in rows], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_pipeline_is_the_plain_pipeline(spark, fixture, tmp_path):
    docs, key = spark.read.parquet(f"{fixture}/documents.parquet"), lambda r: tuple((x is not None, x) for x in r)
    model = quality.fit(docs, spark.read.parquet(f"{fixture}/labels.parquet"))
    items = [r["text"] for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    want, lost = docs.collect(), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = len(want)
        if n == 0:
            want = [r for r in want if plain_score(model, r["text"]) >= 0.7]
        elif n == 1:
            sets, comp = [shingle_set(r["text"]) for r in want], list(range(len(want)))
            for x, y in itertools.combinations(range(len(want)), 2):
                if want[x]["doc_id"] is not None and want[y]["doc_id"] is not None and plain_links(sets[x], sets[y]):
                    comp = [comp[x] if c == comp[y] else c for c in comp]
            groups = {}
            for r, c in zip(want, comp, strict=True):
                groups.setdefault(c, []).append(r)
            want = [min(g, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1)) for g in groups.values()]
        elif n == 2:
            want = [r for r in want if not plain_contaminated(r["text"], items)]
        elif n == 3:
            want = plain_mix(want)
        out = stage(spark, docs, fixture)
        if n == 4:
            assert shown(out.collect()) == plain_sequences([(r["doc_id"], r["text"]) for r in want], segment=corpus_pipeline.SEGMENT)
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        got = docs.collect()
        lost.append(before - len(got))
        # copies of one text may differ in columns that the stage does not look at
        assert sorted((key((r["doc_id"], r["text"])) for r in got)) == sorted(key((r["doc_id"], r["text"])) for r in want), name
        if n == 3:
            placed = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
            assert [(r["doc_id"], r["text"]) for r in placed] == [(r["doc_id"], r["text"]) for r in want]
        want = got if n < 3 else want
    assert all(x > 0 for x in lost[:3])


def test_pipeline_of_nothing(spark, fixture, tmp_path):
    empty = spark.read.parquet(f"{fixture}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, fixture).count() == 0, name


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 60_000, "en", "a", 9), (None, "some words here", "fr", None, 1), (4, "some words here", "fr", "b", 1), (4, "other words here", "fr", "b", 1)]
    d = spark.createDataFrame(rows, DOCS)
    for name in ("id", "h", "cls", "rep", "score", "size", "taken", "part", "component", "_h", "_y", "_u", "shard", "w", "neighbours", "window"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def test_odd_rows(spark):
    d, b = odd(spark), spark.createDataFrame([(1, "some words", "clash"), (None, None, "clash")], "item_id long, text string, h string")
    labels = spark.createDataFrame([(i, i % 2, i % 2, "clash") for i in (1, 2, 3, 4, 4)], "doc_id long, quality int, toxic int, score string")
    s = lambda: Scratch(spark, "odd")
    n = d.count()
    assert sorted(r["n_links"] for r in jaccard.jaccard_join(d, s()).collect()) == [0] * n
    assert jaccard.keep_one(d, s()).count() == n
    for mod, held in ((5, 0), (1, 0)):  # with labels, and with none to learn from
        index = toxicity.fit(d, labels, mod=mod, held=held)
        out = toxicity.score(d, index).collect()
        assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)
        model = quality.fit(d, labels, mod=mod, held=held)
        assert quality.score(d, model).count() == n and quality.accept(d, model).schema == d.schema
        assert language.identify(d, language.fit(d, mod=mod, held=held)).count() == n
    assert toxicity.score(d.limit(0), None).count() == language.identify(d.limit(0), None).count() == quality.score(d.limit(0), model).count() == 0
    hit = {(r["doc_id"], r["n_hit"]) for r in decontamination.decontaminate(d, b, s()).collect()}
    assert hit == {(1, 0), (2, 0), (3, 0), (None, 2), (4, 2), (4, 0)}
    plan = mixing.mix(d, s()).collect()
    assert len(plan) == n and {r["doc_id"]: r["size"] for r in plan}[3] == 60_000
    assert tokens.through_shards(d, s()).agg(F.sum("n_tokens")).first()[0] > 60_000


def test_odd_conversations(spark):
    c = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "word " * 100_000, "x"), (None, 1, "assistant", "a", "x")], "conv_id long, turn long, role string, text string, seq string")
    f = chat.render(chat.fold_events(chat.rows_as_events(c)))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digest(f).collect()}
    assert got == {1: (3, 0), None: (1, 1)}
    none = chat.render(chat.fold_events(chat.rows_as_events(c.limit(0))))
    assert none.count() == 0 and chat.digest(none).count() == 0


def test_embeddings_of_extreme_sizes_and_recall(spark):
    v = lambda x: [x * c for c in (1.0, 2.0, -1.0, 0.5)]
    rows = [(1, v(1e200), 1), (2, v(1.0), 1), (3, v(1e-200), 1), (4, [-x for x in v(1.0)], 1), (5, v(1.0), 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(d, Scratch(spark, "t")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x = np.stack(e["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (e["label"].to_numpy()[:, None] == e["label"].to_numpy()[None, :])
    want = int(near.sum()) - len(e)
    found = sum(r["n_links"] for r in embeddings.op5_embeddings(spark, "/root/testdata/sf0.01").collect())
    assert 0.9 * want <= found <= want + 2


