"""The training-data operators on small tables with nulls, ties, repeats, long texts and nothing at all."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontamination, embeddings, jaccard, language, mixing, packing, quality, substrings, tokens, toxicity
from graphloom.llm.common import Scratch, connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, rep int"


def docs(spark, rows, source="a"):
    """Documents with two columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t), "clash", 1) for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def texts():
    a = words(120, 1)
    near = a.copy()
    near[60] = "other"
    far = a.copy()
    far[::7] = ["x"] * len(far[::7])
    long = words(30_000, 2)
    return [(5, " ".join(a)), (3, "\t".join(near).upper()), (9, " ".join(far)), (1, None), (2, ""), (4, " \n"), (6, "one two"), (7, "ONE  two"), (8, " ".join(a)), (8, " ".join(a)), (10, " ".join(long)), (11, " ".join(long[:-3])), (None, "one two"), (12, "a " * 500), (13, "a " * 700)]


def brute_components(rows, size=5):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    comp = list(range(len(rows)))
    for x, y in itertools.combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if a and b and rows[x][0] is not None and rows[y][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
            lo, hi = comp[x], comp[y]
            comp = [lo if c == hi else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((i if i is not None else -1, len(s), least.get(c, -1)) for (i, _), s, c in zip(rows, sets, comp))


def test_jaccard_equals_brute_force(spark):
    rows = texts()
    base = words(60, 3)
    r = random.Random(4)
    for i in range(100, 160):  # a crowd of near copies of near copies
        t = base.copy()
        for _ in range(r.randrange(1, 5)):
            t[r.randrange(60)] = f"n{r.randrange(50)}"
        base = t if r.random() < 0.2 else base
        rows.append((i, " ".join(t)))
    for options in ({}, {"few": 1, "block": 8}, {"few": 1}):  # pairs outright; groups in several blocks; groups in one
        got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component"] if r["component"] is not None else -1) for r in jaccard.jaccard_join(docs(spark, rows), Scratch(spark, "t"), **options).collect()]
        assert sorted(got) == brute_components(rows)


def test_jaccard_empty_and_keep_one(spark):
    assert jaccard.jaccard_join(docs(spark, []), Scratch(spark, "t")).count() == 0
    kept = jaccard.keep_one(docs(spark, texts()), Scratch(spark, "t"))
    assert kept.columns[:2] == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 9, 10, 12, None}
    assert jaccard.keep_one(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_keep_one_goes_by_row(spark):
    a, z, q = (" ".join(words(50, 900 + i)) for i in range(3))
    near = a + " more"
    rows = [(5, a), (8, a), (8, z), (9, q), (None, a), (None, a), (3, None), (3, None), (5, near), (7, q), (7, q)]
    kept = jaccard.keep_one(docs(spark, rows), Scratch(spark, "t")).select("doc_id", "text", "h").collect()
    texts_of = sorted((-1 if r[0] is None else r[0], r[1] or "") for r in kept)
    one = [x for x in texts_of if x[0] == 5]
    assert len(one) == 1 and one[0][1] in (a, near)
    assert [x for x in texts_of if x[0] != 5] == sorted([(8, z), (-1, a), (-1, a), (3, ""), (3, ""), (7, q)])
    assert all(r["h"] == "clash" for r in kept)


def test_linked_sets_always_share_a_cell():
    rng = np.random.default_rng(1)
    rarity = rng.integers(0, 50, 1 << jaccard.RARITY_BITS)
    for _ in range(300):
        n = int(rng.integers(1, 300)) if rng.random() < 0.9 else int(rng.integers(900, 1200))
        pool = packing.mix(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a = np.unique(pool[:n])
        d = int(rng.integers(0, max(1, n // 3) + 1))
        cut = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([a[cut:], pool[n : n + d - cut]]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= 75 * (len(a) + len(b) - inter):
            assert len(np.intersect1d(jaccard.cells(a, rarity), jaccard.cells(b, rarity)))
            assert jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * inter


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 5), (7, 8), (7, 8)], "a long, b long")
    assert sorted(tuple(r) for r in connected_components(e, Scratch(spark, "t")).collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 1)]
    assert connected_components(e.limit(0), Scratch(spark, "t")).count() == 0


def brute_substrings(rows, window=20):
    seen, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k, place = tuple(w[p : p + window]), (-1 if i is None else i, p)
            seen[k] = min(seen.get(k, place), place)
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (-1 if i is None else i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("base", [10, 5])
def test_substrings_equal_brute_force(spark, base):
    p = words(45, 7)
    rows = texts() + [(20, " ".join(words(30, 8) + p + words(30, 9))), (21, " ".join(p)), (22, " ".join(p[:19])), (23, " ".join(p + p)), (24, "b " * 90)]
    got = substrings.remove_repeats(docs(spark, rows), Scratch(spark, "t"), base=base).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_substrings(rows)
    assert substrings.remove_repeats(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_decontamination_edges(spark):
    b = spark.createDataFrame([(1, "Alpha beta gamma"), (2, None), (3, "!!"), (4, "solo"), (5, " ".join(words(15, 5))), (5, " ".join(words(15, 5))), (None, "zz yy")], "item_id long, text string")
    d = docs(spark, [(1, "x alpha, BETA; gamma solo"), (2, None), (3, ""), (3, ""), (4, " ".join(["q", *words(15, 5)[2:13], "q"])), (6, "yy zz yy"), (7, "alpha beta")])
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.decontaminate(d, b, Scratch(spark, "t")).collect()}
    assert got == {(1, 5, 4, ("1", "4")), (2, 0, 0, ()), (3, 0, 0, ()), (4, 13, 11, ("5",)), (6, 3, 2, ("null",)), (7, 2, 0, ())}
    assert decontamination.decontaminate(d, b.limit(0), Scratch(spark, "t")).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(d.limit(0), b, Scratch(spark, "t")).count() == 0


def test_chat_folds_and_reads_back(spark):
    e = spark.createDataFrame(
        [(1, 1, "message", 1, "user", "hi <|end|>"), (1, 2, "message", 2, "assistant", "a"), (1, 3, "delta", 2, None, "b"), (1, 4, "edit", 1, None, "hello"), (1, 5, "regenerate", 2, None, "c"), (1, 6, "delta", 2, None, "d"), (2, 1, "delta", 1, "assistant", None)],
        "conv_id long, seq long, kind string, message_id long, role string, text string",
    )
    m = chat.fold_events(e)
    assert sorted(tuple(r) for r in m.collect()) == [(1, 1, "user", "hello"), (1, 2, "assistant", "cd"), (2, 1, "assistant", "")]
    assert chat.fold_events(e.limit(0)).count() == 0


def test_chat_round_trip_of_any_text(spark):
    r = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "x", "é", "\n", "/s>", "s>", "😀"]
    rows = [(c, t, r.choice(["user", "assistant", None, "<|end|>"]), None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randrange(12)))) for c in range(150) for t in range(r.randrange(1, 6))]
    c = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, seq string").drop("seq")
    f = chat.render(chat.fold_events(chat.rows_as_events(c)))
    got = {x["conv_id"]: [tuple(t) for t in x["t"]] for x in f.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {k: [(ro or "", te or "") for _, _, ro, te in g] for k, g in itertools.groupby(rows, key=lambda x: x[0])}
    loss = {x["conv_id"]: x["loss_sha256"] for x in chat.digest(f).collect()}
    assert loss == {k: hashlib.sha256("".join(te or "" for _, _, ro, te in g if ro == "assistant").encode()).hexdigest() for k, g in itertools.groupby(rows, key=lambda x: x[0])}


def test_mixing_targets_and_bounds(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), s) for i in range(400) for s in [("b" if i % 3 else None) if i % 5 else "a"]] + [(9, None, "a"), (9, "w w", "a"), (9, "w w", "a"), (None, "w", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(len(r["times"]) == r["copies"] and all(0 <= t <= 1 for t in r["times"]) and list(r["times"]) == sorted(r["times"]) for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(total)
    for s, t in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) < 1 and t <= 3 * next(r["source_size"] for r in got if r["source"] == s) + 1e-9
    assert mixing.mix(d.limit(0), Scratch(spark, "t")).count() == 0
    order = [r["position"] for r in mixing.in_training_order(mixing.mix(d, Scratch(spark, "t"))).collect()]
    assert order == sorted(order) and len(order) == sum(r["copies"] for r in got)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 65536, 70001):
        out = tokens.permute(np.arange(n), n)
        assert sorted(out.tolist()) == list(range(n))
    assert (tokens.permute(np.arange(1000), 1000, key=1) != tokens.permute(np.arange(1000), 1000, key=2)).mean() > 0.9


def test_token_shards_round_trip(spark, tmp_path):
    import tiktoken
    import base64

    rows = [(1, "Hello there,  world \n\nnew"), (2, None), (3, ""), (3, "x" * 4000), (4, " lead and trail "), (5, "naïve — ça 123\tvier"), (5, "naïve — ça 123\tvier")]
    seqs = tokens.materialize(docs(spark, rows), Scratch(spark, "t"), sequence=64, shard_rows=8).cache()
    got = sorted(seqs.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got))) and all(len(r["tokens"]) == 128 for r in got)
    path = f"file://{tmp_path}/shards"
    plain = tokens.sequences(docs(spark, rows), Scratch(spark, "t"), sequence=64, shard_rows=8)
    manifest = tokens.write_shards(tokens.pack_shards(plain), path, sequence=64).cache()
    assert manifest.count() == -(-len(got) // 8)
    assert list(tokens.read_slots(path, manifest, 3, 11)) == [bytes(r["tokens"]) for r in got[3:14]]
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = tokens.Tokenizer(open(tokens.VOCABULARY, "rb").read())
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice([" ", "  ", "\n", "a", "the", "12", ",", "é", "'s", "　", "\ud800"]) for _ in range(r.randrange(30))).encode("utf-8", "replace").decode()
        assert np.frombuffer(tok(t), np.uint16).tolist() == enc.encode_ordinary(t)
    by_doc = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        by_doc.setdefault(r["doc_id"], []).append(np.frombuffer(r["tokens"], np.uint16)[: r["n_tokens"]])
    assert np.concatenate(by_doc[1]).tolist() == [*enc.encode_ordinary(rows[0][1]), 50256]
    assert tokens.materialize(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_token_rows_are_read_back_from_shards_in_slot_order(spark, tmp_path, monkeypatch):
    rows = [(None if i % 7 == 0 else i, " ".join(words(40, i))) for i in range(60)]
    a = tokens.materialize(docs(spark, rows), Scratch(spark, "t"), sequence=32, shard_rows=8).collect()
    assert [r["slot"] for r in a] == list(range(len(a)))
    b = tokens.through_shards(docs(spark, rows), Scratch(spark, "t"), sequence=32, shard_rows=8).collect()
    assert a == b and any(r["doc_id"] is None for r in b)
    written = []
    write = tokens.write_shards
    monkeypatch.setattr(tokens, "write_shards", lambda *x, **k: written.append(x[1]) or write(*x, **k))
    n = tokens.op4_tokens(spark, "/root/testdata/sf0.001").count()
    assert n and len(written) == 1
    assert tokens.through_shards(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_jaccard_links_counts_every_link(spark):
    base, rows = words(120, 77), texts()
    for i in range(40):
        near = base.copy()
        near[3 * i] = f"other{i}"
        rows += [(100 + i, " ".join(near))] * (1 + i % 2)
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w and i is not None else frozenset())
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((-1 if i is None else i, sum(linked(a, b) for b in sets) - bool(a)) for (i, _), a in zip(rows, sets, strict=True))
    for options in ({}, {"few": 1, "block": 16}, {"few": 3, "block": 4}):
        out = jaccard.jaccard_join(docs(spark, rows), Scratch(spark, "t"), **options).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_links"]) for r in out) == want


def test_intersections_equal_set_operations(monkeypatch):
    monkeypatch.setattr(jaccard, "_COLUMNS", 16)
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(k)] for k in (13, 9))
    assert jaccard._intersections(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_embeddings_edges(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * (0.05 + 0.03 * (i % 5))).astype("float32").tolist(), i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None] * 8, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1][:8], 0), (207, [], 1), (208, [float("inf")] * 16, 1)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component"], r["kept"]) for r in embeddings.near_duplicates(d, Scratch(spark, "t")).collect()}
    fine = [(i, np.array(v, dtype="float64"), lab) for i, v, lab in rows if i < 120 or i in (205, 206)]
    comp, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    for (i, a, x), (j, b, y) in itertools.combinations(fine, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[j] += 1
            lo, hi = min(comp[i], comp[j]), max(comp[i], comp[j])
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    assert got == {i: (links[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert embeddings.near_duplicates(d.limit(0), Scratch(spark, "t")).count() == 0


def labelled(spark, name):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", name).toPandas().set_index("doc_id")[name]
    return d, lab


def extra(spark, d):
    """The table with odd rows added."""
    return d.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "a", 0), (-2, "", "en", "a", 0), (-3, "x " * 60_000, "en", "a", 9), (None, "some words", None, None, 1)], d.schema))


def test_quality_held_out(spark):
    d, lab = labelled(spark, "quality")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, labels)
    r = quality.score(extra(spark, d), model).toPandas()
    assert len(r) == d.count() + 5 and r["score"].between(0, 1).all() and ((r["score"] >= 0.7) == (r["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(r["doc_id"], r["held_out"]) if i == i)
    h = r[r["held_out"] & r["doc_id"].isin(lab.index)]
    assert (h["predicted"] == h["doc_id"].map(lab)).mean() >= 0.9
    assert quality.score(d.limit(0), model).count() == 0 and quality.fit(d, labels.limit(0))[1] == 0.0
    kept = quality.accept(extra(spark, d), model)
    assert kept.schema == extra(spark, d).schema and kept.count() == int((r["score"] >= 0.7).sum())


def test_toxicity_held_out_and_exact_search(spark):
    d, lab = labelled(spark, "toxic")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    index = toxicity.fit(d, labels)
    r = toxicity.score(extra(spark, d), index).toPandas()
    assert len(r) == d.count() + 5 and r["score"].between(0, 1).all()
    h = r[r["held_out"] & r["doc_id"].isin(lab.index)]
    y = h["doc_id"].map(lab)
    assert (h["predicted"] == y).mean() >= 0.93 and h.loc[y == 1, "score"].mean() > h.loc[y == 0, "score"].mean()
    # brute force: all cosines, the vote and the calibration of every document
    dense = np.zeros((len(index.y), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        at = slice(index.ptr[t], index.ptr[t + 1])
        dense[index.row[at], t] = index.w[at]
    assert np.allclose((dense * dense).sum(axis=1)[dense.any(axis=1)], 1)
    scores = r.drop_duplicates("doc_id").set_index("doc_id")["score"]
    for x in d.collect():
        t, w = index.vector(x["text"])
        cos = dense[:, t] @ w
        best = np.lexsort((np.arange(len(cos)), -cos))[: toxicity.K]
        best = best[cos[best] > 0]
        rows, got = index.nearest(t, w)
        assert np.allclose(got, cos[best]) and np.allclose(cos[rows], got)
        weight = 1 / np.maximum(1 - cos[best], 1e-3)
        vote = min(max(float(weight @ index.y[best] / weight.sum()) if len(best) else 0.0, 0.01), 0.99)
        assert abs(scores[x["doc_id"]] - 1 / (1 + np.exp(-(index.a * np.log(vote / (1 - vote)) + index.b)))) < 1e-6
        # a document that shares a term with an example has a neighbour
        assert bool(len(rows)) == bool(len(t))
    twice = toxicity.fit(d.unionAll(d), labels.unionAll(labels))
    assert len(twice.y) == len(index.y) and (twice.a, twice.b) == pytest.approx((index.a, index.b), rel=0.05, abs=0.05)
    assert toxicity.fit(d, labels.limit(0)) is None and toxicity.score(d, None).where("score <> 0").count() == 0


def test_toxicity_cosine_takes_all_terms(spark):
    """Examples of words of their own: no term is frequent enough to tell the labels apart, and all must count."""
    d = docs(spark, [(i, " ".join(words(30, i // 2))) for i in range(40)])
    index = toxicity.fit(d, spark.createDataFrame([(i, 0, i // 2 % 2) for i in range(40)], "doc_id long, quality int, toxic int"), held=-1)
    known = {int(x) for x in index.vocabulary.terms}
    assert len(index.y) == 40
    for r in d.collect():
        assert known.issuperset(toxicity.terms_of(r["text"]).tolist())
        rows, cos = index.nearest(*index.vector(r["text"]), 2)
        assert {index.ids[i] // 2 for i in rows} == {r["doc_id"] // 2} and np.allclose(cos, 1, atol=1e-6)


def test_language_held_out(spark):
    d, _ = labelled(spark, "toxic")
    model = language.fit(d)
    r = language.identify(extra(spark, d), model).toPandas()
    truth = d.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    h = r[r["held_out"] & r["doc_id"].isin(truth.index)]
    assert (h["lang_pred"] == h["doc_id"].map(truth)).mean() >= 0.9
    odd = r[r["doc_id"].isin([-1, -2])]
    assert (odd["lang_pred"] == "und").all() and (odd["score"] == 0).all()
    assert language.fit(d.limit(0)) is None and set(language.identify(d, None).toPandas()["lang_pred"]) == {"und"}


def test_tabulated_network_is_the_network():
    net = language.ByteCNN(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (9, language.WINDOW)).astype(np.uint8)
    assert np.allclose(net.predict(x, net.tables()), net._forward(x)[0], atol=1e-4)


def test_pipeline_keeps_to_rows_of_null_ids(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    d = spark.createDataFrame([(None, passage, "en", "web", 1), (None, "clean words here", "en", "web", 1), (1, "more clean words", "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = P.benchmark_decontamination(spark, d, sf).cache()
    assert sorted(r["text"] for r in clean.collect()) == ["clean words here", "more clean words"]
    mixed = P.source_mixing(spark, clean, sf).collect()
    assert {r["text"] for r in mixed} == {"clean words here", "more clean words"}


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    accepted = P.quality_classifier(spark, d, sf)
    single = P.jaccard_join(spark, accepted, sf).cache()
    comp = jaccard.jaccard_join(accepted, Scratch(spark, "t"))
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in comp.where("doc_id = component").select("doc_id").collect()}
    clean = P.benchmark_decontamination(spark, single, sf).cache()
    dirty = decontamination.decontaminate(single, spark.read.parquet(f"{sf}/benchmark.parquet"), Scratch(spark, "t")).where("n_hit > 0")
    assert clean.count() == single.count() - dirty.count() and clean.columns == d.columns
    mixed = P.source_mixing(spark, clean, sf).cache()
    assert mixed.columns == d.columns and {r[0] for r in mixed.select("doc_id").collect()} <= {r[0] for r in clean.select("doc_id").collect()}
    out = P.token_output(spark, mixed, sf)
    assert out.agg(F.count_distinct("slot")).first()[0] == out.count() and out.where("seq = 0").count() == mixed.count()
