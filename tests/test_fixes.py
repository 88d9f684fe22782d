"""Cases that once gave wrong answers, and the parts added since: stores, runs, targets, exports, validation, questions, snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import convert, text
from graphloom.model import errors
from graphloom.operators import batching, build, export, lookup, validate
from graphloom.plans import config, context, dag, declarative, events, generate, metadata, snapshots
from graphloom.session import configure
from graphloom.sources import paginated, questions, store


def one(spark, *columns):
    return configure(spark).range(1).select(*columns).first()


def test_conversions(spark):
    r = one(spark, *[convert.camel_case(F.lit(n)).alias(f"c{i}") for i, n in enumerate(("XMLHttpRequest", "p2p_name", "Retail Price", "don't stop", "fooBAR"))])
    assert tuple(r) == ("xmlHttpRequest", "p2PName", "retailPrice", "dontStop", "fooBar")
    assert [convert.camel_name(n) for n in ("XMLHttpRequest", "p2p_name", "Retail Price", "don't stop", "fooBAR")] == list(r)
    t = one(spark, *[convert.parse_time(F.lit(x)).alias(f"t{i}") for i, x in enumerate(("2020-10-06T00:00:00Z", "Tue, 06 Oct 2020 00:00:00 GMT", "Oct 6, 2020", "2020/10/06", "10/6/2020", "garbage", ""))])
    assert tuple(t) == (1601942400000,) * 5 + (None, None)
    assert one(spark, convert.parse_time(F.lit("1601942400.5"), "sec").alias("t"), convert.parse_time(F.lit("0"), "ms").alias("z")) == (1601942400500, 0)
    with pytest.raises(Exception, match="precision"):
        one(spark, convert.parse_time(F.lit("2020")).alias("t"))


def test_names_tags_formats(spark):
    cases = {"ip": {"255.1.2.3": True, "999.999.999.999": False, ":": False, "::": True, "::1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7:8:9": False, "1::2::3": False, "::ffff:1.2.3.4": True}, "ipCidr": {"1.2.3.4/32": True, "1.2.3.4/99": False, "2001:db8::/32": True, "::/0": True, "1.2.3.4": False}}
    for name, of in cases.items():
        got = one(spark, *[text.has_format(F.lit(x), name).alias(f"f{i}") for i, x in enumerate(of)])
        assert list(got) == list(of.values()), name
    m = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("TRUE"), F.lit("Name"), F.lit("x"))
    got = one(spark, text.label_tags(m).alias("l"), F.map_keys(text.tag_properties(m)).alias("p"), text.tag_name(m).alias("n"), text.sanitize_name(F.lit("größe (m)")).alias("s"), text.is_host(F.lit("::1/1280")).alias("h"))
    assert tuple(got) == (["b"], ["tag.b", "tag.Name"], "x", "größe__m_", False)


def test_duplicates_with_copies_and_ties(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("c", 1, "x"), ("c", 2, "x")], "_key string, at int, p string")
    got = sorted((r["_key"], r["duplicate_at"], r["properties_match"]) for r in lookup.duplicate_report(d, ["at"], ["p"]).collect())
    assert got == [("a", 1, False), ("a", 1, True), ("c", 2, True)]
    with pytest.raises(errors.DuplicateKeyError, match="'a'"):
        lookup.register_keys(d)
    assert lookup.register_keys(d.where("_key = 'b'")).count() == 1


def test_targets_by_class_and_in_proportion(spark):
    e = spark.createDataFrame([(f"e{i:04d}", "t", "n", ["Host"] if i < 500 else ["Person", "User"]) for i in range(1000)], "_key string, _type string, name string, _class array<string>")
    r = spark.range(1000).withColumn("cls", F.when(F.col("id") % 2 == 0, "User,Person").otherwise("Robot"))
    m = build.mapped_relationships(r, "HAS", source_key=F.col("id"), source_type="s", target={"_type": F.lit("t"), "_class": F.col("cls")}, filter_keys=[["_type", "_class"]], properties={"_key": F.col("id").cast("string")})
    got = {x["_key"]: x["target_key"] for x in lookup.resolve_targets(m, e, ["_type", "name"]).collect()}
    assert set(got.values()) == {"e0500", None} and got["2"] == "e0500" and got["3"] is None
    m = build.mapped_relationships(spark.range(1), "HAS", source_key=F.lit("s"), source_type="s", target={"name": F.lit("n")}, filter_keys=[["name", "absent"], ["unknown"]])
    assert lookup.resolve_targets(m, e, ["name"]).first()["target_key"] == "e0000"  # what the target lacks is not compared
    with pytest.raises(Exception, match="MISSING_RELATIONSHIP_TO_KEY"):
        build.mapped_relationships(spark.range(1), "HAS", source_key=F.lit("s"), source_type="s", target={"name": F.lit("n")}, filter_keys=[]).collect()


def test_shrink_takes_the_largest_field_of_the_largest_payload_of_the_entity_with_most_raw_data(spark):
    e = lambda k, *payloads: {"_key": k, "_rawData": [{"name": f"n{i}", "rawData": p} for i, p in enumerate(payloads)]}
    batch = [e("one", {"a": "x" * 70}), e("two", {"a": "y" * 60, "b": "z" * 59}, {"c": "w"})]
    size = len(json.dumps(batch, separators=(",", ":")))
    out = batching.shrink(batch, size - 1)
    assert out[0] == batch[0] and out[1]["_rawData"][0]["rawData"] == {"a": "TRUNCATED", "b": "z" * 59}
    assert batching.shrink(batch, size) == batch
    for bad in ([{"_key": "k" * 99}], [e("k", {"a": "TRUNCATED"})]):
        with pytest.raises(errors.UploadFailedError):
            batching.shrink(bad, 10)


def test_shrink_query_against_plain_version(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    got = {r["batch"]: tuple(r)[1:] for r in __spark_entry__.queries()["shrink_raw_data"](spark, d).collect()}
    want, size = {}, lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())
    for r in spark.read.parquet(f"{d}/events.parquet").orderBy("event_id").collect():
        want.setdefault(r["event_id"] // 20, []).append({"_key": str(r["event_id"]), "_rawData": [{"name": "default", "rawData": {"props": r["props"], "kind": r["event_type"]}}]})
    for b, rows in want.items():
        while size(rows) > 2000:
            e = max(rows, key=lambda x: size(x["_rawData"]))["_rawData"][0]["rawData"]
            e[max(e, key=lambda k: size(e[k]))] = "TRUNCATED"
        want[b] = (len(rows), size(rows), json.dumps(rows).count('"TRUNCATED"'))
    assert got == want


def test_batches_that_cannot_shrink_fail_alone(spark):
    e = lambda k, **raw: json.dumps({"_key": k, "_rawData": [{"name": "n", "rawData": raw}]}, separators=(",", ":"))
    rows = [(1, 0, e("k" * 90, a="x" * 20, b="y")), (2, 0, e("a", a="x" * 90)), (3, 0, '{"_key":"%s"}' % ("k" * 99)), (4, 0, e("b"))]
    # equal raw data, but a cut of the first is enough and one of the second is not: their order decides
    tie = [(5, 1, e("z", a="x" * 20, b="y" * 2)), (5, 2, e("a", a="x" * 11, b="y" * 11))]
    size = lambda *p: sum(len(x) for x in p) + len(p) + 1
    for frame in (rows + tie, (rows + tie)[::-1]):
        df = spark.createDataFrame(frame, "batch long, o long, payload string").coalesce(1)
        got = {r["batch"]: r for r in batching.shrink_batches(df, "batch", "payload", size(tie[0][2], tie[1][2]) - 9, order="o").collect()}
        assert got[5]["truncated"] == 1 and got[5]["error"] is None
        got = {r["batch"]: r for r in batching.shrink_batches(df, "batch", "payload", 100, order="o").collect()}
        assert got[1]["error"].startswith("payload is still") and (got[1]["rows"], got[1]["bytes"], got[1]["truncated"]) == (1, size(rows[0][2]) - 11, 1)
        assert got[3]["error"] == "payload is too large and cannot shrink" and got[3]["bytes"] == size(rows[2][2])
        assert got[2]["error"] is None and (got[2]["bytes"], got[2]["truncated"]) == (size(rows[1][2]) - 81, 1) and (got[4]["truncated"], got[4]["error"]) == (0, None)


def test_shrink_query_on_long_ids(spark, tmp_path):
    import __spark_entry__

    # ids of 9 digits do not leave room for 20 events of a long kind in 2,000 bytes, the batch of fewer has room
    df = spark.range(10**9, 10**9 + 39).select(F.col("id").alias("event_id"), F.lit('{"k": 10}').alias("props"), F.lit("purchase").alias("event_type"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["batch"]: tuple(r)[1:] for r in __spark_entry__.queries()["shrink_raw_data"](spark, str(tmp_path)).collect()}
    one = len('{"_key":"1000000000","_rawData":[{"name":"default","rawData":{"props":"{\\"k\\": 10}","kind":"purchase"}}]}')
    assert got[10**9 // 20][0] == 20 and got[10**9 // 20][1] > 2000 and got[10**9 // 20 + 1] == (19, 19 * one + 20 - 2 * got[10**9 // 20 + 1][2], got[10**9 // 20 + 1][2])


def test_store_keeps_every_flush(spark, tmp_path):
    df = lambda k: spark.createDataFrame([(k, "t")], "_key string, _type string")
    s = store.ParquetStore(spark, str(tmp_path / "s"))
    for step, keys in (("s1", "ab"), ("s2", "c")):
        c = context.StepContext(spark, step, stores={"entities": s})
        for k in keys:
            c.add("entities", df(k))
            c.flush("entities")
    assert sorted(r["_key"] for r in s.read().collect()) == ["a", "b", "c"] and s.by_step("s1").count() == 2
    other = store.ParquetStore(spark, str(tmp_path / "s"))
    with pytest.raises(errors.InvalidFileError):
        other.read()
    s.publish()
    assert other.read().count() == 3
    assert store.MemoryStore().read().count() == 0


def test_runs_take_the_status_of_the_computation(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("_key"), F.lit("t").alias("_type"))
    good = spark.createDataFrame([("k", "t"), ("l", "u")], "_key string, _type string")
    p = dag.Pipeline([dag.StepSpec("a", types=("t",), run=lambda *x: {"entities": bad}), dag.StepSpec("b", types=("t",), depends_on=("a",), run=lambda *x: {"entities": good}), dag.StepSpec("c", run=lambda *x: {})])
    out, status = p.run(spark, cache={"c": {"entities": good}})
    assert status == {"a": "failure", "b": "partial_success_due_to_dependency_failure", "c": "cached"} and set(out) == {"b", "c"}
    assert "boom" in p.results["a"].error and p.results["b"].counts == {"t": 1, "u": 1} and p.results["b"].undeclared == ("u",) and p.partial_types() == ["t"]
    with pytest.raises(errors.GraphError, match="before"):
        dag.Pipeline([dag.StepSpec("x", graph_id="late"), dag.StepSpec("y", depends_on=("x",))], graph_order=("late",)).run(spark)


def test_closure_of_many_paths(spark):
    steps = [dag.StepSpec("n0")]
    for i in range(24):  # 24 diamonds, 2 ** 24 paths
        steps += [dag.StepSpec(f"l{i}", depends_on=(f"n{i}",)), dag.StepSpec(f"r{i}", depends_on=(f"n{i}",)), dag.StepSpec(f"n{i + 1}", depends_on=(f"l{i}", f"r{i}"))]
    assert dag.closure(dag.steps_frame(spark, steps)).where("step_id = 'n24'").count() == 72


def test_export(spark):
    e = spark.createDataFrame([("k", "my type", ["A B"], 'say "x"', 5, '{"a":1}')], "_key string, _type string, _class array<string>, `1st name` string, n int, _rawData string")
    r = export.nodes(e, "i", ["1st name", "n", "_rawData"]).first()
    assert r["labels"] == ":my_type:A_B" and r["properties"] == {"n1st_name": 'say \\"x\\"', "n": "5", "_rawData": '"{"a":1}"'}
    rel = spark.createDataFrame([("a|has|b", "HAS", "a", "b", "ta", None)], "_key string, _class string, _fromEntityKey string, _toEntityKey string, _fromType string, _toType string")
    assert tuple(export.edges(rel, "i", ["_class"]).first())[1:6] == ("a", "b", ":ta", "", ":HAS")


def test_validation_of_types(spark):
    df = spark.createDataFrame([("k", "t", ["Host"], "h", "beos"), ("l", None, ["Host"], "h", "linux")], "_key string, _type string, _class array<string>, name string, platform string").withColumn("displayName", F.col("name"))
    got = {r["_key"]: r for r in validate.validate_entities(df).collect()}
    assert [(x["schema"], x["property"], x["validation"]) for x in got["k"]["errors"]] == [("#Host", "platform", "enum")] and [x["reason"] for x in got["k"]["skipped"]] == ["not-found"]
    assert [x["property"] for x in got["l"]["errors"]] == ["_type"] and not got["l"]["skipped"]
    typed = validate.validate_entities(df, types={"t": (["Host"], {})}, force=True).where("_key = 'k'").first()
    assert [x["schema"] for x in typed["errors"]] == ["#t", "#Host"] and not typed["skipped"]


def test_questions(spark, tmp_path):
    q = lambda i, **k: {"id": i, "title": f"T{i}", "description": "", "queries": [{"query": "FIND x"}], "tags": ["a"], **k}
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"questions": [q("1"), q("1"), q("2", title="T1", tags=["b", "b"], queries=[{"name": "n", "query": "a"}, {"name": "n", "query": "b"}])]}))
    pack = questions.load(spark, str(path))
    assert sorted(tuple(r) for r in questions.problems(pack).collect()) == [("id", "1", "1"), ("query_name", "2", "n"), ("tag", "2", "b"), ("title", "1", "T1"), ("title", "2", "T1")]
    with pytest.raises(errors.InvalidFileError):
        questions.validate(pack)
    assert questions.validate(pack.limit(1)).count() == 1 and questions.queries(pack).count() == 4
    for bad in ("{}", '{"questions": [{"id": "1"}]}'):
        with pytest.raises(errors.InvalidFileError):
            questions.parse(bad)
    with pytest.raises(errors.InvalidFileError, match="not found"):
        questions.load(spark, str(tmp_path / "none"))


def test_question_packs_of_many_documents_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    import __spark_entry__

    # keys with gaps and in no order; only tasks may read documents
    spark.createDataFrame([(k,) for k in (30, 4, 0, 15, 45, 19, 29, 60, 18, -4)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(questions, "parse", lambda text: pytest.fail("parsed by the driver"))
    monkeypatch.setattr(questions, "DOCUMENT", 3)
    got = __spark_entry__.queries()["question_pack_uniqueness"](spark, str(tmp_path)).collect()
    want = [("id", "q29", "q29"), *[("title", i, "Same title") for i in ("q29", "q45", "q59")], *[("tag", i, "red") for i in ("q4", "q59")], *[("query_name", i, "good") for i in ("q29", "q59", "q18")]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_question_packs_in_folders(spark, tmp_path):
    q = lambda i, **k: {"id": i, "title": f"T{i}", "description": "d", "queries": [{"name": None, "query": "a"}], "tags": ["a"], **k}
    pack = spark.createDataFrame([(9 - i, str(i), f"T{i}", "d", [(None, "a", "v1")], ["a"]) for i in range(9)], questions.SCHEMA)
    questions.write(pack, str(tmp_path / "w"))
    back = questions.load(spark, str(tmp_path / "w")).orderBy("ordinal").collect()
    assert [r["id"] for r in back] == [str(i) for i in range(8, -1, -1)] and back[0]["queries"][0].asDict() == {"name": None, "query": "a", "version": "v1"}
    questions.write(pack.limit(0), str(tmp_path / "none"))
    assert questions.problems(questions.load(spark, str(tmp_path / "none"))).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b c%20.json").write_text(json.dumps({"questions": [q("1", title="later"), q("2")]}))
    (tmp_path / "p" / "a.json").write_text(json.dumps({"questions": [q("1", title="first")]}))
    pack = questions.load(spark, str(tmp_path / "p"))
    assert [r["title"] for r in pack.orderBy("ordinal").collect()] == ["first", "later", "T2"]
    assert [tuple(r) for r in questions.problems(pack).collect()] == [("id", "1", "1")]
    for bad in ("", "{}", json.dumps({"questions": [q("1", tags=[1])]}), json.dumps({"questions": [7]})):
        (tmp_path / "p" / "z.json").write_text(bad)
        with pytest.raises(errors.InvalidFileError):
            questions.load(spark, str(tmp_path / "p"))


def test_metadata(spark):
    meta, entities = metadata.entity_metadata("Person", ["Person", "User"], "my_person")
    assert {"firstName", "username"} <= set(meta.schema.properties)
    with pytest.raises(errors.ConfigError):
        entities(spark.range(1), F.lit("k"), "s", {"nonsense": F.lit(1)})
    assert entities(spark.range(1), F.lit("k"), "s", {"username": F.lit("u")}).first()["_class"] == ["Person", "User"]
    c = metadata.catalogue([("s", [meta])])
    assert "| Person    | `my_person`    | `Person`, `User` |" in metadata.document(c) and "Relationships" not in metadata.document(c)
    assert metadata.put_section("x", "y", "<a>", "<b>") == "x\n\n<a>\ny\n<b>"
    with pytest.raises(errors.ConfigError):
        metadata.put_section("<a> x", "y", "<a>", "<b>")


def test_events_and_masks(spark):
    sent = []

    def publish(e):
        if "bad" in e["description"]:
            raise OSError("down")
        sent.append(e["name"])

    log = events.StepLog(events.EventQueue(publish, "j"), {"a": config.Field(), "b": config.Field(mask=True)})
    log.step_start("s")
    log.step_start("bad")
    log.step_failure("s", errors.ProviderError("no"))
    log.queue.on_idle()
    assert sent == ["step_start", "step_failure"]
    assert log.shown({"a": 1, "b": 2, "c": 3}) == {"a": 1, "b": "***", "c": "***"}
    assert one(spark, events.shown_column({}, F.lit("a"), F.lit("v")).alias("s"))["s"] == "***"
    i = config.local_instance({"apiKey": config.Field()}, {"API_KEY": "k", "DISABLED_INGESTION_SOURCES": "x, y"})
    assert i.config == {"apiKey": "k"} and i.disabled_sources == ("x", "y")


def test_declared_steps():
    step = lambda kind, parent: {"response": {"responseType": kind}, **({"parentAssociation": {"parentEntityType": "p"}} if parent else {})}
    assert [declarative.kind(step(k, p)) for k in ("SINGLETON", "LIST") for p in (False, True)] == ["singleton", "child-singleton", "fetch-entities", "fetch-child-entities"]
    with pytest.raises(errors.ConfigError):
        declarative.compile_template({"steps": [{"id": "a", "entity": {"_type": "t"}}] * 2}, None)


def test_snapshots(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "_key string, _type string, v int")
    s = snapshots.Snapshots(spark, str(tmp_path / "jobs"))
    with pytest.raises(errors.ConfigError):
        s.initiate("api", instance="i")
    a = s.initiate("api", scope="x")
    s.upload(a, df(("a", "t", 1), ("b", "u", 1)))
    s.upload(a, df(("a", "t", 1)))
    assert s.finalize(a).count() == 2 and s.status(a)["status"] == "FINISHED"
    b = s.initiate("api", scope="x")
    s.upload(b, df(("a", "t", 2), ("c", "t", 1)))
    assert {r["_key"]: r["action"] for r in s.actions(b, ["v"], ["u"]).collect()} == {"a": "updated", "b": "kept_partial", "c": "created"}
    assert {r["_key"]: r["action"] for r in s.actions(b, ["v"]).collect()}["b"] == "deleted"
    assert s.abort(b, "no")["status"] == "ABORTED" and s.current().count() == 2
    with pytest.raises(errors.UploadAfterJobEndedError):
        s.upload(b, df(("d", "t", 1)))


def test_pages(spark, tmp_path):
    (tmp_path / "a").write_text(json.dumps({"items": [1, 2], "next": "b"}))
    (tmp_path / "b").write_text(json.dumps({"items": [3]}))
    spark.dataSource.register(paginated.PagesSource)
    read = lambda starts: spark.read.format("pages").option("path", f"file://{tmp_path}").option("starts", starts).load()
    assert sorted(tuple(r) for r in read("a,b").collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "3")]
    with pytest.raises(Exception, match="404"):
        read("none").collect()


def test_selection_order_and_sources():
    steps = [dag.StepSpec("a", ingestion_source="x"), dag.StepSpec("b", depends_on=("a",)), dag.StepSpec("c", depends_on=("b",)), dag.StepSpec("d")]
    assert dag.select_steps(steps, {"b"}) == {"a": True, "b": True, "c": False, "d": False} and all(dag.select_steps(steps, set()).values())
    assert dag.execution_order(steps, "c") == ["a", "b", "c"] and dag.source_children(steps) == {"x": ["b"]}
    assert dag.start_states(steps, ("x",))["a"] == {"disabled": True, "reason": "USER_CONFIG"}
    with pytest.raises(errors.UnknownStepError):
        dag.select_steps(steps, {"z"})


def test_trim_reaches_nested_texts(spark):
    df = spark.range(1).select(F.struct(F.lit(" a ").alias("x"), F.array(F.lit(" b"), F.lit("c ")).alias("y")).alias("s"), F.lit(" k ").alias("k"))
    assert convert.trim_strings(df, ("k",)).first().asDict(True) == {"s": {"x": "a", "y": ["b", "c"]}, "k": " k "}


def test_new_project(spark, tmp_path):
    answers = {"vendor": "My Shop", "entities": [{"name": "User", "class": "User"}, {"name": "Site", "class": "Site"}], "relationships": [{"from": "Site", "class": "HAS", "to": "User"}], "steps": [{"id": "a"}, {"id": "b", "dependsOn": ["a"]}], "config": [{"name": "apiKey", "mask": True}]}
    made = generate.new_project(answers)
    for name, content in made.items():
        (tmp_path / name).write_text(content)
    assert config.load_pipeline(str(tmp_path / "pipeline.py")).run(spark)[1] == {"a": "success", "b": "success"} and made[".env"] == "API_KEY=\n"
    assert json.loads(made["template.json"])["relationships"] == [{"source": "my_shop_site", "class": "HAS", "target": "my_shop_user"}]
    for bad in ({"relationships": [{"from": "Site", "class": "NO", "to": "User"}]}, {"steps": [{"id": "a", "dependsOn": ["a"]}]}, {"entities": [{"name": "x", "class": "Nothing"}]}):
        with pytest.raises(errors.ConfigError):
            generate.new_project(answers | bad)


def test_uncaught_exceptions_are_logged():
    import logging
    import sys

    seen, log = [], logging.getLogger("uncaught")
    log.critical = lambda *a, **k: seen.append(a[0])
    before, sys.excepthook = sys.excepthook, lambda *a: None
    undo = events.log_uncaught(log)
    sys.excepthook(ValueError, ValueError("x"), None)
    undo()
    sys.excepthook = before
    assert seen == ["uncaught exception"]
