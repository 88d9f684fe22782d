"""Run-time parts without a query of their own: clients, files, configuration, synchronisation, step contexts."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import errors, registry
from graphloom.plans import config, context, dag, sync
from graphloom.sources import client, files, render, store
from graphloom.sources.paginated import Response as R


def test_json_files_S05_K01_K02_K17_X31(spark, tmp_path):
    root = str(tmp_path / "root")
    assert files.storage_bytes(spark, root) == 0
    for name in ("a/plain.json", "a/packed.json.gz"):
        files.write_json(spark, f"{root}/{name}", {"x": ["é", 1]}, pretty=True)
        assert files.read_json(spark, f"{root}/{name}") == {"x": ["é", 1]}
    assert gzip.decompress((tmp_path / "root/a/packed.json.gz").read_bytes()).startswith(b"{\n")
    files.write_frame(spark.range(3).withColumnRenamed("id", "n"), f"{root}/t")
    assert spark.read.parquet(f"{root}/t").count() == 3 and files.storage_bytes(spark, root) > 100
    files.write_file(spark, f"{root}/bad.json", "{no")
    with pytest.raises(errors.InvalidFileError):
        files.read_json(spark, f"{root}/bad.json")
    files.remove_storage(spark, root)
    files.remove_storage(spark, root)
    assert not (tmp_path / "root").exists()


def test_client_S11_X55():
    calls, asked = [], []
    c = client.Client(lambda x: calls.append(x) or R(200, {}), "https://h/v1/", lambda: asked.append(1) or {"authorization": "t"})
    c.call("rows", "POST", {"a": "b c"}, "form")
    c.call("rows", "POST", {"a": 1})
    assert [x.url for x in calls] == ["https://h/v1/rows"] * 2 and asked == [1]
    assert calls[0].body == b"a=b+c" and json.loads(calls[1].body) == {"a": 1} and calls[1].headers["authorization"] == "t"
    with pytest.raises(errors.ConfigError):
        c.call("rows", body="x", kind="xml")


def test_client_retries_S12_X37():
    waits, answers = [], [R(500), R(429), R(200, "ok")]
    assert client.Client(lambda x: answers.pop(0), delay=30, sleep=waits.append).request("u").body == "ok" and waits == [30, 60]
    answers = [R(404), R(200)]
    with pytest.raises(errors.ProviderError):
        client.Client(lambda x: answers.pop(0), sleep=waits.append).request("u")
    assert len(answers) == 1
    tries = []

    def slow(x):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return R(200)

    assert client.Client(slow, sleep=waits.append).request("u").status == 200
    with pytest.raises(errors.RetriesExceededError):
        client.Client(lambda x: (_ for _ in ()).throw(TimeoutError()), timeout_cycles=1).request("u")


def test_rate_limits_S13_X35_X36():
    rate, waits = client.RateLimit(0.5), []
    h = {"RateLimit-Limit": "10", "RateLimit-Remaining": "4", "RateLimit-Reset": "7"}
    client.Client(lambda x: R(200, None, h), rate=rate, sleep=waits.append).request("u")
    client.Client(lambda x: R(200, None, {**h, "RateLimit-Remaining": "5"}), rate=rate, sleep=waits.append).request("u")
    client.Client(lambda x: R(200), rate=rate, sleep=waits.append).request("u")
    assert waits == [8.0]
    epoch = client.RateLimit(mode=client.EPOCH)
    assert client.reset_delay({}, rate) == 60 and client.reset_delay({"ratelimit-reset": "110"}, epoch, lambda: 100.0) == 11
    assert client.reset_delay({"ratelimit-reset": "5", "date": "Thu, 01 Jan 1970 00:00:02 GMT"}, epoch) == 4
    with pytest.raises(errors.ConfigError):
        client.reset_delay({"ratelimit-reset": "5"}, client.RateLimit(mode="other"))


def test_recording_S19(tmp_path):
    path = str(tmp_path / "r.json")
    rec = client.Recording(path, lambda c: R(200, {"n": 1}, {"Set-Cookie": "s"}))
    client.Client(rec, auth=lambda: {"Authorization": "secret"}).call("u")
    rec.save()
    assert "secret" not in (tmp_path / "r.json").read_text() and '"s"' not in (tmp_path / "r.json").read_text()
    again = client.Recording(path)
    assert client.Client(again).call("u").body == {"n": 1}
    with pytest.raises(LookupError):
        client.Client(again).call("u")


def test_config_S18_F26_L09():
    fields = {"apiKey": config.Field(mask=True), "useTLS": config.Field("boolean", optional=True), "extra": config.Field("json", optional=True)}
    assert config.from_environment(fields, {"API_KEY": "k", "USE_TLS": "TRUE", "EXTRA": '{"a":[1]}'}) == {"apiKey": "k", "useTLS": True, "extra": {"a": [1]}}
    assert config.from_environment(fields, {"API_KEY": ""}) == {"apiKey": ""}
    assert config.masked_fields(fields) == ["apiKey"]
    with pytest.raises(errors.ConfigFieldMissingError):
        config.from_environment(fields, {})
    for bad in ({"USE_TLS": "yes"}, {"EXTRA": "{"}):
        with pytest.raises(errors.ConfigFieldTypeError):
            config.from_environment(fields, {"API_KEY": "k", **bad})


def test_sync_options_X02_X52():
    assert config.job_fields("api", "s", "i", "j") == {"source": "api", "scope": "s"}
    assert config.job_fields("system-internal", "s", "i", "j") == {"source": "system-internal", "scope": "s", "integrationInstanceId": "i", "integrationJobId": "j"}
    assert "scope" not in config.job_fields("integration-managed", "s", "i", "j")
    config.check_sync("api", "s"), config.check_sync("integration-external", None, "i")
    for bad in (("api",), ("api", "s", "i"), ("integration-managed",), ("other", None, "i")):
        with pytest.raises(errors.ConfigError):
            config.check_sync(*bad)


def test_type_names_and_modules_P15_X58_X62(tmp_path):
    assert config.entity_type("Acme", "user Group") == "acme_user_group"
    with pytest.raises(errors.ConfigError):
        config.entity_type("", "")
    (tmp_path / "p.py").write_text("pipeline = 7")
    (tmp_path / "q.py").write_text("")
    assert config.load_pipeline(str(tmp_path / "p.py")) == 7
    with pytest.raises(errors.ConfigError):
        config.load_pipeline(str(tmp_path / "q.py"))


def test_upload_chunk_K07_K08_X05_X06_X65():
    sent, waits = [], []
    answers = [R(413), R(500), R(200)]
    big = [{"_key": "a", "_rawData": [{"name": "default", "rawData": {"big": "x" * 500}}]}]
    assert sync.upload_chunk(lambda c: sent.append(c) or answers.pop(0), "u", "entities", big, "0", limit=200, sleep=waits.append) == 3
    bodies = [json.loads(gzip.decompress(c.body)) for c in sent]
    assert bodies[0]["entities"] == big and bodies[1]["entities"][0]["_rawData"][0]["rawData"]["big"] == "TRUNCATED" and sent[0].headers["content-encoding"] == "gzip"
    assert waits == [pytest.approx(0.2), pytest.approx(0.21)]
    ended = R(400, {"error": {"code": "JOB_NOT_AWAITING_UPLOADS", "message": "m"}})
    with pytest.raises(errors.UploadAfterJobEndedError):
        sync.upload_chunk(lambda c: ended, "u", "entities", [], "0")
    with pytest.raises(errors.UploadFailedError):
        sync.upload_chunk(lambda c: R(500), "u", "entities", [], "0", sleep=waits.append)
    e = sync.sync_error(ended, "no")
    assert (e.code, str(e)) == ("SYNCHRONIZATION_API_RESPONSE_ERROR", 'no (API response: code=JOB_NOT_AWAITING_UPLOADS, message="m").')
    assert sync.sync_error(R(500, "text"), "no").code == "UNEXPECTED_SYNCRONIZATION_ERROR" and sync.error_body(R(500, "text")) is None


def test_upload_on_executors_K07(spark):
    rows = spark.createDataFrame([(0, '{"_key":"a"}'), (0, '{"_key":"b"}'), (1, '{"_key":"c"}')], "batch long, payload string")
    got = sync.upload(rows, lambda: lambda call: R(200), "u", "entities").collect()
    assert sorted((r["batch"], r["rows"], r["attempts"]) for r in got) == [(0, 2, 1), (1, 1, 1)]


def test_job_status_X03_T11_T12_T13():
    states, seen = ["PENDING", "RUNNING", "FINISHED"], []
    assert sync.wait(lambda c: R(200, {"job": {"status": states.pop(0)}}), "u", progress=lambda j: seen.append(j["status"]), sleep=lambda s: None)["status"] == "FINISHED"
    assert seen == ["PENDING", "RUNNING"]
    calls = []
    assert sync.abort(lambda c: calls.append(c) or R(200, {"job": {"id": 1}}), "u", "why") == {"id": 1}
    assert calls[0].url == "u/abort" and json.loads(calls[0].body) == {"reason": "why", "terminalStatus": "ABORTED"}
    with pytest.raises(errors.SyncUnexpectedError):
        sync.status(lambda c: R(500), "u")
    metrics, clock = [], iter([1.0, 1.5])
    with pytest.raises(ValueError), sync.timed(metrics.append, "m", lambda: next(clock), step="s"):
        raise ValueError
    assert metrics == [{"name": "m", "unit": "Milliseconds", "value": 500, "dimensions": {"step": "s"}}]


def test_context_T06_U04_U10_X11_X12_X13_X14_X18_X25_X27_X42(spark):
    df = lambda *keys: spark.createDataFrame([(k, "t") for k in keys], "_key string, _type string")
    stored = []
    c = context.StepContext(spark, "s", given={"entities": df("g")}, before=lambda d: d.withColumn("_key", F.upper("_key")), after=lambda kind, d: stored.append((kind, d.count())), stores={"entities": store.MemoryStore()})
    c.set("a", 1)
    assert c.get("a") == 1
    c.delete("a")
    assert c.get("a") is None and c.collected("entities") is None
    c.add("entities", df("x"))
    c.flush("entities"), c.flush("entities")
    assert stored == [("entities", 1)] and c.buffered("entities") is None
    c.add("entities", df("y"))
    keys = lambda d: sorted(r["_key"] for r in d.collect())
    assert keys(c.collected("entities")) == ["X", "Y"] and keys(c.visible("entities")) == ["X", "Y", "g"] and keys(c.iterate("entities", "t")) == ["X", "Y", "g"]
    assert {r["_key"]: r["known"] for r in c.has_key(df("g", "X", "z"), "_key").collect()} == {"g": True, "X": True, "z": False}
    assert not c.has_key(df("g"), "_key", "relationships").first()["known"] and c.iterate("relationships", "t") is None
    c.add("relationships", df("r"))
    with pytest.raises(errors.ConfigError):
        c.flush("relationships")


def test_step_helpers_G04_G13_X24_U06_U08_X63(spark):
    df = lambda k: {"entities": spark.createDataFrame([(k,)], "_key string")}
    steps = [dag.StepSpec("a", run=lambda *_: df("a")), dag.StepSpec("b", depends_on=("a",), run=lambda sp, ctx, out: df(out["a"]["entities"].first()[0] + "b")), dag.StepSpec("c", depends_on=("b",)), dag.StepSpec("z", run=lambda *_: 1 / 0)]
    own, keys = context.run_with_dependencies(spark, steps, "b")
    assert own["entities"].first()[0] == "ab" and sorted(r[0] for r in keys.collect()) == ["a", "ab"]
    assert context.dependencies_complete(steps, "c", {"a": dag.SUCCESS, "b": dag.FAILURE}) and not context.dependencies_complete(steps, "c", {"b": dag.SUCCESS})
    assert [(s.id, s.depends_on) for s in context.without(steps, "a")] == [("b", ()), ("c", ("b",)), ("z", ())]
    seen = []
    around = lambda f: lambda *x: seen.append("in") or f(*x)
    assert context.wrapped(steps[0], around).run(spark, {}, {})["entities"].first()[0] == "a" and seen == ["in"]

    def bad(_):
        raise ValueError("no token")

    with pytest.raises(errors.ConfigError, match="no token"):
        context.run_checked(bad, {}, lambda: seen.append("ran"))
    assert seen == ["in"] and context.run_checked(None, {}, lambda: 5) == 5
    text = context.summary({"a": dag.SUCCESS, "b": dag.FAILURE}, {"a": ["x"], "b": ["y"]}, ["t"])
    assert text.splitlines() == ["+ a: success", "x b: failure", "! a made undeclared types: x", "! incomplete: t"]


def test_page_K13(spark):
    nodes = spark.createDataFrame([("a", "</script>"), ("b", "B")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "HAS")], "from string, to string, label string")
    page = render.graph_html(nodes, edges)
    assert '"label": "HAS"' in page and page.count("</script>") == 1
    assert "no nodes" in render.graph_html(nodes.limit(0), edges.limit(0))
    with pytest.raises(errors.ConfigError):
        render.graph_html(nodes, edges, most=1)


def test_schemas_A27_X53():
    s = {"required": ["a", "a"], "properties": {"a": {"type": ["string", "null", "string"], "enum": ["x", "x"]}, "b": {"type": "string"}}}
    assert registry.dedup_types(s) == {"required": ["a"], "properties": {"a": {"type": ["string", "null"], "enum": ["x"]}, "b": {"type": "string"}}}
    assert registry.shared_registry() is registry.shared_registry()


def test_csv_from_any_folder_Q14(spark, tmp_path):
    path = str(tmp_path / "anywhere" / "assets")
    store.write_csv(spark.createDataFrame([("k", "t", 'a "q", b')], "_key string, _type string, name string"), path)
    assert store.read_csv(spark, path, "_key string, name string, _type string").first()["name"] == 'a "q", b'
