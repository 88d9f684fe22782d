"""Units that no query covers: registry, steps, paging, retries, batches, errors."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import convert, keys, text
from graphloom.model import errors
from graphloom.model.registry import ClassSchema, Property, Registry, default_registry
from graphloom.operators import batching, build, lookup, validate
from graphloom.plans import dag
from graphloom.sources import paginated, store


def test_registry_P04_P05_X39_X40_X41_V02():
    r = Registry([ClassSchema("A", (), {"x": Property(enum=("1",)), "gone": Property(exclude=True)}, ("x", "gone")), ClassSchema("B", ("A",), {"x": Property(enum=("2",)), "y": Property("number")})])
    m = r.merged(["B"])
    assert m.properties["x"].enum == ("2", "1") and m.required == ("x",) and r.property_names(["B"]) == ["x", "y"]
    assert [s.name for s in r.lineage("B")] == ["B", "A"]
    with pytest.raises(errors.NoSchemaError):
        r.get("C")
    with pytest.raises(errors.SchemaReferenceError):
        Registry([ClassSchema("D", ("Z",))]).lineage("D")
    assert default_registry().struct(["Person"])["firstName"].nullable is False


def test_relationship_class_L11(spark):
    with pytest.raises(errors.InvalidRelationshipClassError):
        build.relationships(spark.range(1), "LIKES", from_key=F.lit("a"), to_key=F.lit("b"), from_type="a", to_type="b", step="s")


def test_relationship_overrides_P07(spark):
    r = build.relationships(spark.range(1), "HAS", from_key=F.lit("a"), to_key=F.lit("b"), from_type="a", to_type="b", step="s", properties={"_key": F.lit("own"), "since": F.lit(1)}).first()
    assert (r["_key"], r["_type"], r["since"]) == ("own", "a_has_b", 1)


def test_relationship_type_forms_agree(spark):
    pairs = [("aws_vpc", "aws_vpc_x"), ("a", "a"), ("a_b", "a_b"), ("a", "b"), ("a_b_c", "a_b"), ("x_y", "x_y_z")]
    got = spark.createDataFrame(pairs, "f string, t string").select("f", "t", keys.relationship_type(F.lit("HAS"), F.col("f"), F.col("t")).alias("r")).collect()
    assert all(x["r"] == keys.relationship_type_of("HAS", x["f"], x["t"]) for x in got)


def test_parse_time_vectors_F06(spark):
    iso = {"2020-10-06T17:41:28Z": 1602006088000, "2020-10-06": 1601942400000, "2020-10-06T17:41:28.999999999Z": 1602006088999, "": None, "garbage": None}
    df = spark.createDataFrame([(k,) for k in iso], "s string").withColumn("ms", convert.parse_time(F.col("s")))
    assert {r["s"]: r["ms"] for r in df.collect()} == iso
    df = spark.createDataFrame([("1601942400.887",), ("x",)], "s string").withColumn("ms", convert.parse_time(F.col("s"), "sec"))
    assert [r["ms"] for r in df.collect()] == [1601942400887, None]


def test_steps_G01_G05_G10_X60():
    s = [dag.StepSpec("b", depends_on=("a",)), dag.StepSpec("a")]
    assert dag.check_steps(s) == ["a", "b"]
    with pytest.raises(errors.GraphError):
        dag.check_steps([dag.StepSpec("a", depends_on=("z",))])
    with pytest.raises(errors.GraphError):
        dag.check_steps([dag.StepSpec("a", depends_on=("b",)), dag.StepSpec("b", depends_on=("a",))])
    with pytest.raises(errors.GraphError):
        dag.StepSpec("a", depends_on=("a",))
    with pytest.raises(errors.UnknownStepError):
        dag.check_start_states(s, {"z": True, "a": True, "b": True})
    with pytest.raises(errors.UnaccountedStepError):
        dag.check_start_states(s, {"a": True})


def test_pipeline_status_G02_Q12_Q17(spark):
    def fail(*_):
        raise errors.ProviderError("no")

    def fatal(*_):
        raise errors.ProviderAuthenticationError("no")

    steps = [dag.StepSpec("a", run=fail), dag.StepSpec("b", depends_on=("a",), run=lambda *_: {}), dag.StepSpec("c"), dag.StepSpec("d", depends_on=("c",))]
    _, status = dag.Pipeline(steps).run(spark, disabled={"c"})
    assert status == {"a": dag.FAILURE, "b": dag.PARTIAL, "c": dag.DISABLED, "d": dag.DISABLED}
    with pytest.raises(errors.ProviderAuthenticationError):
        dag.Pipeline([dag.StepSpec("a", run=fatal)]).run(spark)
    with pytest.raises(errors.GraphError):
        dag.Pipeline([dag.StepSpec("a", graph_id="unlisted")]).run(spark)


def test_requests_S10_S15_X34_X38():
    R = paginated.Response
    pages = {"u1": [R(500), R(200, {"data": {"rows": [{"i": 1}]}, "next": "u2"})], "u2": [R(429), R(200, {"data": {"rows": [{"i": 2}]}, "next": "u3"})], "u3": [R(204)]}
    waits = []
    got = list(paginated.paginate(lambda u: pages[u].pop(0), "u1", "data.rows", lambda r: r.body.get("next"), delay=1, sleep=waits.append))
    assert got == [{"i": 1}, {"i": 2}] and waits == [1, 1]
    with pytest.raises(errors.ProviderAuthorizationError):
        paginated.request(lambda u: R(403), "u")
    with pytest.raises(errors.RetriesExceededError):
        paginated.request(lambda u: R(503), "u", sleep=lambda s: None)
    sizes = []

    def fetch(cursor, size):
        sizes.append(size)
        return R(422) if size > 2 and cursor == "c" else R(200, {"items": [size], "endCursor": "c" if cursor is None else None})

    assert list(paginated.download(fetch, 8)) == [8, 2] and sizes == [8, 8, 4, 2]
    assert paginated.should_throttle(10, 1, 0.8) and not paginated.should_throttle(10, 5, 0.8)


def test_token_bucket_S14():
    now = [0.0]
    b = paginated.TokenBucket(2, 1.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        b.take()
    assert now[0] == pytest.approx(1.0)


def test_packing_A20(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([3, 3, 5, 9, 1])], "g string, o int, s long")
    got = {r["o"]: r["batch"] for r in batching.pack_batches(df, group=["g"], order="o", size="s", limit=8).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 1}


def test_packing_takes_raw_data_from_large_rows_A20(spark):
    e = lambda k, raw: json.dumps({"_key": k, "_rawData": [raw]})
    rows = [("g", 0, 3, 0, e("a", "")), ("g", 1, 90, 86, e("b", "x")), ("g", 2, 90, 80, e("c", "y")), ("g", 3, 8, 2, e("d", "z")), ("g", 4, 9, None, e("e", "")), ("g", 5, None, 1, e("f", ""))]
    df = spark.createDataFrame(rows, "g string, o int, s long, raw long, p string")
    got = {r["o"]: r for r in batching.pack_batches(df, group=["g"], order="o", size="s", limit=8, raw="raw", payload="p").collect()}
    assert {o: (r["s"], r["batch"], r["raw_removed"]) for o, r in got.items()} == {0: (3, 0, False), 1: (4, 0, True), 3: (8, 1, False)}
    assert json.loads(got[1]["p"]) == {"_key": "b"} and json.loads(got[3]["p"])["_rawData"] == ["z"]
    assert sorted(r["o"] for r in batching.skipped_rows(df, size="s", limit=8, raw="raw").collect()) == [2, 4, 5]


def test_shrink_A21():
    e = [{"_key": "a", "_rawData": [{"name": "default", "rawData": {"big": "x" * 100, "small": "y"}}]}]
    out = batching.shrink(e, 120)
    assert out[0]["_rawData"][0]["rawData"] == {"big": "TRUNCATED", "small": "y"} and len(json.dumps(out, separators=(",", ":"))) <= 120
    with pytest.raises(errors.UploadFailedError):
        batching.shrink(e, 10)


def test_raw_data_name_twice_P19(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit("default").alias("name"), F.lit("{}").alias("raw"))).alias("_raw"))
    with pytest.raises(Exception, match="DUPLICATE_RAW_DATA_NAME"):
        build.add_raw_data(df, "default", F.lit("{}")).collect()


def test_resolution_prefers_earlier_sets_J05(spark):
    e = spark.createDataFrame([("e1", "n", "x"), ("e2", "n", "y")], "_key string, name string, code string")
    m = build.mapped_relationships(spark.range(1), "IS", source_key=F.lit("s"), source_type="t", target={"name": F.lit("n"), "code": F.lit("y")}, filter_keys=[["name", "code"], ["name"]])
    assert lookup.resolve_targets(m, e, ["name", "code"]).first()["target_key"] == "e2"
    m = build.mapped_relationships(spark.range(1), "IS", source_key=F.lit("s"), source_type="t", target={"name": F.lit("n")}, filter_keys=[["absent"], ["name"]])
    assert lookup.resolve_targets(m, e, ["name", "code"]).first()["target_key"] == "e1"


def test_validation_V01_V07(spark):
    df = spark.createDataFrame([("k", "h", "h", "beos", "no-ip")], "_key string, name string, displayName string, platform string, ipAddress string").withColumn("_type", F.lit("t")).withColumn("_class", F.array(F.lit("Host")))
    got = {(r["property"], r["validation"]) for r in validate.conformance(df, ["Host"]).collect()}
    assert got == {("platform", "enum"), ("ipAddress", "format")}
    assert validate.only_scalars(spark.range(1).select(F.array(F.lit(1)).alias("list"), F.lit(1).alias("n"))) == ["list"]


def test_store_prunes_and_malformed_raises_S06_S07(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "s"))
    s.write(spark.createDataFrame([("a", "t1", "s1"), ("b", "t2", "s1")], "_key string, _type string, step_id string"))
    assert [r["_key"] for r in s.by_type("t2").collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(_type" in s.by_type("t2")._jdf.queryExecution().toString()
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        store.read_collection(spark, str(tmp_path / "bad.json"), "_key string").collect()


def test_flatten_K12(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit("x").alias("d")).alias("c")).alias("a"), F.array(F.lit(1)).alias("l"))
    assert store.flatten(df).columns == ["a.b", "a.c.d", "l"]


def test_ip_and_tags(spark):
    r = spark.range(1).select(text.split_tags(F.lit("a, b,,c ")).alias("t"), text.is_host(F.lit("1.2.3.4/32")).alias("h"), convert.camel_case(F.lit("Some_snake case")).alias("c"))
    assert tuple(r.first()) == (["a", "b", "c"], True, "someSnakeCase")


def test_error_text_F28():
    e = errors.UploadError("x")
    assert errors.describe(e, "failed")["description"] == "failed (errorCode=UPLOAD_ERROR, reason=x)"
