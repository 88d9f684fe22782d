"""Question packs: managed questions with queries and tags, loaded from documents and checked."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..model.errors import InvalidFileError
from .files import write_json

SCHEMA = "ordinal long, id string, title string, description string, queries array<struct<name string, query string, version string>>, tags array<string>"


#: Questions in a document that :func:`write` makes, about; a document is one task's work.
DOCUMENT = 10_000


def _documents(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    except Exception as e:
        raise InvalidFileError(f"question file not found: {path}") from e


def parse(text: str) -> list[dict]:
    """The questions of a document in JSON, or in YAML where a reader is installed. What lacks an id, title, description, queries or tags raises."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise InvalidFileError("no reader of YAML is installed") from e
        data = yaml.safe_load(text)
    questions = data.get("questions") if isinstance(data, dict) else None
    if not isinstance(questions, list):
        raise InvalidFileError("a question file has a list of questions")
    for q in questions:
        strings = all(isinstance(q.get(k), str) for k in ("id", "title", "description"))
        if not strings or not isinstance(q.get("queries"), list) or not isinstance(q.get("tags"), list) or not all(isinstance(x.get("query"), str) for x in q["queries"]):
            raise InvalidFileError(f"not a question: {q.get('id')}")
    return questions


def load(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file, in its order, or of a folder of such files, in the order of their names.

    Tasks read the documents, once here for what makes one invalid, which raises, and again with the frame: the driver holds their names alone.
    """
    documents, schema = _documents(spark, path), to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)
    found = documents.mapInArrow(lambda batches: (_checked(file, text, schema) for file, text in _texts(batches)), "file string, error string").collect()
    if len(found) < max(1, len(documents.inputFiles())):
        raise InvalidFileError(f"no questions in a file of {path}")
    for r in found:
        if r["error"] is not None:
            raise InvalidFileError(f"{r['file']}: {r['error']}")
    place = {file: i << 32 for i, file in enumerate(sorted(r["file"] for r in found))}

    def rows(batches):
        for file, text in _texts(batches):
            yield from _table(text, schema, place[file]).to_batches(max_chunksize=DOCUMENT)

    return documents.mapInArrow(rows, SCHEMA)


def _texts(batches):
    for b in batches:
        for file, text in zip(b.column(0), b.column(1), strict=True):
            yield file.as_py(), text.as_py()


def _table(text: str, schema: pa.Schema, place: int) -> pa.Table:
    """Questions of a document, numbered from ``place``."""
    rows = [{"ordinal": i, "id": q["id"], "title": q["title"], "description": q["description"], "queries": [{"name": x.get("name"), "query": x["query"], "version": x.get("version")} for x in q["queries"]], "tags": q["tags"]} for i, q in enumerate(parse(text), place)]
    return pa.Table.from_pylist(rows, schema)


def _checked(file: str, text: str, schema: pa.Schema) -> pa.RecordBatch:
    try:
        _table(text, schema, 0)
        error = None
    except Exception as e:  # of any reader; load raises it
        error = f"{e}" or type(e).__name__
    return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), "error": pa.array([error], pa.string())})


def write(questions: DataFrame, path: str) -> None:
    """Questions in the order of their ordinals, as a folder of documents that :func:`load` reads; each is written by one task, row by row."""
    n = -(-questions.count() // DOCUMENT)
    if not n:
        return write_json(questions.sparkSession, f"{path}/part-0.json", {"questions": []})

    def lines(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array(['{"questions": ['], pa.string())})
        comma = ""
        for b in batches:
            out = []
            for q in b.column(0).to_pylist():
                out.append(comma + q)
                comma = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]}"], pa.string())})

    parts = questions.repartitionByRange(n, "ordinal").sortWithinPartitions("ordinal").select(F.to_json(F.struct("id", "title", "description", "queries", "tags")).alias("value"))
    parts.mapInArrow(lines, "value string").write.text(path)


def problems(questions: DataFrame) -> DataFrame:
    """(check, id, value) of whatever repeats: ids and titles over all questions, tags and names of queries inside one; each later one is reported.

    Later than the first: a join to the first places of what repeats, since a window would sort all questions of one title in one task.
    """
    value = lambda check, v: F.struct(F.lit(check).alias("check"), v.alias("value"))
    shared = questions.select("id", "ordinal", F.explode(F.array(value("id", F.col("id")), value("title", F.col("title")))).alias("v"))
    shared = shared.select("v.check", "id", "v.value", "ordinal")
    first = shared.groupBy(F.col("check").alias("_check"), F.col("value").alias("_value")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    shared = shared.join(first, (F.col("check") == F.col("_check")) & F.col("value").eqNullSafe(F.col("_value")) & (F.col("ordinal") > F.col("_first")))
    inside = []
    for check, values in (("tag", F.col("tags")), ("query_name", F.filter(F.transform("queries", lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != ""))):
        # the places of a value at which it has stood before
        again = F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), (F.array_position(values, x) - 1 < i).alias("again"))), lambda s: s["again"])
        inside.append(F.coalesce(F.transform(again, lambda s: value(check, s["x"])), F.array()))  # noqa: B023
    found = questions.select("id", F.explode(F.concat(*inside)).alias("v")).select("v.check", "id", "v.value")
    return shared.select("check", "id", "value").unionByName(found)


def validate(questions: DataFrame) -> DataFrame:
    """The questions, if nothing repeats; else raises the first problem. Runs the check."""
    if found := problems(questions).orderBy("check", "id", "value").first():
        raise InvalidFileError(f"{found['check']} is not unique: {found['value']} (question {found['id']})")
    return questions


def queries(questions: DataFrame) -> DataFrame:
    """(id, ordinal, name, query) of all queries, as they go to a validation service."""
    return questions.select("id", F.posexplode("queries").alias("ordinal", "q")).select("id", "ordinal", "q.name", "q.query")
