r"""Operator 9 [native]: chat formatting by event-sourced reconstruction.

Logs of chat events are partitioned by conversation, sorted by sequence and folded into final messages:

* ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` replaces its text
  by a new, possibly streamed answer (further deltas append to it).

Messages are then rendered with a template that marks turns, and parsed back from the rendered text alone. Control
strings inside texts are escaped by one backslash after their first character (one more, where backslashes stand
there already), which is undone exactly. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks of the template.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates that must not appear unescaped inside a text.
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_REST = "|".join(r"\Q" + c[1:] + r"\E" for c in sorted(CONTROL, key=len, reverse=True))
_RAW = rf"([<\[])(\\*)({_REST})"
_ESCAPED = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as ``message`` events. Every row is a turn of its own, also a repeated one.

    Rows of one turn number are taken by role, then text. Null text and null role count as empty.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return c.withColumn("seq", F.row_number().over(order).cast("long")).select("conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("message_id"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event log (conv_id, seq, kind, message_id, role, text).

    A message stands where its first event stands and has that event's role. Its text is that of its last
    ``message``, ``edit`` or ``regenerate`` event and of the deltas after it, in order of ``seq``; deltas without such
    an event count from the start. Events with unknown kinds are ignored, null texts are empty, ties of ``seq`` go by kind
    and text, and a log without events gives no rows. Rows of one message meet in one row, as its text must.
    """
    e = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    one = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    m = e.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(one)).alias("log"))
    m = m.withColumn("base", F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(0)))))
    live = F.slice("log", F.col("base") + 1, F.size("log"))
    return m.select("conv_id", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_messages, formatted, and loss: spans (start from 1, length in code points).

    The spans cover the escaped texts of the trained role. Spans come from a running length over the ordered
    messages of a conversation, not from a quadratic fold.
    """
    m = messages.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("_body", escape(F.col("text")))
    m = m.withColumn("_turn", F.concat("_head", "_body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("seq")
    before = F.coalesce(F.sum(F.length("_turn")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("_start", (before + F.length("_head") + 1).cast("long"))
    span = F.struct(F.col("_start").alias("start"), F.length("_body").cast("long").alias("length"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "_turn", F.when(F.col("role") == trained_role, span).alias("span")))).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return g.select("conv_id", F.size("t").cast("long").alias("n_messages"), F.array_join(F.transform("t", lambda x: x["_turn"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """Turns read back from rendered text: array of (role, text)."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(x):
        halves = F.split(F.substr(x, F.lit(len(TURN) + 1)), r"\Q" + BODY + r"\E", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, one)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, all read back from ``formatted`` and ``loss``."""
    d = formatted.withColumn("_turns", parse(F.col("formatted")))
    d = d.withColumn("_all", F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    d = d.withColumn("_loss", F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["length"].cast("int")))), ""))
    return d.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2("_all", 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -1, rendered and read back."""
    text = "</s>[INST] ok [/INST]"
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digest(render(fold_events(rows_as_events(c.unionByName(probe)))))


def _sql_escape(x: str) -> str:
    import re

    rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
    return rf"regexp_replace({x}, '([<\[])(\\*)({rest})', '\1\2\\\3', 'g')"


OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length('{TURN}{BODY}{END}') + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
