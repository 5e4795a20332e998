"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are
its context and only that reply is trainable. A turn is written as

    <s>[INST] role [/INST]
    text</s>

and control strings inside roles and texts are escaped with character
references, so that the written form can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import read

#: Fixed values of the template: what a control string becomes inside a text.
ESCAPES = {"&": "&amp;", "<s>": "&lt;s>", "</s>": "&lt;/s>", "[INST]": "&#91;INST]", "[/INST]": "&#91;/INST]"}
_CONTROL = re.compile("|".join(re.escape(k) for k in ESCAPES))
_REFERENCE = re.compile("&(amp|lt|#91);")
_PLAIN = {"amp": "&", "lt": "<", "#91": "["}
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>", re.DOTALL)

EXAMPLES = "conv_id long, lone long, example int, n_turns int, target int, text string, loss_start long, loss_end long, last boolean"
SPANS = "conv_id long, lone long, example int, loss string, chars long, n_turns long, turns_sha256 string"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return _REFERENCE.sub(lambda m: _PLAIN[m[1]], text)


def written(role: str, text: str) -> tuple[str, str]:
    """What stands before a turn's text, and the text with its end mark."""
    return f"<s>[INST] {escaped(role)} [/INST]\n", f"{escaped(text)}</s>"


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    return [(unescaped(role), unescaped(said)) for role, said in _TURN.findall(text)]


def expanded(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(target turn, formatted text, start and end of the trainable span) of each example.

    Turns after the last assistant turn would otherwise be lost, so they close
    with an example that has no target (-1) and an empty span.
    """
    so_far, length = [], 0
    for i, (role, text) in enumerate(turns):
        head, tail = written(role, text)
        so_far += [head, tail]
        length += len(head) + len(tail)
        if role == "assistant":
            yield i, "".join(so_far), length - len(tail), length - len("</s>")
    if turns and turns[-1][0] != "assistant":
        yield -1, "".join(so_far), length, length


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, lone, turns): the turns of each conversation in order.

    Order is turn, then role, then text, nulls first; a null role or text
    counts as empty. A turn with a null conv_id is a conversation of its own,
    which `lone` numbers. A conversation is the unit of the result, so its turns
    meet in one row; different conversations never do.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("said"))
    keyed = keyed.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    return (
        keyed.groupBy("conv_id", "lone")
        .agg(F.sort_array(F.collect_list("said")).alias("turns"))
        .select("conv_id", "lone", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def prefix_target_examples(rows: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, lone, example, n_turns, target, text, loss_start, loss_end, last.

    The span counts code points of `text` and holds only the escaped reply.
    `last` marks the longest example, which holds all turns: a conversation
    whose last turn is not an assistant's closes with one more example without a
    target. Repeated rows are turns of their own; an empty table gives no rows;
    other columns of the table are not read. Examples leave a task as they are
    made, so a long conversation takes no more memory than its longest one.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(9)]
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                conv, lone, turns = (batch.column(c)[i].as_py() for c in range(3))
                said = [(t["role"], t["text"]) for t in turns]
                for k, (target, text, start, end) in enumerate(expanded(said)):
                    n = target + 1 if target >= 0 else len(said)
                    for column, value in zip(out, (conv, lone, k, n, target, text, start, end, n == len(said))):
                        column.append(value)
                    held += len(text)
                    if held > 4_000_000:
                        yield _batch(out)
                        out, held = [[] for _ in range(9)], 0
        yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], [c.split()[0] for c in EXAMPLES.split(", ")])

    return conversations_of(rows).mapInArrow(expand, EXAMPLES)


def example_digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples say when read back, one row per conversation.

    Turns come from the longest example; the loss text joins the unescaped
    trainable spans in order; formatted_chars adds up all examples. Each example
    is read where it is made: only its span and digest travel, so a conversation
    costs as much as its replies, not as all its prefixes.
    """

    def read_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends, last = (batch.column(c).to_pylist() for c in (5, 6, 7, 8))
            turns = [read_back(t) if whole else None for t, whole in zip(texts, last)]
            told = [t if t is None else _sha("".join(f"{role}\n{text}\n" for role, text in t)) for t in turns]
            columns = [
                *(batch.column(c) for c in range(3)),
                pa.array([unescaped(t[a:b]) for t, a, b in zip(texts, starts, ends)], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t if t is None else len(t) for t in turns], pa.int64()),
                pa.array(told, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SPANS.split(", ")])

    spans = examples.mapInArrow(read_spans, SPANS)
    told = spans.groupBy("conv_id", "lone").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("spans"),
    )
    loss = F.array_join(F.col("spans.loss"), "")
    return told.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of conversation -7, which is full of control strings."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"
    )
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return example_digests(prefix_target_examples(rows))


def _sql_escaped(c: str) -> str:
    for k, v in ESCAPES.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length('<s>[INST] ') + length({_sql_escaped('role')}) + length(' [/INST]') + 1 + length({_sql_escaped('text')}) + length('</s>') AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS m
  FROM c
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS so_far, role = 'assistant' OR k = m AS ends FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (ends) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (ends) AS BIGINT) AS n_examples
FROM u GROUP BY conv_id
"""
