"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document). A visitor
flattens it into one string in which every attachment is an ordered
placeholder, and records each attachment's reference and the number of tokens
that it expands to. The template marks turns; control strings inside texts are
escaped reversibly, so that the formatted stream can be parsed back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.llm.common import bound_batches

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])
ATTACHMENT = "array<struct<index:int,kind:string,ref:string,tokens:bigint>>"
#: Audio counts no more tokens than this, so that sums of any seconds stay in 64 bits.
_MOST_TOKENS = 1 << 40
OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL = re.compile(r"\\|<(?=/?turn>|\|)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEADER = re.compile(r"<turn>((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    """Make control strings harmless: a backslash is doubled, and one follows the `<` that begins a control string.

    >>> unescape(escape("</turn> <|image:0|> \\\\")) == "</turn> <|image:0|> \\\\"
    True
    """
    return _CONTROL.sub(lambda m: m[0] * 2 if m[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    """Undo escape()."""
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one message; one method for each type of part.

    `index` counts attachments. Unknown types and null fields become empty
    text, so no part is an error. Token counts: images by 14-pixel patches,
    audio by 25 frames a second (of no length where it is not finite),
    documents by 256 tokens a page; 1 at least.
    """

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / 14) * math.ceil((part.get("height") or 0) / 14))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        self._attach("audio", part, math.ceil(min(seconds * 25, _MOST_TOKENS)) if math.isfinite(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, 256 * (part.get("pages") or 0))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        index = len(self.attachments)
        self.out.append(f"<|{kind}:{index}|>")
        self.attachments.append({"index": index, "kind": kind, "ref": part.get("ref"), "tokens": max(1, tokens)})


_ATTACHMENTS = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", _ATTACHMENTS), ("attachment_tokens", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format each row (conv_id, turn, role, parts) of a conversation table.

    Result: conv_id, turn, role, formatted, loss_start, loss_end (code points
    inside `formatted`; equal where nothing is trained on), attachments,
    attachment_tokens. Joining `formatted` by conv_id, turn gives the whole
    conversation (see assemble). Null role or parts count as empty; other
    columns are left out; an empty table gives an empty result.
    """
    bound_batches(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "parts")), strict=True):
                visitor = PartVisitor()
                for part in parts or ():
                    if part is not None:
                        visitor.visit(part)
                body = "".join(visitor.out)
                head = f"{OPEN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
                end = len(head) + (len(body) if role in loss_roles else 0)
                rows.append((conv, turn, role, head + body + CLOSE, len(head), end, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            yield _batch(rows, _FORMATTED)

    return turns.mapInArrow(run, f"conv_id bigint, turn bigint, role string, formatted string, loss_start int, loss_end int, attachments {ATTACHMENT}, attachment_tokens bigint")


def assemble(formatted: DataFrame) -> DataFrame:
    """One string for each conversation, its rows joined by turn; for conversations that fit one row."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted")))
    return formatted.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.array_join(F.col("rows.formatted"), "").alias("formatted"))


class TurnParser:
    """Reads turns back from a formatted stream that arrives in pieces of any length."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The (role, body) of each turn that the stream has completed; the body is still escaped."""
        self.held += piece
        at = 0
        while (end := self.held.find(CLOSE, at)) >= 0:
            head = _HEADER.match(self.held, at)
            if head is None:
                raise ValueError("not a formatted conversation")
            yield unescape(head[1]), self.held[head.end() : end]
            at = end + len(CLOSE)
        self.held = self.held[at:]


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest each conversation from its formatted rows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachment_tokens.

    Rows are sorted by conversation and turn (ties by role, then text) and
    then read as a stream: a task holds one turn and the running digests,
    never a whole conversation, however long it is. Rows of a null conv_id
    are one conversation.
    """
    columns = ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachment_tokens"]
    dealt = formatted.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def result() -> tuple:
            conv, n, turns, chars, loss, total, tokens, parser = now
            if parser.held:
                raise ValueError("the last turn of a formatted conversation is cut off")
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, tokens

        for batch in batches:
            done = []
            for conv, text, start, end, tokens in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachment_tokens")), strict=True):
                if not now or now[0] != conv:
                    if now:
                        done.append(result())
                    now[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, TurnParser()]
                trained = unescape(text[start:end])
                now[3] += len(trained)
                now[4].update(trained.encode())
                now[5] += len(text)
                now[6] += tokens
                for role, body in now[7].feed(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{unescape(body)}\n".encode())
            yield _batch(done, _DIGESTS)
        if now:
            yield _batch([result()], _DIGESTS)

    return dealt.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachment_tokens bigint")


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as typed parts: one text part each; null text is empty."""
    text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]))
    return conversations.select("conv_id", "turn", "role", F.array(text).alias("parts"))


#: The conversation -7 that the query adds: texts that look like control strings.
PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_turns(text_parts(rows.unionByName(probe))))


#: Escaped length: backslashes and the `<` of control strings count twice; a newline in a role too.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<(/?turn>|\|)', '<\\\1', 'g')) AS body,
    length(regexp_replace(regexp_replace(role, '[\\\n]', '\\\0', 'g'), '<(/?turn>|\|)', '<\\\1', 'g')) AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(15 + head + body)::BIGINT AS formatted_chars, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
