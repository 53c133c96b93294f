"""Chat formatting with typed content parts.

A visitor walks over the parts of a turn and flattens them in order: text is escaped, an image, audio or
document part becomes a placeholder that stands for a number of tokens, and its reference is recorded. Turns
are formatted row by row; nothing is gathered per conversation until the streaming reader, which goes through
each conversation in order and keeps only digests.

The template. A turn is an opening mark, the escaped text between newlines, and a closing mark; a role
without marks of its own is written down (escaped) after [ROLE]. A conversation begins with <s>. In texts and
roles, a control string, with the backslashes before it, gets one more backslash before it; marks of the
template always follow a newline or another mark, so they are told from texts, and taking one backslash away
gives the text back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, through

#: Fixed control strings of the template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[BODY]", "[/ROLE]", "<image>", "<audio>", "<document>"]
#: Fixed marks by role: before and after the text.
MARKS = {"user": ("[INST]\n", "\n[/INST]\n"), "assistant": ("[OUT]\n", "\n</s>\n"), "system": ("[SYS]\n", "\n[/SYS]\n")}
#: Tokens of a placeholder: image patches of 28 x 28 pixels, 25 frames a second of audio, 256 a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_NAMES = "|".join(map(re.escape, CONTROL))
_RAW = re.compile(rf"\\*(?:{_NAMES})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_NAMES}))")
_WORDS = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _RAW.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visitor of content parts: text so far, attachments (type, ref, tokens) in order, and expanded tokens."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.pieces.append(escape(text))
        self.tokens += sum(1 for _ in _WORDS.finditer(text))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"\n<{kind}>\n")
        self.attachments.append({"type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, max(1, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 0) * PAGE_TOKENS))


def format_turn(role: str, parts: list[dict]) -> tuple[str, list[dict], int]:
    """The turn in the template, its attachments, its expanded tokens."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    before, after = MARKS.get(role) or (f"[ROLE]\n{escape(role)}\n[BODY]\n", "\n[/ROLE]\n")
    return before + "".join(visitor.pieces) + after, visitor.attachments, visitor.tokens


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text (with placeholders, if any) of a formatted turn."""
    for role, (before, after) in MARKS.items():
        if formatted.startswith(before) and formatted.endswith(after):
            return role, unescape(formatted[len(before) : -len(after)])
    role, _, body = formatted.removeprefix("[ROLE]\n").removesuffix("\n[/ROLE]\n").partition("\n[BODY]\n")
    return unescape(role), unescape(body)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("attachments", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))), ("n_tokens", pa.int64()), ("loss", pa.bool_())])
    for batch in small(batches):
        rows = []
        for row in batch.to_pylist():
            role = row["role"] or ""
            formatted, attachments, tokens = format_turn(role, row["parts"] or [])
            rows.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": role, "formatted": formatted, "attachments": attachments, "n_tokens": tokens, "loss": role == "assistant"})
        yield pa.RecordBatch.from_pylist(rows, schema=out)


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted, attachments, n_tokens, loss (whether the text is trained on).

    Takes (conv_id, turn, role, text), or ``parts_col`` with typed parts (see PARTS) in place of text. A null
    role or text is empty; null ids and turns stay; a part of unknown type counts as text; no parts give an
    empty turn. Other columns are left out. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if parts_col is None else None
    null = lambda kind: F.lit(None).cast(kind)
    one = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))) if parts_col is None else F.col(parts_col)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), one.cast(PARTS).alias("parts"))
    return through(rows, _format, "conv_id long, turn long, role string, formatted string, attachments array<struct<type:string,ref:string,tokens:int>>, n_tokens long, loss boolean")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state = None

    def done(s):
        return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

    for batch in small(batches):
        rows = []
        for conv, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(done(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len("<s>\n")]
            role, text = read_turn(formatted)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if formatted.startswith("[OUT]\n"):
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        yield pa.RecordBatch.from_pylist(rows, schema=out)
    if state is not None:
        yield pa.RecordBatch.from_pylist([done(state)], schema=out)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted turns in order of turn (nulls first; ties by text).

    A digest of a whole conversation is sequential, so its turns pass through one task, sorted and one at a
    time: memory does not grow with the conversation. A null conv_id is a conversation of its own.
    """
    rows = formatted.select("conv_id", "turn", "formatted")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return through(ordered, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed rows of the registered query, beside the table.
EXTRA = "select -1L as conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(table.unionByName(spark.sql(EXTRA))))


OP9_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(text) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[OUT\]|\[ROLE\]|\[BODY\]|\[/ROLE\]|<image>|<audio>|<document>'))
    + case role when 'user' then 16 when 'assistant' then 12 when 'system' then 14 else 24 + length(role) + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[OUT\]|\[ROLE\]|\[BODY\]|\[/ROLE\]|<image>|<audio>|<document>')) end as chars from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, text), '')) as loss_sha256,
  cast(sum(chars) + 4 as bigint) as formatted_chars
from sized group by conv_id
"""
