"""Transcripts: flattening, dedupe, final task, rendering."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import truncate, utf16_length
from .runs import fold


def deduplicated(messages: DataFrame) -> DataFrame:
    """The first message of each id stays; messages without id all stay."""
    first = F.row_number().over(Window.partitionBy("session_id", "id").orderBy("pos"))
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    # the null ids of a session must not meet in one window group
    return messages.where(~named).unionByName(messages.where(named).withColumn("_place", first).where("_place = 1").drop("_place"))


def final_task(messages: DataFrame) -> DataFrame:
    """The last user message that says something."""
    text = F.trim(F.regexp_replace("content", rf"\A{C.JS_SPACE}+|{C.JS_SPACE}+\z", ""))
    rows = messages.where((F.col("role") == "user") & (text != ""))
    return rows.groupBy("session_id").agg(F.max_by(F.struct(text.alias("task"), F.col("pos").alias("pos"), F.col("id").alias("id")), "pos").alias("m")).select("session_id", "m.*")


class WholeRenderer:
    """Streams one transcript and writes all of it; holds its text, which is one row."""

    def __init__(self, session):
        self.session, self.pieces = session, []
        self.chars = 0

    def add(self, row) -> list:
        self.chars += len(row["content"])
        self.pieces.append(f"### {len(self.pieces) + 1}. {row['role'].upper()}\n{row['content']}")
        return []

    def finish(self) -> list:
        text = "\n\n".join(self.pieces)
        return [(self.session, text, len(self.pieces), self.chars, len(text), len(text), False)]


class Renderer:
    """Streams one transcript; holds its head, its tail and counters only."""

    def __init__(self, session, limit: int):
        self.session, self.limit = session, limit
        self.head_size = int(limit * 0.55)
        self.whole, self.tail = "", ""
        self.n = self.size = self.chars = 0

    def add(self, row) -> list:
        self.n += 1
        self.chars += len(row["content"])
        piece = ("\n\n" if self.n > 1 else "") + f"### {self.n}. {row['role'].upper()}\n{row['content']}"
        self.size += len(piece)
        if len(self.whole) <= self.limit:
            self.whole += piece[: self.limit + 1 - len(self.whole)]
        self.tail = (self.tail + piece)[-(self.limit - self.head_size) :]
        return []

    def finish(self) -> list:
        cut = self.size > self.limit
        text = self.whole[: self.head_size] + C.TRUNCATED + self.tail if cut else self.whole
        return [(self.session, text, self.n, self.chars, self.size, len(text), cut)]


RENDERED = "session_id long, text string, n_messages long, content_chars long, source_chars long, analysed_chars long, truncated boolean"


def rendered(messages: DataFrame, limit: int | None = C.DIALOG_CHARS) -> DataFrame:
    """Numbered transcript of each session, cut in the middle beyond ``limit``; whole if that is None."""
    rows = messages.select("session_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    return fold(rows, "session_id", ["pos"], lambda s: WholeRenderer(s) if limit is None else Renderer(s, limit), RENDERED)


def last_assistant(messages: DataFrame) -> DataFrame:
    rows = messages.where("role = 'assistant'")
    return rows.groupBy("session_id").agg(F.max_by(F.struct("pos", F.length("content").alias("n_chars")), "pos").alias("m")).select("session_id", "m.*")


MESSAGE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "role", "content")]))


def content_text(content) -> str:
    """Text of a content value: a string, blocks of text, tool calls and images, or a scalar."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        out = []
        for block in content:
            if isinstance(block, str):
                out.append(block)
            elif isinstance(block, dict) and isinstance(block.get("text"), str):
                out.append(block["text"])
            elif isinstance(block, dict) and block.get("type") == "toolCall":
                out.append(f"[tool call: {block.get('name', 'unknown')} {json.dumps(block.get('arguments', {}), separators=(',', ':'))}]")
            elif isinstance(block, dict) and block.get("type") == "image":
                out.append("[image]")
        return "\n".join(x for x in out if x)
    return "" if content is None or isinstance(content, dict) else json.dumps(content) if isinstance(content, bool) else str(content)


def message_of(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    role = {"toolResult": "tool"}.get(value.get("role"), value.get("role"))
    text = content_text(value.get("content")).strip()
    if role not in ("system", "user", "assistant", "tool") or not text:
        return None
    return {"id": value["id"] if isinstance(value.get("id"), str) else None, "role": role, "content": text}


def flatten(value) -> list[dict]:
    """Messages of a nested export, in order; an explicit stack, so any depth will do."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
            continue
        if not isinstance(v, dict):
            continue
        own = v["id"] if isinstance(v.get("id"), str) else None
        kind, summary = v.get("type"), v.get("summary")
        if kind in ("compaction", "branch_summary") and isinstance(summary, str) and summary.strip():
            label = {"compaction": "[compaction summary]", "branch_summary": "[branch summary]"}[kind]
            out.append({"id": own, "role": "system", "content": f"{label}\n{summary.strip()}"})
        elif kind in ("message_end", "message") and v.get("message"):
            if m := message_of(v["message"]):
                out.append(m | {"id": m["id"] or own})
        elif isinstance(v.get("messages"), list):
            stack.append(v["messages"])
        elif isinstance(v.get("dialogue"), list):
            stack.append(v["dialogue"])
        elif isinstance(v.get("message"), dict):
            if m := message_of(v["message"]):
                out.append(m | {"id": m["id"] or own})
        elif m := message_of(v):
            out.append(m)
    return out


def read_dialogue(text: str) -> list[dict]:
    """JSON, else JSON lines, else the whole text as one user message."""
    text = text.removeprefix("﻿").strip()
    if not text:
        raise ValueError("the dialogue is empty")
    if text[0] in "[{":
        try:
            if found := flatten(json.loads(text)):
                return found
        except ValueError:
            pass
    try:
        if found := flatten([json.loads(line) for line in text.split("\n") if line]):
            return found
    except ValueError:
        pass
    return [{"id": None, "role": "user", "content": text}]


def flattened(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Every message of every raw export, with its place."""
    @F.pandas_udf(MESSAGE)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None or not x.strip() else read_dialogue(x))

    rest = [c for c in raw.columns if c != column]
    return raw.select(*rest, F.posexplode(parse(column)).alias("pos", "m")).select(*rest, "pos", "m.*")


def first_json_object(text: str) -> str | None:
    """The first JSON object in a text: whole, fenced, or a balanced part; canonical form."""
    text = text.removeprefix("﻿").strip()
    candidates = [text, *(m[1] for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.S | re.I))]
    decoder = json.JSONDecoder()
    for c in candidates:
        try:
            if isinstance(found := json.loads(c), dict):
                return json.dumps(found, sort_keys=True, separators=(",", ":"))
        except ValueError:
            pass
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return json.dumps(found, sort_keys=True, separators=(",", ":"))
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_objects(rows: DataFrame, column: str) -> Column:
    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else first_json_object(x))

    return extract(column)
