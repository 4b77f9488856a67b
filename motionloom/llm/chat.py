"""Operator 4: chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor with
one method for each type flattens them into one string, in order: texts are
escaped, and an attachment becomes a placeholder, its reference is recorded
and its expanded token count is added. Turns are marked as

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Escaping: wherever a text has ``<``, any number of backslashes, then ``|``,
one more backslash goes after the ``<``. An escaped text has no ``<|`` and so
no control string; taking one backslash away there gives the text back.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
START, END = "<|im_start|>", "<|im_end|>"
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def _role_out(role: str) -> str:
    """A role stands on one line: a line break in it is written as %0A, and % as %25."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattener:
    """The visitor. Token costs: an image by tiles, audio by time, a document by pages."""

    image_tile: int = 336
    image_tile_tokens: int = 144
    audio_tokens_second: float = 25.0
    document_page_tokens: int = 768
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part["type"], self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def _attach(self, part: dict, tokens: int, name: str | None = None) -> str:
        n = len(self.attachments)
        self.attachments.append({"number": n, "type": part["type"], "uri": part["uri"], "tokens": tokens})
        return f"<|{name or part['type']}:{n}|>"

    def visit_other(self, part: dict) -> str:
        """A part of a type that isn't known: its type and reference are kept, at no tokens."""
        return self._attach(part, 0, "other")

    def visit_image(self, part: dict) -> str:
        tiles = math.ceil((part["width"] or 1) / self.image_tile) * math.ceil((part["height"] or 1) / self.image_tile)
        return self._attach(part, tiles * self.image_tile_tokens)

    def visit_audio(self, part: dict) -> str:
        return self._attach(part, math.ceil((part["seconds"] or 0.0) * self.audio_tokens_second))

    def visit_document(self, part: dict) -> str:
        return self._attach(part, (part["pages"] or 1) * self.document_page_tokens)


def _joined(parts: list[dict]) -> list[dict]:
    """Neighbouring texts as one, so that no control string can form across their border."""
    out: list[dict] = []
    for part in filter(None, parts):
        kind = part["type"] or "text"
        if kind == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": out[-1]["text"] + (part["text"] or "")}
        else:
            out.append({**part, "type": kind, "text": part.get("text") or ""})
    return out


def format_turns(turns: list[dict]) -> dict:
    """One conversation's turns (role, parts), in order, as a formatted string with its loss spans and attachments."""
    visitor, out, spans, at = Flattener(), [], [], 0
    for turn in turns:
        role = _role_out(turn["role"] or "")
        head = f"{START}{role}\n"
        body = "".join(map(visitor.visit, _joined(turn["parts"] or [])))
        if turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": visitor.attachments}


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, escaped content) of each turn. Control strings are never within a content."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        role = formatted[at + len(START) : line]
        turns.append((_role_in(role), formatted[line + 1 : end]))
        at = end + len(END) + 1
    return turns


def content_parts(content: str, attachments: list[dict]) -> list[dict]:
    """A turn's parts again: texts unescaped, placeholders as their attachments."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(content):
        if m.start() > at:
            parts.append({"type": "text", "text": unescape(content[at : m.start()])})
        parts.append({k: attachments[int(m[2])][k] for k in ("type", "uri")})
        at = m.end()
    if at < len(content):
        parts.append({"type": "text", "text": unescape(content[at:])})
    return parts


_FORMATTED = "formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<number:int,type:string,uri:string,tokens:long>>"


def text_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their text as the only part, in column ``parts``."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), null.cast("string").alias("uri"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"))
    return df.withColumn("parts", F.array(part))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Columns: the conversation column, formatted, loss_spans, attachments, expanded_tokens.

    ``parts``: array of PART. The turns go by turn number (nulls first); equal
    turns by role, then by their parts. Defined results: null texts and roles
    count as empty; a null list of parts gives an empty content; null parts
    are left out; a part of an unknown type is an attachment of no tokens with
    the placeholder ``<|other:N|>``; repeated rows are turns of their own; a
    row without a conversation id is a conversation of its own; an empty table
    gives no rows. A conversation is one output value, so its rows
    have to meet; what meets is bounded by a conversation, not by the table.
    """
    kind = messages.schema[conv_col].dataType.simpleString()
    rows = messages.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(parts_col).cast(f"array<{PART}>").alias("parts")).alias("t"))
    turns = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.unionByName(rows.filter("conv IS NULL").select("conv", F.array("t").alias("turns")))

    def batches(it):
        import pyarrow as pa

        kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))]
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                made = [format_turns(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[k] for m in made], t) for k, t in zip(("formatted", "loss_spans", "attachments"), kinds, strict=True))], names=["conv", "formatted", "loss_spans", "attachments"])

    out = turns.mapInArrow(batches, f"conv {kind}, {_FORMATTED}")
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return out.withColumn("expanded_tokens", tokens).withColumnRenamed("conv", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Columns: the conversation column, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the formatted strings."""
    kind = formatted.schema[conv_col].dataType.simpleString()
    rows = formatted.select(F.col(conv_col).alias("conv"), "formatted", "loss_spans")

    def batches(it):
        import hashlib

        import pyarrow as pa

        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                cols = ([], [], [], [], [])
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    turns = parse(text)
                    whole = "".join(f"{role}\n{unescape(content)}\n" for role, content in turns)
                    loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                    row = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.mapInArrow(batches, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
