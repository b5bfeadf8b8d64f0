"""Chat formatting of typed content parts.

A turn is a role and a list of parts (type, text, ref, amount).  A visitor flattens the parts in order: text is escaped and
kept, image, audio and document parts become numbered placeholders; each is recorded as an attachment with the
number of tokens it expands to.  Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A control string
inside a text gets one backslash after its first character (one more if it has some already), which ``unescape`` takes away again, so
parsing gives back every role and text.  The loss mask is the list of code point spans of the assistants' texts.

Defined results: a null text or part list counts as empty, a null role as the empty role; turns go by (turn, role, text), roles and texts as they are written
(with their escapes), a null turn first, repeated rows are kept; rows with a null conversation id form one conversation; an empty input gives an empty output; extra columns are ignored.
A conversation becomes one row, so one row is as large as one conversation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import frugal

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_INNER = r"\|im_start\|>|\|im_end\|>|\|(?:image|audio|document|attachment)_\d+\|>|/?s>|</?SYS>>|/SYS>>|<SYS>>"
_CONTROL = re.compile(r"<(\\*)(" + _INNER + r")|\[(\\*)(/?INST\])")
_ESCAPED = re.compile(r"<\\(\\*)(" + _INNER + r")|\[\\(\\*)(/?INST\])")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PARTS = "array<struct<type:string,text:string,ref:string,amount:double>>"
#: Tokens an attachment expands to for each unit of its amount: image patches of 28 x 28 pixels (amount: pixels), audio frames (seconds), document pages.
TOKENS_PER = {"image": 1 / 784, "audio": 25.0, "document": 512.0}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<\\{m[1]}{m[2]}" if m[2] else f"[\\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of one turn; numbers attachments from 1 within the turn."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.text: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def result(self) -> str:
        """What has been flattened so far; text parts that follow each other are escaped as one."""
        self.out.append(escape("".join(self.text)))
        self.text = []
        return "".join(self.out)

    def _attach(self, kind: str, part: dict) -> None:
        tokens = max(1, ceil((part.get("amount") or 0.0) * TOKENS_PER.get(kind, 0.0)))
        self.attachments.append({"index": len(self.attachments) + 1, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.result()
        self.out.append(f"<|{kind}_{len(self.attachments)}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        self._attach("attachment", part)


def flatten(parts: list[dict] | None) -> tuple[str, list[dict]]:
    """Escaped text with placeholders, and the attachments."""
    visitor = Flattener()
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    return visitor.result(), visitor.attachments


def text_part(text: Column) -> Column:
    """A part list of one text part."""
    empty = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), empty.cast("string").alias("ref"), empty.cast("double").alias("amount")))


def format_chats(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row a conversation: (conv_id, formatted, loss_spans, attachments, attachment_tokens)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.cast(PARTS).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                done = [flatten(p) for p in part.column(3).to_pylist()]
                roles = [escape_role(r) for r in part.column(2).to_pylist()]
                loss = [r == "assistant" for r in part.column(2).to_pylist()]
                kind = pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(roles), pa.array([d[0] for d in done], pa.string()), pa.array(loss, pa.bool_()), pa.array([d[1] for d in done], kind)], names=["conv_id", "turn", "role", "body", "loss", "attachments"])

    id_type = rows.schema["conv_id"].dataType.simpleString()
    flat = rows.mapInArrow(frugal(run), f"conv_id {id_type}, turn long, role string, body string, loss boolean, attachments array<struct<index:bigint,kind:string,ref:string,tokens:bigint>>")
    turn_key = F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63)).cast("bigint")).alias("turn"), F.col("role"), F.col("body"), F.col("loss"), F.col("attachments"))
    whole = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn_key)).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["body"], F.lit(CLOSE)))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = start + F.length(t["body"])
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["loss"], F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"]).alias("out"))

    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("position"), a["index"].alias("index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id", F.array_join(marked, "").alias("formatted"), F.aggregate("turns", state, step, lambda acc: acc["out"]).alias("loss_spans"), attached.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; placeholders stay in the text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def under_mask(formatted: str, spans: list) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans or [])


def parts_from_json(text: str | None) -> list[dict]:
    """A part list from a JSON array of parts; anything else is one text part."""
    try:
        found = json.loads(text or "")
    except ValueError:
        found = None
    if isinstance(found, list) and all(isinstance(p, dict) for p in found):
        return [{"type": p.get("type"), "text": p.get("text"), "ref": p.get("ref"), "amount": p.get("amount")} for p in found]
    return [{"type": "text", "text": text or "", "ref": None, "amount": None}]
