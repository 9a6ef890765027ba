"""Chat formatting: conversations of typed content parts to training text, with a loss mask, and back.

A turn becomes `### role: content</turn>` and a line end. A visitor flattens a turn's parts in order: text is escaped, and images, audio and
documents become placeholders `<|kind:n|>`, n being the place in the row's attachments, which hold the reference and the number of
tokens that the placeholder stands for. Escaping puts a backslash before each backslash and #, and into each `</turn>` and `<|`: control
strings never occur within texts, and a backslash always says to take the next character as it is.

Scale: turns are range-partitioned by conversation and order, formatted in one pass and written as rows of at most about CHUNK characters and one
turn, so a conversation of any length is many small rows over many tasks. What is read back of a whole conversation is
a stream of those rows; a task holds one of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a row of output ends with its turn.
CHUNK = 1 << 20
#: Fixed values of the template.
START, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")

_SPAN, _ATTACHMENT = "struct<start:int,end:int>", "struct<turn:int,kind:string,ref:string,at:int,tokens:bigint>"
FORMATTED = f"part long, formatted string, n_turns int, loss array<{_SPAN}>, attachments array<{_ATTACHMENT}>, attachment_tokens long"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Costs:
    """Tokens that an attachment's placeholder expands to; what is not said of a part is taken as `side`, one second or one page."""

    patch: int = 28
    side: int = 448
    audio_per_second: float = 25.0
    per_page: int = 1024

    def image(self, width: int | None, height: int | None) -> int:
        return math.prod(math.ceil(max(1, n or self.side) / self.patch) for n in (width, height))

    def audio(self, seconds: float | None) -> int:
        return math.ceil(max(0.0, 1.0 if seconds is None else seconds) * self.audio_per_second)

    def document(self, pages: int | None) -> int:
        return max(0, 1 if pages is None else pages) * self.per_page


@dataclass
class PartVisitor:
    """Flattens the parts of one turn after another into content and attachments; `visit` takes one turn."""

    costs: Costs = field(default_factory=Costs)
    attachments: list[tuple] = field(default_factory=list)

    def visit(self, turn: int, at: int, text: str | None, parts: list[dict[str, Any] | None]) -> str:
        """A turn's content; `at` is where it begins in the row. The text column comes first, then the parts."""
        out, said, length = [], [text or ""], 0

        def close() -> None:  # texts that follow each other are escaped as one: a control string may lie across their border
            nonlocal length
            out.append(escaped("".join(said)))
            length += len(out[-1])
            said.clear()

        for part in parts:
            own = getattr(self, f"visit_{(part or {}).get('type') or 'text'}", self.visit_text)(part or {})
            if isinstance(own, str):
                said.append(own)
                continue
            close()
            kind, tokens = own
            mark = f"<|{kind}:{len(self.attachments)}|>"
            self.attachments.append((turn, kind, part.get("ref"), at + length, tokens))
            out.append(mark)
            length += len(mark)
        close()
        return "".join(out)

    def visit_text(self, part: dict[str, Any]) -> str:
        return part.get("text") or ""

    def visit_image(self, part: dict[str, Any]) -> tuple[str, int]:
        return "image", self.costs.image(part.get("width"), part.get("height"))

    def visit_audio(self, part: dict[str, Any]) -> tuple[str, int]:
        return "audio", self.costs.audio(part.get("seconds"))

    def visit_document(self, part: dict[str, Any]) -> tuple[str, int]:
        return "document", self.costs.document(part.get("pages"))


class _Row:
    """A row of output while it is put together."""

    def __init__(self, costs: Costs) -> None:
        self.pieces: list[str] = []
        self.length = self.turns = 0
        self.loss: list[tuple[int, int]] = []
        self.visitor = PartVisitor(costs)

    def add(self, role: str, text: str | None, parts: list, in_loss: bool) -> None:
        head = START + escaped(role).replace(":", "\\:") + AFTER_ROLE
        begin = self.length + len(head)
        content = self.visitor.visit(self.turns, begin, text, parts)
        if in_loss:
            self.loss.append((begin, begin + len(content)))
        self.pieces += [head, content, END]
        self.length = begin + len(content) + len(END)
        self.turns += 1

    def done(self) -> tuple:
        spans = [{"start": a, "end": b} for a, b in self.loss]
        attached = [dict(zip(("turn", "kind", "ref", "at", "tokens"), a, strict=True)) for a in self.visitor.attachments]
        return "".join(self.pieces), self.turns, spans, attached, sum(a["tokens"] for a in attached)


def format_chats(conversations: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), costs: Costs | None = None, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part (rows of a conversation in order), formatted, n_turns, loss (spans in code points of formatted), attachments, attachment_tokens.

    `conversations` has conv_id, turn, role, text and, optionally, parts: an array of structs with type (text, image, audio or document), text, ref, width,
    height, seconds, pages, of which any may be absent. Turns are in order of turn, role and text, nulls first; rows that repeat are turns each. A
    null role or text is empty; a null part is no text; a part of another type is its text. Rows of a null conv_id are one
    conversation. Whole turns are under the loss whose role is one of loss_roles. Empty: no rows. Other columns are left out.
    """
    costs = costs or Costs()
    own = conversations.select("conv_id", "turn", "role", "text", *(["parts"] if "parts" in conversations.columns else []))
    order = ["conv_id", "turn", "role", "text"]
    kind = own.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        schema = pa.schema([("part", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))), ("attachment_tokens", pa.int64())])
        id_kind, ids, rows, size = pa.int64(), [], [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal base, size
            columns = [pa.array(c, f.type) for c, f in zip(zip(*((base + i, *r) for i, r in enumerate(rows)), strict=True), schema, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *columns], ["conv_id", *schema.names])
            base, size = base + len(rows), 0
            ids.clear()
            rows.clear()
            return out

        held, row = None, None
        for batch in batches:
            id_kind = batch.column("conv_id").type
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                parts = part.column("parts").to_pylist() if "parts" in batch.schema.names else [None] * part.num_rows
                for conv, role, text, content in zip(part.column("conv_id").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist(), parts, strict=True):
                    if row is not None and (conv != held or row.length >= chunk):
                        ids.append(held)
                        rows.append(row.done())
                        size += row.length
                        row = None
                        if size >= CHUNK or len(rows) >= 1000:
                            yield flushed()
                    held, row = conv, row or _Row(costs)
                    row.add(role or "", text, content or [], (role or "") in loss_roles)
        if row is not None:
            ids.append(held)
            rows.append(row.done())
        if rows:
            yield flushed()

    return own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def turns_of(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, begin, end) of each turn's content in a formatted text; a text that is none is an error."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(END, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        yield unescaped(head[1]), head.end(), end
        at = end + len(END)


def parts_of(content: str, attachments: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The parts of a turn's content: texts, and what its placeholders stand for."""
    out, at = [], 0
    for m in _PLACE.finditer(content):
        if m.start() > at:
            out.append({"type": "text", "text": unescaped(content[at : m.start()])})
        a = attachments[int(m[2])]
        out.append({"type": m[1], "ref": a["ref"], "tokens": a["tokens"]})
        at = m.end()
    if at < len(content) or not out:
        out.append({"type": "text", "text": unescaped(content[at:])})
    return out


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, part, turn (from 0 in its row), role, in_loss, parts (type, text, ref, tokens) of each turn of formatted rows. Narrow."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        for batch in batches:
            for a in range(batch.num_rows):
                row = batch.slice(a, 1).to_pylist()[0]
                loss = {(s["start"], s["end"]) for s in row["loss"]}
                turns = [(i, role, (b, e) in loss, parts_of(row["formatted"][b:e], row["attachments"])) for i, (role, b, e) in enumerate(turns_of(row["formatted"]))]
                columns = [pa.array(c, k) for c, k in zip(zip(*turns, strict=True), (pa.int32(), pa.string(), pa.bool_(), out), strict=True)] if turns else []
                if columns:
                    ids = pa.array([row["conv_id"]] * len(turns), batch.column("conv_id").type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([row["part"]] * len(turns), pa.int64()), *columns], ["conv_id", "part", "turn", "role", "in_loss", "parts"])

    return formatted.select("conv_id", "part", "formatted", "loss", "attachments").mapInArrow(run, f"conv_id {kind}, part long, turn int, role string, in_loss boolean, parts array<struct<type:string,text:string,ref:string,tokens:bigint>>")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, line end, text, line end of each turn), loss_chars, loss_sha256 (of what the loss mask covers, unescaped), formatted_chars, attachment_tokens.

    A conversation's rows go by in order, and a task holds one of them; placeholders count as they stand.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind, done = pa.int64(), []
        held: dict[str, Any] | None = None

        def flushed() -> pa.RecordBatch:
            kinds = (id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            rows = [(d["conv"], d["turns"], d["all"].hexdigest(), d["n_loss"], d["loss"].hexdigest(), d["chars"], d["tokens"]) for d in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            id_kind = batch.column("conv_id").type
            for a in range(0, batch.num_rows, 64):
                for row in batch.slice(a, 64).to_pylist():
                    if held is None or row["conv_id"] != held["conv"]:
                        if held is not None:
                            done.append(held)
                        held = {"conv": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "n_loss": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0}
                    text = row["formatted"]
                    for role, begin, end in turns_of(text):
                        held["all"].update(f"{role}\n{unescaped(text[begin:end])}\n".encode())
                        held["turns"] += 1
                    for s in row["loss"]:
                        own = unescaped(text[s["start"] : s["end"]])
                        held["n_loss"] += len(own)
                        held["loss"].update(own.encode())
                    held["chars"] += len(text)
                    held["tokens"] += row["attachment_tokens"]
                if len(done) >= 1000:
                    yield flushed()
        if held is not None:
            done.append(held)
        if done:
            yield flushed()

    ordered = formatted.select("conv_id", "part", "formatted", "loss", "attachment_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")
