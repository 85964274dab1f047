"""Operator 9: chat formatting of messages made of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor goes through them in order: text is escaped and
kept, each other part leaves a numbered placeholder, a reference to its attachment and the number of tokens that the
placeholder expands to. A turn is formatted on its own, so a conversation may have any number of turns; its formatted
text is the turns' text in order.

    <|role|>\\n text </s>\\n

Control strings inside roles and texts are escaped: a backslash is put after each backslash and after the first character
of each control string, so that only the template's own remain. Reading drops one backslash before each character.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.llm.common import slices

#: Strings with a meaning in chat templates, this one's among them.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A backslash, or the first character of a control string; control strings may overlap.
_special = re.compile("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_placeholder = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_escaped = re.compile(r"\\(.)", re.DOTALL)
START, ROLE_END, END = "<|", "|>\n", "</s>\n"
TRAINED_ROLE = "assistant"
#: Tokens of an image tile, pixels of its side, tokens of a second of audio and of a page of a document.
TILE_TOKENS, TILE_SIDE, SECOND_TOKENS, PAGE_TOKENS = 64, 224, 25, 512


def escape(text: str) -> str:
    return _special.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens parts, dictionaries with a type, in order. Placeholders are numbered over the whole conversation from `first`."""

    first: int = 1
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(max(part.get("width") or 1, 1) / TILE_SIDE) * math.ceil(max(part.get("height") or 1, 1) / TILE_SIDE)
        self._attach(part, tiles * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no such type of part: {part.get('type')!r}")

    def _attach(self, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.pieces.append(f"<|{part['type']}:{number}|>")
        self.attachments.append({"number": number, "type": part["type"], "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict], first: int = 1) -> tuple[str, int, int, list[dict]]:
    """The turn's text, the span in it that is trained on (empty but for the assistant), and its attachments. A null role is an empty one."""
    visitor = PartVisitor(first)
    for part in parts:
        visitor.visit(part)
    head, body = f"{START}{escape(role or '')}{ROLE_END}", "".join(visitor.pieces)
    return head + body + END, len(head), len(head) + (len(body) if role == TRAINED_ROLE else 0), visitor.attachments


FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<number long, type string, ref string, tokens long>>"


PARTS = "array<struct<type string, text string, ref string, width long, height long, seconds double, pages long>>"


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with first, the number of a turn's first placeholder: counted on over the conversation's turns before it, by a running sum."""
    count = F.coalesce(F.size(F.filter("parts", lambda p: p["type"] != "text")), F.lit(0))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64(F.to_json("parts")))
    return rows.withColumn("first", F.lit(1) + F.coalesce(F.sum(F.when(F.col("parts").isNull(), 0).otherwise(count)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per turn: its formatted text, the span under the loss mask, and attachments.

    rows: conv_id, turn, role and text or parts (an array of structs with type, text, ref, width, height, seconds, pages).
    A null text is empty, null parts are none, and null parts of an array are left out. Placeholders are numbered over the
    conversation, in the order of turns (null first; ties by role and content). Repeated rows keep a row each, other
    columns play no part, and an empty table gives no rows. Parts of an unknown type are an error.
    """
    typed = "parts" in rows.columns
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts" if typed else "text")
    plain = _numbered(plain) if typed else plain.withColumn("first", F.lit(1).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 512):
                out = []
                for r in part.to_pylist():
                    parts = [p for p in r["parts"] or [] if p is not None] if typed else [{"type": "text", "text": r["text"]}]
                    out.append((r["conv_id"], r["turn"], *format_turn(r["role"], parts, r["first"])))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    return plain.mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn of text, unescaped."""
    role, body = _read(formatted)
    return role, unescape(body)


def read_parts(formatted: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """Role and parts of a formatted turn: texts, unescaped, and attachments by the numbers of their placeholders. Empty texts aren't kept, and texts side by side become one.

    A text that looks like a placeholder was escaped and is read as text.
    """
    role, body = _read(formatted)
    by_number, parts, at = {a["number"]: a for a in attachments}, [], 0
    for m in _placeholder.finditer(body):
        if text := unescape(body[at : m.start()]):
            parts.append({"type": "text", "text": text})
        parts.append(dict(by_number[int(m[2])]))
        at = m.end()
    if text := unescape(body[at:]):
        parts.append({"type": "text", "text": text})
    return role, parts


def _read(formatted: str) -> tuple[str, str]:
    role, mark, rest = formatted.removeprefix(START).partition(ROLE_END)
    at = rest.find(END.rstrip("\n"))
    if not formatted.startswith(START) or not mark or rest[at:] != END:
        raise ValueError("not a formatted turn")
    return unescape(role), rest[:at]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted turns, per conversation.

    Turns are ordered by turn (null first), then by their text. A conversation's turns go through a task as a stream, and
    only hashes and counts are held, so one may be as long as it likes. A null conv_id is a conversation like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = [f.split()[0] for f in DIGESTS.split(", ")], object()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now: object = none
        done: list[tuple] = []
        turns = loss = hashlib.sha256()
        n = loss_chars = chars = 0
        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != now:
                    if now is not none:
                        done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, content = read_turn(text)
                turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                trained = unescape(text[start:end])
                loss.update(trained.encode("utf-8", "surrogatepass"))
                n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        if now is not none:
            done = [(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGESTS)


def probe_rows(rows: DataFrame) -> DataFrame:
    """Conversation -1: two turns that say the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    return rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def chat_digests(rows: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back. Rows that have that conv_id already are turns of the same conversation."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digest_conversations(format_conversations(plain.unionByName(probe_rows(rows))))


def _escaped_length(column: str) -> str:
    """SQL for the length of an escaped column: one character more for each backslash and each control string."""
    return f"length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL))


#: The same in SQL; a turn's template has 10 characters besides role and text.
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_escaped_length("role")} + {_escaped_length("text")} + 10 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
