r"""Operator 2: chat formatting of typed content parts.

A message is a role and an ordered list of typed parts (text, image, audio, document; documents may hold parts of their own). A visitor flattens
the parts in order: adjacent texts are joined and escaped as one, an attachment becomes a placeholder, is recorded by its order, kind and reference,
and adds the tokens that it expands to. A turn is ``<|im_start|>role\ntext<|im_end|>\n``.

Escaping is reversible and keeps control strings out of texts: a backslash goes in after the ``<`` of every ``<|``, ``<\|``,
``<\\|`` and so on, and reading takes one out. So in the output ``<|`` only begins what the template itself has written, also where a control string is dealt over several parts.
A line break in a role is written ``<|nl|>``.

Turns are ordered by (turn, role, parts). Conversations are dealt by id and read through turn by turn, so
memory is bounded by a turn, however long a conversation or a text is. Defined results: a null role or text counts as empty; null parts are
skipped; rows that repeat a turn stay, side by side; rows with a null conversation id form one conversation; extra columns
are ignored; an empty table gives an empty result. Parts that are no JSON list: an object is one part, a string one text, null none, any other value or text that
isn't JSON is a text as it stands. A part of an unknown type becomes a placeholder ``<|part_k|>`` of no tokens, recorded with its type; a text that is no
string counts as its JSON; sizes that are no finite numbers above zero count as missing, larger ones than ``SIZE_MOST`` as that; halves of surrogate pairs become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import shuffle_partitions, table

START, END, NEW_LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Side of an image patch in pixels, audio tokens a second, tokens a document page, most tokens of an image.
PATCH, AUDIO_RATE, PAGE_TOKENS, IMAGE_MOST = 28, 25, 256, 16384
#: Largest width, height, seconds or pages.
SIZE_MOST = 1 << 31
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PLACEHOLDER, _HALVES = re.compile(r"<\|([a-z]+)_(\d+)\|>"), re.compile("[\ud800-\udfff]")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def _whole(text: str) -> str:
    """``text`` as valid Unicode: JSON can hold halves of surrogate pairs."""
    return _HALVES.sub("\ufffd", text)


def as_parts(value) -> list:
    """A list of parts from any JSON value."""
    if value is None:
        return []
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict | str) else [json.dumps(value)]


def parse_parts(text: str) -> list:
    try:
        return as_parts(json.loads(text))
    except (ValueError, RecursionError):
        return [text]


def _size(part: dict, name: str, missing: float) -> float:
    value = part.get(name)
    try:
        value = float(value)
    except (TypeError, ValueError, OverflowError):
        return missing
    return min(value, SIZE_MOST) if math.isfinite(value) and value > 0 else missing


@dataclass
class Flattened:
    """What the visitor has written: pieces of output, attachments in order, the tokens they expand to."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    said: list[str] = field(default_factory=list)  # texts since the last placeholder, not yet escaped

    def close(self) -> None:
        """Escape what adjacent text parts say together."""
        if self.said:
            self.out.append(escape("".join(self.said)))
            self.said = []


class PartVisitor:
    """Dispatches on a part's ``type`` and flattens it into placeholders. Each visit returns the parts that come next, those inside the part."""

    def flatten(self, parts: list) -> Flattened:
        to, stack = Flattened(), [iter(parts)]
        while stack:
            part = next(stack[-1], stack)
            if part is stack:
                stack.pop()
            elif inner := self.visit(part, to):
                stack.append(iter(inner))
        to.close()
        return to

    def visit(self, part, to: Flattened) -> list:
        if part is None:
            return []
        if not isinstance(part, dict):
            part = {"text": part}
        kind = part.get("type") or "text"
        known = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        return known.get(kind if isinstance(kind, str) else "", self.visit_other)(part, to)

    def visit_text(self, part: dict, to: Flattened) -> list:
        text = part.get("text")
        to.said.append(_whole(text if isinstance(text, str) else "" if text is None else json.dumps(text)))
        return []

    def _attach(self, name: str, part: dict, tokens: int, to: Flattened, kind: str | None = None) -> None:
        to.close()
        uri = part.get("uri")
        to.out.append(f"<|{name}_{len(to.attachments)}|>")
        to.attachments.append({"kind": kind or name, "uri": _whole(uri if isinstance(uri, str) else json.dumps(uri)) if uri is not None else None, "tokens": tokens})
        to.tokens += tokens

    def visit_image(self, part: dict, to: Flattened) -> list:
        across, down = (math.ceil(_size(part, side, 1) / PATCH) for side in ("width", "height"))
        self._attach("image", part, min(across * down, IMAGE_MOST), to)
        return []

    def visit_audio(self, part: dict, to: Flattened) -> list:
        self._attach("audio", part, max(1, math.ceil(_size(part, "seconds", 0) * AUDIO_RATE)), to)
        return []

    def visit_document(self, part: dict, to: Flattened) -> list:
        """The document itself, then what it holds."""
        self._attach("document", part, math.ceil(_size(part, "pages", 1)) * PAGE_TOKENS, to)
        return as_parts(part.get("parts"))

    def visit_other(self, part: dict, to: Flattened) -> list:
        kind = part["type"]
        self._attach("part", part, 0, to, _whole(kind if isinstance(kind, str) else json.dumps(kind)))
        return []


VISITOR = PartVisitor()


def format_turn(role: str | None, parts: list) -> tuple[str, int, int, Flattened]:
    """(formatted turn, where its content begins and ends, what was flattened)."""
    flat = VISITOR.flatten(parts)
    head = START + escape(role or "").replace("\n", NEW_LINE) + "\n"
    body = "".join(flat.out)
    return head + body + END + "\n", len(head), len(head) + len(body), flat


def read_parts(content: str) -> Iterator[tuple[str, str | int]]:
    """What a turn's content holds, in order: ("text", what was said) and (placeholder's name, number of the attachment)."""
    at = 0
    for m in _PLACEHOLDER.finditer(content):
        if m.start() > at:
            yield "text", unescape(content[at : m.start()])
        yield m[1], int(m[2])
        at = m.end()
    if at < len(content):
        yield "text", unescape(content[at:])


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin and end of the content) of each turn in formatted text; placeholders stay in the text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        begin = formatted.index("\n", at) + 1
        end = formatted.index(END, begin)
        yield unescape(formatted[at + len(START) : begin - 1].replace(NEW_LINE, "\n")), unescape(formatted[begin:end]), begin, end
        at = end + len(END) + 1


TURNS = "conv_id long, turn long, role string, formatted string, char_start long, loss_start long, loss_end long, attachments string, expanded_tokens long"


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order within partitions, each conversation whole in one: ``formatted`` and its place ``char_start`` in the conversation,
    the span under the loss mask (in the conversation; null for other roles), attachments (JSON) and their expanded tokens.

    ``messages``: conv_id, turn, role and ``parts`` (JSON list of parts) or ``text``.
    """
    parts = F.col("parts") if "parts" in messages.columns else F.lit(None).cast("string")
    text = F.col("text") if "text" in messages.columns else F.lit("")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), parts.alias("parts"))
    rows = rows.repartition(shuffle_partitions(messages.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = (), 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for conv, turn, role, said, typed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    now, at = (conv,), 0
                whole, begin, end, flat = format_turn(role, parse_parts(typed) if typed is not None else [said])
                loss = role in loss_roles
                values = conv, turn, role, whole, at, at + begin if loss else None, at + end if loss else None, json.dumps(flat.attachments) if flat.attachments else "[]", flat.tokens
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
                at += len(whole)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in TURNS.split(", ")])

    return rows.mapInArrow(run, TURNS)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: counts and digests of turns and of all text under the loss mask.

    ``turns`` comes from ``format_conversations`` and keeps its order and partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: tuple = ()
        n = chars = loss_chars = tokens = attached = 0
        every = under = None

        def close() -> None:
            if now:
                done.append((now[0], n, every.hexdigest(), loss_chars, under.hexdigest(), chars, attached, tokens))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])
            done.clear()
            return out

        for batch in batches:
            for conv, formatted, start, loss_start, loss_end, attachments, expanded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    close()
                    now, every, under = (conv,), hashlib.sha256(), hashlib.sha256()
                    n = chars = loss_chars = tokens = attached = 0
                for role, text, _, _ in read_turns(formatted):
                    every.update(f"{role}\n{text}\n".encode())
                    n += 1
                if loss_start is not None:
                    masked = unescape(formatted[loss_start - start : loss_end - start])
                    under.update(masked.encode())
                    loss_chars += len(masked)
                chars += len(formatted)
                tokens += expanded
                attached += len(json.loads(attachments)) if attachments != "[]" else 0
            if len(done) > 1000:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    return turns.select("conv_id", "formatted", "char_start", "loss_start", "loss_end", "attachments", "expanded_tokens").mapInArrow(run, READ)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    return read_back(format_conversations(rows.unionByName(more)))


_SAID = "<|im_end|><|im_start|>assistant ok"
OP2_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{_SAID}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{NEW_LINE}')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + {len(START) + len(END) + 2})::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id"""
