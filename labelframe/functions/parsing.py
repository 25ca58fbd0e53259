"""Tolerant reading of model output and of small arithmetic expressions (Arrow functions over whole columns)."""

from __future__ import annotations

import json
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType


def loads_tolerant(content: object) -> object:
    """JSON as it stands, inside a code fence, or from the first brace on (what follows is ignored); raises ValueError."""
    if isinstance(content, dict):
        return content
    if not isinstance(content, str):
        raise ValueError("content is neither text nor an object")
    text = content.strip()
    tries = [text]
    if len(text) >= 6 and text[:3] == text[-3:] == "```":
        fenced = text[3:-3].strip()
        tries.append(fenced[4:].lstrip() if fenced[:4].lower() == "json" else fenced)
    for one in tries:
        try:
            return json.loads(one)
        except ValueError:
            pass
    brace = text.find("{")
    if brace < 0:
        raise ValueError("no JSON object")
    try:
        return json.JSONDecoder().raw_decode(text, brace)[0]
    except (ValueError, RecursionError) as e:
        raise ValueError(f"invalid JSON: {e}") from e


def message_content(response: object) -> object:
    """The content of a chat completion: text, an object, or the text parts of a list put together; raises ValueError."""
    try:
        content = response["choices"][0]["message"]["content"]  # type: ignore[index]
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError("no message content") from e
    if isinstance(content, (str, dict)):
        return content
    if isinstance(content, list):
        said = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in content]
        if said := [p for p in said if isinstance(p, str)]:
            return "".join(said)
    raise ValueError("message content is not text")


def lenient_int(value: object) -> int | None:
    """Whole part of a number or of an integer's text; None for booleans, nulls and the rest."""
    if value is None or isinstance(value, bool):
        return None
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return None


def clean_box(value: object, width: float, height: float) -> list[float] | None:
    if not isinstance(value, list) or len(value) != 4 or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in value):
        return None
    try:
        x0, y0, x1, y1 = map(float, value)
    except OverflowError:
        return None
    if not all(map(math.isfinite, (x0, y0, x1, y1))):
        return None
    x0, x1 = (min(width, max(0.0, v)) for v in (x0, x1))
    y0, y1 = (min(height, max(0.0, v)) for v in (y0, y1))
    return [x0, y0, x1, y1] if x1 > x0 and y1 > y0 else None


def clean_output(value: object, width: float, height: float) -> dict:
    """The output contract: transcript, errors (step, box, type), score; raises ValueError."""
    if not isinstance(value, dict):
        raise ValueError("output is not an object")
    if not isinstance(value.get("transcript"), str):
        raise ValueError("transcript is not text")
    if not isinstance(value.get("errors"), list):
        raise ValueError("errors is not an array")
    text = lambda v: v if v is None or isinstance(v, str) else str(v)
    errors = [e if isinstance(e, dict) else {} for e in value["errors"]]
    cleaned = [{"step_id": text(e.get("step_id")), "bbox": clean_box(e.get("bbox"), width, height), "type": text(e.get("type", "")) if "type" not in e or e["type"] is not None else "None"} for e in errors]
    score = lenient_int(value.get("score"))
    return {"transcript": value["transcript"], "errors": cleaned, "score": score if score is None or abs(score) < 2**63 else None}


PREDICTED = StructType().add("step_id", StringType()).add("bbox", ArrayType(DoubleType())).add("type", StringType())
OUTPUT = StructType().add("transcript", StringType()).add("errors", ArrayType(PREDICTED)).add("score", LongType()).add("failure", StringType())


@F.pandas_udf(OUTPUT)
def _parse(raw: pd.Series, width: pd.Series, height: pd.Series, envelope: pd.Series) -> pd.DataFrame:
    rows = []
    for text, w, h, wrapped in zip(raw, width, height, envelope, strict=True):
        try:
            if text is None:
                raise ValueError("no output")
            content = message_content(loads_tolerant(text)) if wrapped else text
            out = clean_output(loads_tolerant(content), float(w), float(h))
            rows.append((out["transcript"], out["errors"], out["score"], None))
        except ValueError as e:
            rows.append((None, None, None, str(e)))
    frame = pd.DataFrame(rows, columns=["transcript", "errors", "score", "failure"])
    return frame.astype({"score": "Int64"})


def parse_output(raw: Column, width: Column, height: Column, envelope: bool = False) -> Column:
    """struct(transcript, errors, score, failure) of raw model output; ``failure`` tells why there is nothing else.

    Boxes are clamped to width and height: the page's, or 1000 by 1000 for relative ones.
    """
    return _parse(raw, width.cast("double"), height.cast("double"), F.lit(envelope))


# Arithmetic expressions of whole numbers, + - * and signs


_TOKEN = re.compile(r"\s*(?:(\d+)|([-+*()]))")
_NUMBER = re.compile(r"-?\d+")
_APPLY = {"+": operator.add, "-": operator.sub, "*": operator.mul}
_SHOWN = {"+": "+", "-": "-", "*": "×"}
LONGEST, MOST_NUMBERS = 40, 4


def parse_expression(text: object) -> tuple[int, list[int], str]:
    """(value, numbers as they stand in the canonical form, canonical form); raises ValueError.

    At most 40 characters and four numbers; ``×`` is ``*``, ``$`` is ignored. Nested two-sided parts get brackets, signs stand at their operand.
    """
    if not isinstance(text, str) or len(text) > LONGEST:
        raise ValueError("no short expression")
    source = text.replace("×", "*").replace("　", " ").replace("$", "").strip()
    tokens, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        if m[1] and len(m[1]) > 1 and m[1][0] == "0" and m[1].strip("0"):
            raise ValueError("leading zero")
        tokens.append(m[1] or m[2])
        at = m.end()
    if sum(t.isdigit() for t in tokens) > MOST_NUMBERS:
        raise ValueError("too many numbers")
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the expression ends early")
        place += 1
        return tokens[place - 1]

    # each part: (value, canonical form, kind: number, sign or two-sided)
    def operand() -> tuple[int, str, str]:
        token = take()
        if token in "+-":
            value, shown, kind = operand()
            return (-value if token == "-" else value), token + (shown if kind == "number" else f"({shown})"), "sign"
        if token == "(":
            inside = summed()
            if take() != ")":
                raise ValueError("missing bracket")
            return inside
        if not token.isdigit():
            raise ValueError(f"unexpected {token}")
        return int(token), str(int(token)), "number"

    def joined(part, signs: str) -> tuple[int, str, str]:
        left = part()
        while (sign := peek()) is not None and sign in signs:
            take()
            right = part()
            bracket = lambda p: f"({p[1]})" if p[2] == "two" else p[1]
            left = _APPLY[sign](left[0], right[0]), f"{bracket(left)} {_SHOWN[sign]} {bracket(right)}", "two"
        return left

    def summed() -> tuple[int, str, str]:
        return joined(lambda: joined(operand, "*"), "+-")

    value, shown, _ = summed()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()}")
    return value, [int(n) for n in _NUMBER.findall(shown)], shown


@F.pandas_udf(StructType().add("value", LongType()).add("tokens", ArrayType(LongType())).add("canonical", StringType()).add("failure", StringType()))
def expression(texts: pd.Series) -> pd.DataFrame:
    """``parse_expression`` of a column."""
    rows = []
    for text in texts:
        try:
            rows.append((*parse_expression(text), None))
        except ValueError as e:
            rows.append((None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["value", "tokens", "canonical", "failure"]).astype({"value": "Int64"})
