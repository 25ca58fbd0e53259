"""Text functions: normalisation, edit distance, tokens, signs. Lengths and positions are code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from labelframe.functions.numbers import bind

#: What counts as white space: Unicode white space and the separators U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]"
#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WIDE_DIGITS, DIGITS = "".join(chr(0xFF10 + d) for d in range(10)), "0123456789"


def _normal(text: str | None) -> str | None:
    return text if text is None else "".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """NFKC without any white space."""
    return texts.map(_normal)


@F.pandas_udf(ArrayType(StringType()))
def normalize_all(texts: pd.Series) -> pd.Series:
    """``normalize_text`` of each element."""
    return texts.map(lambda xs: None if xs is None else [_normal(x) for x in xs])


def without_spaces(text: Column) -> Column:
    """White space taken out, without NFKC: enough for ASCII, and all in the JVM."""
    return F.regexp_replace(text, SPACES, "")


def lines(text: Column) -> Column:
    """Lines at all Unicode line ends; no empty one after a last end."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by the reference's length, not clamped; of an empty reference 0 or 1."""
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def number_tokens(text: Column) -> Column:
    """Integers with an optional minus, as written (full-width digits as ASCII)."""
    return F.regexp_extract_all(F.translate(text, WIDE_DIGITS, DIGITS), F.lit(r"-?\d+"), F.lit(0))


def integers(text: Column) -> Column:
    """Integers with an optional sign, as numbers."""
    return F.transform(F.regexp_extract_all(F.translate(text, WIDE_DIGITS, DIGITS), F.lit(r"[+-]?\d+"), F.lit(0)), lambda t: t.cast("long"))


#: (through the last =) (right side before the sign, ending in an operand) (sign) (rest without =); greedy, so the last binary sign is taken.
_BINARY_SIGN = r"(?s)^(.*=)([^=]*[^=+\-*/×÷(\s]\s*)([+-])([^=]*)$"


def flip_last_binary_sign(text: Column) -> Column:
    """The last binary + or - right of the last = turned round; null where there is none."""
    part = lambda k: F.regexp_extract(text, _BINARY_SIGN, k)
    return F.when(text.rlike(_BINARY_SIGN), F.concat(part(1), part(2), F.when(part(3) == "+", "-").otherwise("+"), part(4)))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters. The text is split once: a substring at position i would walk through i characters."""
    return bind(F.split(text, ""), lambda cs: F.zip_with(F.slice(cs, F.lit(1), F.greatest(F.lit(0), F.size(cs) - 1)), F.slice(cs, F.lit(2), F.greatest(F.lit(0), F.size(cs) - 1)), lambda a, b: F.concat(a, b)))


def is_subsequence(expected: Column, actual: Column) -> Column:
    """Whether the tokens of ``expected`` come in ``actual`` in this order, maybe with others between."""
    step = lambda at, token: F.when(F.get(expected, at) == token, at + 1).otherwise(at)
    return F.aggregate(actual, F.lit(0), step) == F.size(expected)


def first_excess(tokens: Column, known: Column) -> Column:
    """Position from 0 of the first token that comes more often, so far, than in ``known``; null for none.

    Both lists are sorted together, known ones first, and read once: of each token as many are allowed as are known.
    """
    entry = lambda x, i: F.struct(x.alias("t"), i.cast("int").alias("i"))
    merged = F.array_sort(F.concat(F.transform(known, lambda x: entry(x, F.lit(-1))), F.transform(tokens, lambda x, i: entry(x, i))))
    state = lambda t, left, found: F.struct(t.cast("string").alias("t"), left.cast("int").alias("left"), found.cast("int").alias("found"))

    def read(s: Column, e: Column) -> Column:
        left = F.when(s["t"].eqNullSafe(e["t"]), s["left"]).otherwise(0)
        return F.when(e["i"] < 0, state(e["t"], left + 1, s["found"])).when(left > 0, state(e["t"], left - 1, s["found"])).otherwise(state(e["t"], left, F.least(s["found"], e["i"])))

    return F.aggregate(merged, state(F.lit(None), F.lit(0), F.lit(None)), read, lambda s: s["found"])


def compose_step(explanation: Column, template: Column) -> Column:
    """The explanation without a last full stop, and the template after it unless it holds it already (white space aside)."""
    said = F.regexp_replace(F.regexp_replace(explanation, rf"^{SPACES}+|{SPACES}+$", ""), "。$", "")
    return F.when(F.contains(normalize_text(said), normalize_text(template)), said).otherwise(F.concat(said, template))


def nearest_line(text_lines: Column, first: Column, second: Column) -> Column:
    """Of non-empty lines the one nearest to either target (ties: the first line)."""
    placed = F.transform(text_lines, lambda x, i: F.struct(F.least(F.levenshtein(x, first), F.levenshtein(x, second)).alias("d"), i.alias("i"), x.alias("line")))
    return F.array_min(F.filter(placed, lambda s: s["line"] != ""))["line"]


def over_corrected(text_lines: Column, gold: Column, mutant: Column) -> Column:
    """Whether the nearest line is strictly nearer to the right step than to the wrong one that is on the page."""
    best = nearest_line(text_lines, gold, mutant)
    return F.coalesce((gold != mutant) & (F.levenshtein(best, gold) < F.levenshtein(best, mutant)), F.lit(False))
