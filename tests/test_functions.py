from __future__ import annotations

import difflib
import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import numbers as N
from labelframe.functions import parsing, seeds
from labelframe.functions import text as T
from labelframe.operators import programs


def column(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*df.columns, *(e.alias(k) for k, e in exprs.items())).collect()]


def test_normalise_and_cer(spark):
    rows = column(spark, [("１ ２　3\n", "123"), ("abc", "adc"), ("", "x"), ("", ""), ("ｱ", "ア")], "a string, b string", n=T.normalize_text("a"), c=T.cer(T.normalize_text("a"), T.normalize_text("b")))
    assert [r["n"] for r in rows] == ["123", "abc", "", "", "ア"]
    assert [round(r["c"], 6) for r in rows] == [0, 0.333333, 1, 0, 0]


def test_lines_follow_unicode(spark):
    texts = ["a\r\nb", "a\x0bb\x1cc\x85d e", "a\n", "", "a\n\nb", "\n"]
    got = column(spark, [(t,) for t in texts], "t string", x=T.lines(F.col("t")))
    assert [r["x"] for r in got] == [t.splitlines() for t in texts]


def test_without_spaces_is_python_whitespace(spark):
    chars = [chr(c) for c in range(1, 0xD800) if chr(c).isspace()] + ["a", "​"]
    got = column(spark, [(c,) for c in chars], "t string", x=T.without_spaces(F.col("t")))
    assert [r["x"] for r in got] == ["" if c.isspace() else c for c in chars]


def flip(text):
    at = text.rfind("=")
    for i in range(len(text) - 1, at, -1):
        if at >= 0 and text[i] in "+-":
            before = text[at + 1 : i].rstrip()
            if before and before[-1] not in "=+-*/×÷(":
                return text[:i] + ("-" if text[i] == "+" else "+") + text[i + 1 :]
    return None


def test_flip_last_binary_sign(spark):
    rnd = random.Random(3)
    texts = ["3x = 20 + 8", "3x = -20 - -8", "3x = -20", "no sign", "3x=5-2=9+ -1", "2x = (-3) + 4"] + ["".join(rnd.choice("12x=+-*( )×") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    got = column(spark, [(t,) for t in texts], "t string", x=T.flip_last_binary_sign(F.col("t")))
    assert [r["x"] for r in got] == [flip(t) for t in texts]
    assert [r["x"] for r in got[:4]] == ["3x = 20 - 8", "3x = -20 + -8", None, None]


def test_tokens(spark):
    row = column(spark, [("1 -2 ３4 x-5+6", ["1", "34"], ["1", "1", "2"], ["1", "2", "3"])], "t string, e array<string>, a array<string>, k array<string>", n=T.number_tokens(F.col("t")), i=T.integers(F.col("t")), s=T.is_subsequence(F.col("e"), T.number_tokens(F.col("t"))), x=T.first_excess(F.col("a"), F.col("k")), g=T.bigrams(F.lit("abcd")))[0]
    assert row["n"] == ["1", "-2", "34", "-5", "6"] and row["i"] == [1, -2, 34, -5, 6]
    assert row["s"] is True and row["x"] == 1 and row["g"] == ["ab", "bc", "cd"]


def test_compose_step(spark):
    got = column(spark, [(" よって。", "x = 3"), ("ｘ＝3 より。", "x = 3")], "e string, t string", x=T.compose_step(F.col("e"), F.col("t")))
    assert [r["x"] for r in got] == ["よってx = 3", "ｘ＝3 より"]


def test_over_corrected_needs_a_strictly_nearer_gold(spark):
    rows = [(["x=1", "3x=12"], "3x=12", "3x=28"), (["3x=28"], "3x=12", "3x=28"), (["3x=99"], "3x=12", "3x=28"), ([""], "a", "b"), (["a"], "a", "a")]
    got = column(spark, rows, "l array<string>, g string, m string", x=T.over_corrected(F.col("l"), F.col("g"), F.col("m")))
    assert [r["x"] for r in got] == [True, False, False, False, False]


def test_boxes(spark):
    rows = [([0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 10.0]), ([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0]), (None, [0.0, 0.0, 1.0, 1.0]), ([0.0, 0.0, 0.0, 4.0], [0.0, 0.0, 0.0, 4.0])]
    got = column(spark, rows, "a array<double>, b array<double>", i=G.iou(F.col("a"), F.col("b")), j=G.iou(F.col("b"), F.col("a")), s=G.sanitize(F.col("a"), F.lit(8.0), F.lit(1000.0)))
    assert [round(r["i"], 6) for r in got] == [1, 0.333333, 0, 0] and all(r["i"] == r["j"] for r in got)
    assert [r["s"] for r in got] == [[0, 0, 8, 10], [0, 0, 8, 10], None, None]


def test_relative_rounds_half_even(spark):
    got = column(spark, [([0.5, 2.5, 1.5, 5000.0],)], "b array<double>", r=G.relative(F.col("b"), F.lit(1000), F.lit(1000)), o=G.outward(F.col("b")))[0]
    assert got["r"] == [0, 2, 2, 1000] and got["o"] == [0, 2, 2, 5000]


def test_union_and_spans(spark):
    chars = [(0, 0, [0.0, 0.0, 1.5, 1.0]), (1, 0, [2.0, 0.0, 3.0, 1.2]), (4, 1, [0.0, 5.0, 1.0, 6.0])]
    row = column(spark, [(chars,)], "c array<struct<i:int,row:int,bbox:array<double>>>", near=G.characters_between(F.col("c"), F.lit(2), F.lit(3)), none=G.characters_between(F.col("c"), F.lit(20), F.lit(21)), boxes=G.span_boxes(F.col("c")))[0]
    assert [c["i"] for c in row["near"]] == [1] and len(row["none"]) == 3
    assert row["boxes"] == [[0, 0, 3, 2], [0, 5, 1, 6]]
    row = column(spark, [([[1.0, 2.0, 3.0, 4.0], [0.0]],)], "b array<array<double>>", u=G.union(F.col("b")), s=G.union(F.col("b"), strict=True))[0]
    assert row["u"] == [1, 2, 3, 4] and row["s"] is None


def test_alignment_of_a_longer_span(spark):
    row = column(spark, [("3x = 20 - 8", "3x = 200 - 8", 5, 8), ("ab", "xb", 1, 2)], "g string, m string, lo int, hi int", a=G.alignment(F.col("g"), F.col("m"), F.col("lo"), F.col("hi")))
    cells = [c["cell"] for c in row[0]["a"]]
    assert cells == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10] and row[0]["a"][5]["id"] == "mutation:5:0" and row[1]["a"] is None


def test_natural_layout_wraps(spark):
    row = column(spark, [([4.0, 4.0, 4.0], [0.5, 0.0, 0.0])], "a array<double>, n array<double>", p=G.natural_places(F.col("a"), F.col("n"), 0, 1, 9))[0]
    assert [(p["row"], p["x"]) for p in row["p"]] == [(0, 0), (0, 4.5), (1, 1)]


def test_rationals(spark):
    rows = [(6, -4), (0, 5), (7, 1), (-9, -3)]
    got = column(spark, rows, "n bigint, d bigint", r=N.rational(F.col("n"), F.col("d")), t=N.rational_text(N.rational(F.col("n"), F.col("d"))))
    assert [r["t"] for r in got] == ["-3/2", "0", "7", "3"]


def test_nearest_rank(spark):
    values = [1, 1, 2, 5, 9, 9, 9, 12]
    df = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").count()
    got = df.agg(*(N.nearest_rank(F.col("v"), F.col("count"), p).alias(str(i)) for i, p in enumerate((0.05, 0.5, 0.95)))).first()
    assert list(got) == [sorted(values)[round((len(values) - 1) * p)] for p in (0.05, 0.5, 0.95)]
    assert df.where("v < 0").agg(N.nearest_rank(F.col("v"), F.col("count"), 0.5).alias("x")).first()[0] == 0


def python_seed(*parts):
    said = "".join(f"{type(p).__name__}:{len(str(p))}:{p}|" for p in parts)
    return int.from_bytes(hashlib.sha256(said.encode()).digest()[:8], "big")


def test_seeds(spark):
    names = ["abc", "漢字", ""]
    digest = seeds.named_digest((F.col("t"), "str"), "s1", 3)
    got = column(spark, [(n,) for n in names], "t string", s=seeds.seed(digest), u=seeds.unit(digest), p=seeds.pick(digest, F.lit(7)))
    for name, row in zip(names, got, strict=True):
        s = python_seed(name, "s1", 3)
        assert int(row["s"]) == s and row["p"] == s % 7 and row["u"] == (s >> 11) / float(1 << 53)


def test_smooth_field_stays_in_bounds_and_is_smooth(spark):
    df = spark.range(0, 400).select(F.col("id").cast("double").alias("x"), F.lit("w").alias("w"), F.lit("s1").alias("k"), F.lit(0).alias("row"))
    got = [r[0] for r in df.select(seeds.smooth_field(F.col("w"), F.col("k"), F.col("row"), F.col("x"), "n", F.lit(4.5), F.lit(100.0)), "x").orderBy("x").collect()]
    assert max(map(abs, got)) <= 4.5 and max(abs(a - b) for a, b in zip(got, got[1:], strict=False)) < 0.5
    place = seeds.placement(seeds.DEFAULTS, F.col("w"), F.col("k"), F.col("row"), F.col("row"), F.col("x"), F.lit(40.0))
    assert all(0.9 < r[0]["size_scale"] < 1.1 for r in df.select(place).collect())


def test_settings_are_checked():
    assert seeds.validate_settings(None) is None and seeds.validate_settings({"enabled": False}) is None
    assert seeds.validate_settings({})["rotation_degrees"] == 2.5
    for bad in ({"rotation_degrees": 4.1}, {"baseline_wavelength_px": 200}, {"nonsense": 1}, {"bleed_strength": True}, {"fading_strength": float("nan")}, {"elastic_grid_size": 5}):
        with pytest.raises(ValueError):
            seeds.validate_settings(bad)


def test_robust_json(spark):
    good = '{"transcript":"a","errors":[{"step_id":1,"bbox":[-1,2,1001,900],"type":"t"},{"bbox":[0,0,0,4]},5],"score":"2"}'
    raws = [good, f"```json\n{good}\n```", f"note: {good} trailing", "[1]", '{"transcript":1}', '{"transcript":"a","errors":[],"score":true}', None, "{", '{"transcript":"a","errors":[],"score":2.9}']
    got = column(spark, [(r,) for r in raws], "r string", o=parsing.parse_output(F.col("r"), F.lit(1000), F.lit(1000)))
    for row in got[:3]:
        assert row["o"]["errors"][0].asDict() == {"step_id": "1", "bbox": [0, 2, 1000, 900], "type": "t"}
        assert row["o"]["errors"][1]["bbox"] is None and row["o"]["score"] == 2 and row["o"]["failure"] is None
    assert all(got[i]["o"]["failure"] for i in (3, 4, 6, 7)) and got[5]["o"]["score"] is None and got[8]["o"]["score"] == 2
    envelope = '{"choices":[{"message":{"content":[{"type":"text","text":"{\\"transcript\\":\\"z\\",\\"errors\\":[],\\"score\\":1}"}]}}]}'
    assert column(spark, [(envelope,)], "r string", o=parsing.parse_output(F.col("r"), F.lit(9), F.lit(9), envelope=True))[0]["o"]["transcript"] == "z"


@given(st.recursive(st.integers(0, 99).map(str), lambda inner: st.one_of(st.tuples(inner, st.sampled_from("+-*"), inner).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), st.tuples(st.sampled_from("+-"), inner).map("".join)), max_leaves=4))
@settings(max_examples=200, deadline=None)
def test_expression_values(text):
    if len(text) > 40:
        with pytest.raises(ValueError):
            parsing.parse_expression(text)
        return
    value, tokens, shown = parsing.parse_expression(text)
    assert value == eval(text) and value == eval(shown.replace("×", "*"))
    assert tokens == [int(t) for t in re.findall(r"-?\d+", shown)]


@pytest.mark.parametrize("text", ["", "1/2", "2**3", "a", "1+2+3+4+5", "1+", "(1", "1.5", "01", "1" * 41, None])
def test_expressions_refused(text):
    with pytest.raises(ValueError):
        parsing.parse_expression(text)


def test_expression_forms(spark):
    got = column(spark, [("$20 + 8$",), ("-(3)×2",), ("1+2-3",), ("-(1+2)",)], "t string", e=parsing.expression("t"))
    assert [r["e"]["canonical"] for r in got] == ["20 + 8", "-3 × 2", "(1 + 2) - 3", "-(1 + 2)"]


def test_minimal_span(spark):
    pairs = [("3x = 20 - 8", "3x = 20 + 8"), ("x = 5", "x = 15"), ("ab", "ab"), ("a12b", "a2b")]
    got = column(spark, pairs, "a string, b string", s=programs.minimal_span("a", "b"))
    for (a, b), row in zip(pairs, got, strict=True):
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        lo, hi = (min(o[3] for o in ops), max(o[4] for o in ops)) if ops else (0, len(b))
        assert row["s"] == [lo, max(hi, min(len(b), lo + 1))]


def test_normalisation_matches_python(spark):
    rnd = random.Random(1)
    texts = ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0xFF00, 0xFFEF)])) for _ in range(20)) for _ in range(200)]
    got = column(spark, [(t,) for t in texts], "t string", n=T.normalize_text("t"))
    assert [r["n"] for r in got] == [re.sub(r"\s+", "", unicodedata.normalize("NFKC", t)) for t in texts]
