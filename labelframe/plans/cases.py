"""Driver queries of functions and small operators on whole tables, each beside SQL that works the same out by other means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import parsing, seeds
from labelframe.functions import text as T
from labelframe.operators import audit, dataset, layout, probe, programs, verbalise
from labelframe.plans import expected as E
from labelframe.plans.generated import _boxed, _k, _made, _records
from labelframe.plans.registry import query, r6, table

# Text

_WIDE, _PLAIN = "０１２３ＡＢａｂ＋－＝（）", "0123ABab+-=()"


@query("normalized_texts", f"SELECT event_id, regexp_replace(event_type || event_id || 'AB+-' || (event_id % 4), '\\s', '', 'g') || CASE WHEN event_id % 2 = 0 THEN 'ガfi' ELSE '' END AS said FROM events")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width signs, half-width kana, a ligature and several kinds of white space come out plain."""
    wide = F.translate(F.concat(F.lit("AB+-"), (F.col("event_id") % 4).cast("string")), _PLAIN, _WIDE)
    text = F.concat(F.lit("\t"), "event_type", F.lit("　"), F.col("event_id").cast("string"), F.lit("  "), wide, F.when(F.col("event_id") % 2 == 0, " ｶﾞ\nﬁ").otherwise("\r\n"))
    return table(spark, sf_dir, "events").select("event_id", T.normalize_text(text).alias("said"))


@query("composed_steps", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('よって ', o_custkey, ' + 1') WHEN 1 THEN concat('よって', o_custkey, '+1') WHEN 2 THEN concat('まず', o_custkey, ' + 1') ELSE concat(o_custkey, ' + 1') END AS step FROM orders")
def composed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explanation gets its template appended unless it holds it, white space and width aside."""
    said = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' よって ', o_custkey, ' + 1。 ') WHEN 1 THEN concat('よって', o_custkey, '+1') WHEN 2 THEN 'まず。' ELSE ' ' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.compose_step(said, F.concat(F.col("o_custkey").cast("string"), F.lit(" + 1"))).alias("step"))


@query("minimal_spans", "WITH t AS (SELECT doc_id, '<' || lang || '=' AS a, CASE doc_id % 3 WHEN 0 THEN 'ZZ' WHEN 1 THEN '' ELSE n_chars::VARCHAR END AS m FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE length(a) END::INT AS lo, CASE doc_id % 3 WHEN 0 THEN length(a) + 2 WHEN 1 THEN length(a) + 1 ELSE length(a) + length(m) + 1 END::INT AS hi FROM t")
def minimal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a replaced, a dropped and no middle part (the whole text); the changed parts share no character with what stays."""
    gold = F.concat(F.lit("<"), "lang", F.lit("="), F.col("n_chars").cast("string"), F.lit(">"))
    mutant = F.concat(F.lit("<"), "lang", F.lit("="), F.when(F.col("doc_id") % 3 == 0, "ZZ").when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("n_chars").cast("string")), F.lit(">"))
    span = programs.minimal_span(gold, mutant)
    return table(spark, sf_dir, "documents").select("doc_id", span[0].alias("lo"), span[1].alias("hi"))


_OPS = "['+', '-', '×', '*', '/', '=']"
#: Spans of errors in worded steps: the template stands behind a clause, so its span moves by the clause's length.
RESPANNED = f"""WITH {E.generated()},
q0 AS (SELECT sample_id, gold[substr(site, 2)::INT] AS g, mutant[substr(site, 2)::INT] AS m FROM rec WHERE NOT control),
q1 AS (SELECT *, regexp_extract_all(g, '-?\\d+') AS gt, regexp_extract_all(m, '-?\\d+') AS mt, regexp_split_to_array(g, '-?\\d+') AS gs, regexp_split_to_array(m, '-?\\d+') AS ms FROM q0),
q2 AS (SELECT *, length(concat('つまり ', mt[1], ' を使うと、')) AS off, [list_sum([length(ms[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(mt[j]) FOR j IN range(1, i)]), 0) FOR i IN range(1, len(mt) + 1)] AS lo,
  list_min([i FOR i IN range(2, len(mt) + 1) IF list_filter(string_split(gs[i], ' '), lambda o: list_contains({_OPS}, o)) <> list_filter(string_split(ms[i], ' '), lambda o: list_contains({_OPS}, o))]) AS turned FROM q1),
q3 AS (SELECT *, coalesce(list_min([i FOR i IN range(1, len(mt) + 1) IF NOT list_contains(gt, mt[i])]), list_min([i FOR i IN range(1, len(mt) + 1) IF len(list_filter(mt[1:i], lambda t: t = mt[i])) > len(list_filter(gt, lambda t: t = mt[i]))])) AS other FROM q2)
SELECT sample_id, (off + CASE WHEN gt = mt THEN lo[turned - 1] + length(mt[turned - 1]) + length(ms[turned]) - length(ltrim(ms[turned])) ELSE coalesce(lo[other], 0) END)::INT AS lo,
  (off + CASE WHEN gt = mt THEN lo[turned] - length(ms[turned]) + length(rtrim(ms[turned])) ELSE coalesce(lo[other] + length(mt[other]), length(m)) END)::INT AS hi FROM q3"""


@query("respanned_errors", RESPANNED)
def respanned_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verbalise.verbalised(_records(spark, sf_dir).where(~F.col("control_flag.error_free")), verbalise.prefixed)
    span = F.get("injected_errors", 0)["span"]
    return out.select("sample_id", span[0].alias("lo"), span[1].alias("hi"))


# Model output

_SCORES = ("3.7", '"12"', '" 5 "', "true", "null", '"x"', "[1]", "-2")


@query("parsed_scores", "SELECT event_id, [3, 12, 5, NULL, NULL, NULL, NULL, -2][event_id % 8 + 1]::BIGINT AS score, event_type AS transcript FROM events")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.get(F.array(*map(F.lit, _SCORES)), (F.col("event_id") % 8).cast("int"))
    raw = F.concat(F.lit('{"transcript":"'), "event_type", F.lit('","errors":[],"score":'), score, F.lit("}"))
    out = parsing.parse_output(raw, F.lit(10), F.lit(10))
    return table(spark, sf_dir, "events").withColumn("o", out).select("event_id", "o.score", "o.transcript")


@query("parsed_envelopes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN event_type END AS transcript, event_id % 6 > 2 AS failed FROM events")
def parsed_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of chat completions: text, text parts, an object, an image only, no choices, no JSON."""
    out = F.concat(F.lit('{"transcript":"'), "event_type", F.lit('","errors":[]}'))
    quoted = F.concat(F.lit('"'), F.replace(out, F.lit('"'), F.lit('\\"')), F.lit('"'))
    halves = F.concat(F.lit('[{"type":"image"},"'), F.replace(F.substring(out, 1, 9), F.lit('"'), F.lit('\\"')), F.lit('",{"text":"'), F.replace(F.substring(out, 10, 200), F.lit('"'), F.lit('\\"')), F.lit('"}]'))
    k = F.col("event_id") % 6
    content = F.when(k == 0, quoted).when(k == 1, halves).when(k == 2, out).otherwise('[{"type":"image"}]')
    raw = F.when(k == 4, '{"choices":[]}').when(k == 5, "busy").otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit("}}]}")))
    rows = table(spark, sf_dir, "events").withColumn("o", parsing.parse_output(raw, F.lit(10), F.lit(10), envelope=True))
    return rows.select("event_id", "o.transcript", F.col("o.failure").isNotNull().alias("failed"))


_BOX = "l_partkey % 900 - 100 AS x, l_suppkey % 900 - 100 AS y, l_linenumber * 60 AS w"


@query("parsed_errors", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS k, {_BOX} FROM lineitem), c AS (SELECT *, least(600, greatest(0, x)) AS x0, least(400, greatest(0, y)) AS y0, least(600, greatest(0, x + w)) AS x1, least(400, greatest(0, y + w)) AS y1 FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN k < 3 AND x1 > x0 AND y1 > y0 THEN concat_ws(',', x0, y0, x1, y1) END AS box, CASE k WHEN 1 THEN '7' WHEN 2 THEN NULL ELSE 's1' END AS step_id, CASE k WHEN 0 THEN 't' WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE 't' END AS kind FROM c""")
def parsed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output contract on errors: boxes are clamped or dropped, ids and types made text."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 5 AS k", *_BOX.split(", "))
    box = F.expr("CASE WHEN k < 3 THEN concat('[', x, ',', y, ',', x + w, ',', y + w, ']') WHEN k = 3 THEN '[1,2,true,4]' ELSE '[1,2,3]' END")
    step = F.expr("""CASE k WHEN 1 THEN ',"step_id":7' WHEN 2 THEN '' ELSE ',"step_id":"s1"' END""")
    kind = F.expr("""CASE k WHEN 1 THEN ',"type":null' WHEN 2 THEN '' ELSE ',"type":"t"' END""")
    raw = F.concat(F.lit('{"transcript":"","errors":[{"bbox":'), box, step, kind, F.lit("}]}"))
    e = F.get(parsing.parse_output(raw, F.lit(600), F.lit(400))["errors"], 0)
    rows = rows.withColumn("e", e)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("e.bbox", lambda v: v.cast("long").cast("string")), ",").alias("box"), "e.step_id", F.col("e.type").alias("kind"))


# Geometry


@query("characters_in_span", "WITH c AS (SELECT o_orderkey, o_custkey % 12 AS lo, [q * 3 FOR q IN range(0, 4)] AS i FROM orders), p AS (SELECT *, [list_filter(i, lambda v: v >= lo - pad AND v < lo + 1 + pad) FOR pad IN range(0, 5)] AS tries FROM c) SELECT o_orderkey, array_to_string(coalesce(list_filter(tries, lambda t: len(t) > 0)[1], i), ',') AS kept FROM p")
def characters_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters within a span of one, widened where it holds none."""
    lo = (F.col("o_custkey") % 12).cast("int")
    chars = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.struct((q * 3).alias("i")))
    kept = G.characters_between(chars, lo, lo + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(kept, lambda c: c["i"].cast("string")), ",").alias("kept"))


_ADVANCES = "[CASE q % 3 WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 33 END + o_custkey % 7 FOR q IN range(0, 24)]"


@query("natural_layout", f"""WITH RECURSIVE a AS (SELECT o_orderkey, {_ADVANCES} AS v, o_custkey % 3 AS noise FROM orders),
r AS (SELECT o_orderkey, v, noise, 1 AS i, 0 AS row_no, 150.0::DOUBLE AS x, 150.0::DOUBLE + v[1] + noise AS nxt FROM a UNION ALL
  SELECT o_orderkey, v, noise, i + 1, CASE WHEN nxt + v[i + 1] > 600 THEN row_no + 1 ELSE row_no END, CASE WHEN nxt + v[i + 1] > 600 THEN 100.0 ELSE nxt END, CASE WHEN nxt + v[i + 1] > 600 THEN 100.0 ELSE nxt END + v[i + 1] + noise FROM r WHERE i < 24)
SELECT o_orderkey, (i - 1)::INT AS i, row_no, x FROM r""")
def natural_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters set one after the other, wrapped at the right edge."""
    q = F.sequence(F.lit(0), F.lit(23))
    advances = F.transform(q, lambda v: F.when(v % 3 == 0, 40).when(v % 3 == 1, 25).otherwise(33) + F.col("o_custkey") % 7)
    places = G.natural_places(advances, F.transform(q, lambda v: F.col("o_custkey") % 3), 150.0, 100.0, 600.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(places).alias("i", "p")).select("o_orderkey", "i", F.col("p.row").alias("row_no"), "p.x")


@query("fallback_rates", "SELECT conv_id, round(count(*) FILTER (WHERE role = 'user') / count(*), 6) AS rate FROM conversations GROUP BY conv_id")
def fallback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.collect_list(F.when(F.col("role") == "user", "font").otherwise("bank"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sources.alias("s")).select("conv_id", r6(G.fallback_rate(F.col("s"))).alias("rate"))


@query("span_rows", "WITH c AS (SELECT l_orderkey, l_linenumber % 2 AS row_no, l_partkey % 500 + 0.25 AS x0, l_suppkey % 300 AS y0, l_partkey % 500 + l_linenumber * 10.5 AS x1, l_suppkey % 300 + 20 AS y1 FROM lineitem) SELECT l_orderkey, string_agg(row_no || ':' || b, ';' ORDER BY row_no) AS boxes FROM (SELECT l_orderkey, row_no, concat_ws(',', floor(min(x0))::BIGINT, min(y0)::BIGINT, ceil(max(x1))::BIGINT, max(y1)::BIGINT) AS b FROM c GROUP BY ALL) GROUP BY l_orderkey")
def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outward box for each row of a span's characters."""
    d = lambda c: c.cast("double")
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    char = F.struct((F.col("l_linenumber") % 2).alias("row"), F.array(d(x + 0.25), d(y), d(x + F.col("l_linenumber") * 10.5), d(y + 20)).alias("bbox"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(char).alias("c"))
    names = F.array_sort(F.array_distinct(F.transform("c", lambda c: c["row"])))
    both = F.zip_with(names, G.span_boxes(F.col("c")), lambda r, b: F.concat(r.cast("string"), F.lit(":"), F.array_join(F.transform(b, lambda v: v.cast("long").cast("string")), ",")))
    return rows.select("l_orderkey", F.array_join(both, ";").alias("boxes"))


# Smooth fields and settings

_part = lambda kind, v: f"'{kind}:' || length({v}) || ':' || {v} || '|'"


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(sha256({' || '.join(parts)}), 1, 16))::UBIGINT >> 11) / 9007199254740992"


def _signed(*parts: str) -> str:
    return f"(2.0::DOUBLE * {_unit(*parts)} - 1)"


def _field(name: str, amplitude: str, wavelength: str) -> str:
    """SQL of a curve through named values at whole multiples of the wavelength."""
    at = f"(x / ({wavelength}))"
    p = [_signed(_part("str", "who"), _part("str", "step"), _part("str", f"('row:' || row_no || ':control:' || (floor({at})::BIGINT + {k}))"), _part("str", f"'{name}'")) for k in (-1, 0, 1, 2)]
    t = f"({at} - floor({at}))"
    curve = f"0.5::DOUBLE * (2 * {p[1]} + ({p[2]} - {p[0]}) * {t} + (2 * {p[0]} - 5 * {p[1]} + 4 * {p[2]} - {p[3]}) * {t} * {t} + (3 * {p[1]} - {p[0]} - 3 * {p[2]} + {p[3]}) * {t} * {t} * {t})"
    return f"greatest(-({amplitude}), least({amplitude}, ({amplitude}) * ({curve})))"


def _strength(name: str) -> str:
    return _unit(_part("str", "who"), _part("str", "'profile'"), _part("str", f"'{name}'"), _part("str", "'writer-strength'"))


_scaled = lambda name: f"({seeds.DEFAULTS[name]}::DOUBLE * (0.68::DOUBLE + (1.0::DOUBLE - 0.68) * {_strength(name)}))"
_own = lambda what: _signed(_part("str", "who"), _part("str", "step"), _part("int", "char_id"), _part("str", f"'{what}'"))
_wave = f"(420.0::DOUBLE * (1.0 + 0.18::DOUBLE * {_strength('baseline_wavelength_px')}))"
_drift = _field("size-drift-spline", "1.0::DOUBLE", f"greatest(300.0::DOUBLE, {_wave} * 1.2)")


@query("writer_placements", f"""WITH c AS (SELECT o_orderkey, 'pw-' || (o_custkey % 50) AS who, 's' || (o_orderkey % 4 + 1) AS step, (o_orderkey % 30)::VARCHAR AS char_id, o_orderkey % 3 AS row_no, (o_custkey % 1000)::DOUBLE AS x FROM orders)
SELECT o_orderkey, round({_field('baseline-spline', _scaled('baseline_amplitude_px'), _wave)}, 6) AS baseline, round(46.2::DOUBLE * {_scaled('spacing_offset_ratio')} * {_own('spacing-offset')}, 6) AS spacing,
  round(1.0 + {_scaled('size_drift_ratio')} * greatest(-1.0, least(1.0, 0.9::DOUBLE * {_drift} + 0.1::DOUBLE * {_own('size-drift-local')})), 6) AS size, round({_scaled('rotation_degrees')} * {_own('rotation')}, 6) AS rotation FROM c""")
def writer_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a writer's profile moves a character: a smooth field, and shares of the writer's own strengths."""
    rows = table(spark, sf_dir, "orders")
    who, step = F.concat(F.lit("pw-"), (F.col("o_custkey") % 50).cast("string")), F.concat(F.lit("s"), (F.col("o_orderkey") % 4 + 1).cast("string"))
    placed = seeds.placement(seeds.DEFAULTS, who, step, (F.col("o_orderkey") % 30).cast("string"), (F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 1000).cast("double"), F.lit(46.2))
    return rows.withColumn("p", placed).select("o_orderkey", r6("p.baseline_offset_px").alias("baseline"), r6("p.spacing_offset_px").alias("spacing"), r6("p.size_scale").alias("size"), r6("p.rotation_degrees").alias("rotation"))


_SETTINGS = sorted(seeds.DEFAULTS)
_LIMIT = "[" + ", ".join(str(float(seeds.LIMITS.get(k, 300.0))) for k in _SETTINGS) + "]::DOUBLE[]"


@query("validated_settings", f"SELECT n_nationkey, CASE {_SETTINGS!r}[n_nationkey % {len(_SETTINGS)} + 1] WHEN 'elastic_grid_size' THEN n_nationkey // 11 = 1 WHEN 'baseline_wavelength_px' THEN n_nationkey // 11 >= 1 ELSE n_nationkey // 11 <= 1 END AS accepted FROM nation")
def validated_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings are within their bounds: below them, at them, above them."""
    found = []
    for (key,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # settings are the driver's
        name = _SETTINGS[key % len(_SETTINGS)]
        value = seeds.LIMITS.get(name, seeds.LIMITS["baseline_min_wavelength_px"]) * (0.5, 1, 1.5)[key // 11]
        try:
            seeds.validate_settings({name: value})
            found.append((key, True))
        except ValueError:
            found.append((key, False))
    return spark.createDataFrame(found, "n_nationkey int, accepted boolean")


# Gates, audits, records


@query("gate_one", f"""WITH {E.generated()} SELECT idx, CASE idx % 5 WHEN 1 THEN 'G1a: the answer is not the key' WHEN 2 THEN 'G1b: numbers of the problem text differ' WHEN 3 THEN 'G1a: the answer does not solve the problem; G1a: the answer is not the key' WHEN 4 THEN 'G1b: numbers of s3 differ' ELSE '' END AS reasons FROM s""")
def gate_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate on problems that are spoilt in four ways."""
    made = _made(spark, sf_dir)  # its number of problems
    n = made.where(F.size("injected_errors") > 0).count()
    rows = programs.problems(spark, n, E.SEED)
    k = F.col("idx") % 5
    rows = rows.withColumn("answer_key", F.when(k == 1, "0/0").otherwise(F.col("answer_key"))).withColumn("problem_text", F.when(k == 2, F.concat("problem_text", F.lit(" 99"))).otherwise(F.col("problem_text")))
    gold, answer = programs.execute()
    rows = rows.withColumn("gold", gold).withColumn("answer", answer)
    rows = rows.withColumn("answer", F.struct(F.when(k == 3, F.col("answer.num") + F.col("answer.den")).otherwise(F.col("answer.num")).alias("num"), F.col("answer.den").alias("den")))
    spoilt = F.transform("gold", lambda s: s.withField("numbers", F.when((k == 4) & (s["step_id"] == "s3"), F.array(F.lit("777"))).otherwise(s["numbers"])))
    return programs.gate_one(rows.withColumn("gold", spoilt)).select("idx", F.array_join("g1_reasons", "; ").alias("reasons"))


@query("required_steps", f"WITH {E.generated()} SELECT sample_id, gold[idx % 4 + 1] AS latex FROM rec UNION ALL SELECT '<missing>', 'no step s9' FROM n")
def required_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notation of a step that must be there, and what is raised where it is not."""
    rows = _records(spark, sf_dir)
    at = F.concat(F.lit("s"), (_k() % 4 + 1).cast("string"))
    try:
        rows.select(programs.required_step(F.col("gold_solution"), F.lit("s9"))).limit(1).collect()
        said = ""
    except Exception as e:  # the job's error
        said = "no step s9" if "no step s9" in str(e) else str(e)
    return rows.select("sample_id", programs.required_step(F.col("gold_solution"), at).alias("latex")).unionByName(spark.createDataFrame([("<missing>", said)], "sample_id string, latex string"))


@query("payload_dropped", f"WITH {E.generated()} SELECT sample_id, op AS operator, false AS payload FROM rec WHERE NOT control")
def payload_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where(F.size("injected_errors") > 0)
    private = rows.withColumn("injected_errors", F.transform("injected_errors", lambda e: e.withField("_payload", F.lit("secret"))))
    out = dataset.without_payload(private)
    kept = "_payload" in out.schema["injected_errors"].dataType.elementType.fieldNames()
    return out.select("sample_id", F.get("injected_errors", 0)["operator"].alias("operator"), F.lit(kept).alias("payload"))


@query("page_steps", f"WITH {E.generated()} SELECT sample_id, array_to_string(CASE WHEN control THEN gold ELSE mutant END, ' | ') AS steps FROM rec")
def page_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("sample_id", F.array_join(F.transform(layout.steps_on_page(), lambda s: s["text"]), " | ").alias("steps"))


@query("error_boxes", f"WITH {E.generated()} SELECT sample_id, 100 + idx % 300 AS x0, 200 + idx % 200 AS y0, 220 + idx % 300 AS x1, 244 + idx % 200 AS y1 FROM rec WHERE NOT control")
def error_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each error: the union of its span's boxes, by reference or place."""
    from labelframe.operators import metrics

    rows = _boxed(_records(spark, sf_dir)).where(F.size("injected_errors") > 0).select("sample_id", F.get(metrics.error_boxes(), 0).alias("b"))
    return rows.select("sample_id", *(F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


_GLYPHS = "SELECT substr(text, 1, 1) AS char, lang AS family, source AS path, doc_id AS record_index, source || '/' || (doc_id % 5) AS writer FROM documents WHERE text <> ''"
_INDEX = f"SELECT *, row_number() OVER (PARTITION BY char ORDER BY family, path, record_index) - 1 AS slot FROM ({_GLYPHS})"


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text <> ''")
    return rows.select(F.substring("text", 1, 1).alias("char"), F.col("lang").alias("family"), F.col("source").alias("path"), F.col("doc_id").alias("record_index"), F.concat("source", F.lit("/"), (F.col("doc_id") % 5).cast("string")).alias("writer"))


@query("glyph_index", f"SELECT char, slot, family, path, record_index, writer FROM ({_INDEX})")
def glyph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.glyph_index(_glyphs(spark, sf_dir))


@query("glyph_summary", f"SELECT family, count(*) AS n_glyphs, count(DISTINCT char) AS n_chars, count(DISTINCT writer) AS n_writers FROM ({_GLYPHS}) GROUP BY family")
def glyph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.glyph_summary(audit.glyph_index(_glyphs(spark, sf_dir)))


_WANTED = "SELECT s_suppkey, 'w' || (s_suppkey % 37) AS pseudo, chr((65 + s_suppkey % 40)::INT) AS want FROM supplier"
_DIGEST = "sha256('writer:' || length(pseudo) || ':' || pseudo || '|char:' || length(want) || ':' || want)"


@query("picked_glyphs", f"WITH i AS ({_INDEX}), k AS (SELECT char, count(*) AS n FROM i GROUP BY char), w AS (SELECT *, (('0x' || substr({_DIGEST}, 1, 16))::UBIGINT % n)::BIGINT AS slot FROM ({_WANTED}) t LEFT JOIN k ON k.char = want) SELECT w.s_suppkey, want, i.family, i.path, i.record_index FROM w LEFT JOIN i ON i.char = want AND i.slot = w.slot")
def picked_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glyph that the hash of writer and character picks; none for characters that no text begins with."""
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("w"), (F.col("s_suppkey") % 37).cast("string")).alias("pseudo"), F.char((65 + F.col("s_suppkey") % 40).cast("long")).alias("want"))
    return audit.picked_glyphs(wanted, audit.glyph_index(_glyphs(spark, sf_dir)), "pseudo", "want").select("s_suppkey", "want", "family", "path", "record_index")


# The simulation against its closed form


@query("kpi_simulated", "WITH g AS (SELECT t.v AS tpr, a.v AS type_accuracy, s.v AS severity_accuracy FROM (SELECT unnest([0.75, 0.80, 0.85, 0.90, 0.93, 0.95, 0.97]::DOUBLE[]) AS v) t, (SELECT unnest([0.80, 0.90, 0.95]::DOUBLE[]) AS v) a, (SELECT unnest([0.80, 0.90, 0.95]::DOUBLE[]) AS v) s) SELECT *, true AS near FROM g")
def kpi_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 20,000 trials a cell come within five standard deviations of the closed form."""
    grid = probe.kpi_grid(spark)
    keys = ["tpr", "type_accuracy", "severity_accuracy"]
    both = probe.kpi_simulated(grid, 20_000, 7).join(grid, keys)
    return both.select(*keys, (F.abs(F.col("rate") - F.col("independent")) < 5 * F.sqrt(F.col("independent") * (1 - F.col("independent")) / 20_000)).alias("near"))
