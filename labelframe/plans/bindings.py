"""Driver queries: each library operator applied to whole tables of the star schema, beside SQL for the same result.

``QUERIES`` maps names to functions of (spark, sf_dir), ``ORACLES`` to DuckDB SQL. Doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import numbers as N
from labelframe.functions import parsing, seeds
from labelframe.functions import text as T
from labelframe.operators import audit, dataset, metrics, probe, programs, relabel, splits
from labelframe.plans.registry import ORACLES, QUERIES, query as _query, r6, table as _table  # noqa: F401
from labelframe.sources import fixed, generators, records

# Evaluation


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule's finding: marks of junk in the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").rlike("###|%%%|!!|[|]").alias("detected"))
    return _table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("has_error", F.col("quality") == 0)


_JUDGED = "SELECT l.*, d.lang, d.source, d.n_chars, regexp_matches(d.text, '###|%%%|!!|[|]') AS detected, l.quality = 0 AS has_error FROM labels l JOIN documents d USING (doc_id)"
_RATES = "avg(CASE WHEN has_error THEN detected::INT END) AS tpr, avg(CASE WHEN NOT has_error THEN (NOT detected)::INT END) AS tnr"


@_query("eval_summary", f"WITH j AS ({_JUDGED}), r AS (SELECT {_RATES}, count(*) FILTER (WHERE has_error) AS e, count(*) FILTER (WHERE NOT has_error) AS c FROM j) SELECT round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS bacc, round(1 - tnr, 6) AS hallucinated_error_rate, e AS n_error_records, c AS n_control_records FROM r")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.detection_summary(_judged(spark, sf_dir), F.col("has_error"), F.col("detected"))
    return out.select(r6("tpr").alias("tpr"), r6("tnr").alias("tnr"), r6("bacc").alias("bacc"), r6("hallucinated_error_rate").alias("hallucinated_error_rate"), "n_error_records", "n_control_records")


@_query("eval_summary_by_language", f"WITH j AS ({_JUDGED}), r AS (SELECT lang, {_RATES}, count(*) FILTER (WHERE has_error) AS e FROM j GROUP BY lang) SELECT lang, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS bacc, e AS n_error_records FROM r")
def eval_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.detection_summary(_judged(spark, sf_dir), F.col("has_error"), F.col("detected"), ["lang"])
    return out.select("lang", r6("tpr").alias("tpr"), r6("tnr").alias("tnr"), r6("bacc").alias("bacc"), "n_error_records")


@_query("eval_per_class", f"WITH j AS ({_JUDGED}) SELECT lang AS class, count(*) AS n, round(avg((detected = has_error)::INT), 6) AS accuracy FROM j GROUP BY lang")
def eval_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_class(_judged(spark, sf_dir), "lang", F.col("detected") == F.col("has_error"))
    return out.select("class", "n", r6("accuracy").alias("accuracy"))


@_query("eval_macro", f"WITH j AS ({_JUDGED}), c AS (SELECT lang, avg((detected = has_error)::INT) AS a FROM j GROUP BY lang) SELECT round(avg(a), 6) AS macro, count(*) AS n_classes FROM c")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.macro(_judged(spark, sf_dir), "lang", F.col("detected") == F.col("has_error"))
    return out.select(r6("type_macro_exact_match").alias("macro"), F.size("type_exact_match_by_class").cast("long").alias("n_classes"))


_KINDS = "CASE lang WHEN 'en' THEN '移項' WHEN 'de' THEN '符号・乗算' WHEN 'fr' THEN '概念/移項' ELSE '計算/加減' END"
_SAID = "CASE length(source) % 2 * 3 + n_chars % 3 WHEN 0 THEN '移項' WHEN 1 THEN '概念/移項' WHEN 2 THEN '計算/符号' WHEN 3 THEN '符号・乗算' WHEN 4 THEN '記法/移項符号' ELSE '計算/加減' END"
_FAMILY = "CASE said WHEN '概念/移項' THEN '移項' WHEN '記法/移項符号' THEN '移項' WHEN '概念/符号・乗算' THEN '符号・乗算' WHEN '計算/符号' THEN '符号・乗算' END"


@_query("eval_threeway_types", f"WITH t AS (SELECT {_KINDS} AS kind, {_SAID} AS said FROM documents), h AS (SELECT kind, kind IN ('移項', '符号・乗算') AND coalesce({_FAMILY} = kind, false) AS over, said = kind AS same FROM t) SELECT kind AS type, count(*) AS n, count(*) FILTER (WHERE same AND NOT over) AS n_exact, count(*) FILTER (WHERE over) AS n_over_claim FROM h GROUP BY kind")
def eval_threeway(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.expr(_KINDS).alias("kind"), F.expr(_SAID).alias("said"))
    hits = rows.select(F.explode(metrics.type_hits(F.col("kind"), F.array("said"), F.lit(False), F.lit(False))).alias("h")).select("h.*")
    return hits.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("n_exact"), F.count_if("over_claim").alias("n_over_claim"))


@_query("eval_coarsened_types", f"WITH t AS (SELECT {_KINDS} AS kind, {_SAID} AS said FROM documents), h AS (SELECT kind, CASE WHEN kind IN ('移項', '符号・乗算') THEN coalesce({_FAMILY}, said) ELSE said END = kind AS same FROM t) SELECT kind AS type, count(*) FILTER (WHERE same) AS n_exact, 0::BIGINT AS n_over_claim FROM h GROUP BY kind")
def eval_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.expr(_KINDS).alias("kind"), F.expr(_SAID).alias("said"))
    hits = rows.select(F.explode(metrics.type_hits(F.col("kind"), F.array("said"), F.lit(False), F.lit(False), coarsen=True)).alias("h")).select("h.*")
    return hits.groupBy("type").agg(F.count_if("exact_match").alias("n_exact"), F.count_if("over_claim").alias("n_over_claim"))


@_query("before_after", f"WITH j AS ({_JUDGED}), b AS (SELECT avg(CASE WHEN has_error THEN detected::INT END) AS tpr, avg(CASE WHEN NOT has_error THEN (NOT detected)::INT END) AS tnr FROM j), a AS (SELECT avg(CASE WHEN has_error THEN (n_chars < 1000)::INT END) AS tpr, avg(CASE WHEN NOT has_error THEN (n_chars >= 1000)::INT END) AS tnr FROM j) SELECT m AS metric, round(x, 6) AS before, round(y, 6) AS after, round(y - x, 6) AS change FROM (SELECT 'tpr' AS m, b.tpr AS x, a.tpr AS y FROM b, a UNION ALL SELECT 'tnr', b.tnr, a.tnr FROM b, a)")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    one, two = (metrics.long(metrics.detection_summary(rows, F.col("has_error"), found).select("tpr", "tnr")) for found in (F.col("detected"), F.col("n_chars") < 1000))
    return metrics.before_after(one, two).select("metric", *(r6(c).alias(c) for c in ("before", "after", "change")))


@_query("skip_reasons", "SELECT CASE WHEN d.text IS NULL OR d.text = '' THEN 'missing_text' WHEN l.doc_id IS NULL THEN 'missing_label' ELSE '<none>' END AS value, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    reason = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "missing_text").when(F.col("known").isNull(), "missing_label")
    return dataset.distribution(docs.join(labels, "doc_id", "left"), reason)


@_query("relabel_lookup", "SELECT l.doc_id, d.lang, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def relabel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return relabel.attach(_table(spark, sf_dir, "labels"), names, "doc_id", F.lit(True)).select("doc_id", "lang", "source", "quality")


@_query("relabel_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def relabel_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.missing(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("observational_equivalence", r"WITH p AS (SELECT d.source, d.text AS a, e.text AS b FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id - 1) SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_replace(a, '\s', '', 'g') = regexp_replace(b, '\s', '', 'g')) AS n_equal, round(avg(coalesce((regexp_replace(a, '\s', '', 'g') = regexp_replace(b, '\s', '', 'g'))::INT, 0)), 6) AS rho FROM p GROUP BY source")
def observational_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those of the id before; digests of the surfaces travel instead of texts."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.without_spaces(F.col("text")).cast("binary"), 256).alias("a"))
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b"))
    return relabel.equivalence_rate(rows.join(before, "doc_id", "left"), "source", F.col("a"), F.col("b")).withColumn("rho", r6("rho"))


# Text

_ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"


def _ascii(c: str):
    return F.regexp_replace(F.col(c), r"[^\x00-\x7F]", "")


@_query("cer_next_item", f"WITH p AS (SELECT item_id, {_ASCII_SQL} AS a, lead({_ASCII_SQL}) OVER (ORDER BY item_id) AS b FROM benchmark) SELECT item_id, levenshtein(a, b)::BIGINT AS distance, round(levenshtein(a, b) / length(a), 6) AS cer FROM p WHERE b IS NOT NULL AND length(a) > 0")
def cer_next_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", _ascii("text").alias("a"))
    # ids are consecutive keys of a small fixed table; a join on the rank needs no window over one partition
    ranked = records.with_ordinal(items.select(F.lit("benchmark").alias("file"), (F.col("item_id") + 1).alias("line"), "item_id", "a"))
    after = ranked.select((F.col("ordinal") - 1).alias("ordinal"), F.col("a").alias("b"))
    return ranked.join(after, "ordinal").where(F.length("a") > 0).select("item_id", F.levenshtein("a", "b").cast("long").alias("distance"), r6(T.cer(F.col("a"), F.col("b"))).alias("cer"))


@_query("nearest_line", f"WITH l AS (SELECT item_id, string_split({_ASCII_SQL}, chr(10)) AS ls FROM benchmark), u AS (SELECT item_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, ls[1] AS gold, ls[-1] AS mutant FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY least(levenshtein(line, gold), levenshtein(line, mutant)), i) AS k FROM u WHERE line <> '') SELECT item_id, line AS nearest, gold <> mutant AND levenshtein(line, gold) < levenshtein(line, mutant) AS over_corrected FROM r WHERE k = 1")
def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select("item_id", T.lines(_ascii("text")).alias("ls"))
    gold, mutant = F.get("ls", 0), F.try_element_at("ls", F.lit(-1))
    return rows.select("item_id", T.nearest_line(F.col("ls"), gold, mutant).alias("nearest"), T.over_corrected(F.col("ls"), gold, mutant).alias("over_corrected")).where("nearest is not null")


_NUMS = r"regexp_extract_all(text, '-?\d+')"


@_query("first_repeated_number", f"WITH t AS (SELECT doc_id, {_NUMS} AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k FROM u), m AS (SELECT doc_id, min(i) AS i FROM r WHERE k = 2 GROUP BY doc_id) SELECT t.doc_id, len(t.ts)::BIGINT AS n_numbers, (m.i - 1)::BIGINT AS first_excess FROM t LEFT JOIN m USING (doc_id)")
def first_repeated_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.number_tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_numbers"), T.first_excess(F.col("ts"), F.array_distinct("ts")).cast("long").alias("first_excess"))


@_query("ordered_numbers", f"WITH t AS (SELECT doc_id, {_NUMS} AS ts FROM documents), u AS (SELECT doc_id, ts, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM t WHERE len(ts) > 1), f AS (SELECT doc_id, min(i) FILTER (WHERE t = ts[2]) AS first_of, max(i) FILTER (WHERE t = ts[1]) AS last_of FROM u GROUP BY doc_id) SELECT doc_id, coalesce(last_of > first_of, false) AS in_order FROM f")
def ordered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.number_tokens(F.col("text")).alias("ts")).where(F.size("ts") > 1)
    return rows.select("doc_id", T.is_subsequence(F.array(F.get("ts", 1), F.get("ts", 0)), F.col("ts")).alias("in_order"))


@_query("normalised_lengths", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS n FROM documents")
def normalised_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(T.without_spaces(F.col("text"))).cast("long").alias("n"))


_RAW = "CASE event_id % 5 WHEN 0 THEN {body} WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```') WHEN 2 THEN concat('answer: ', {body}, ' done') WHEN 3 THEN substr({body}, 1, 20) ELSE '[1]' END"
_BODY = """concat('{{"transcript":"', event_type, '","errors":[],"score":', event_id % 11, '}}')"""


@_query("robust_json", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_type END AS transcript, CASE WHEN event_id % 5 < 3 THEN event_id % 11 END AS score, event_id % 5 >= 3 AS failed FROM events")
def robust_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("raw", F.expr(_RAW.format(body=_BODY.format())))
    rows = rows.withColumn("out", parsing.parse_output(F.col("raw"), F.lit(1000), F.lit(1000)))
    return rows.select("event_id", "out.transcript", "out.score", F.col("out.failure").isNotNull().alias("failed"))


@_query("contract_reasons", "SELECT CASE event_id % 5 WHEN 0 THEN 'bad json' WHEN 1 THEN 'not an object' WHEN 2 THEN 'blank' WHEN 3 THEN 'no sample_id' ELSE '<none>' END AS value, count(*) AS n FROM events GROUP BY ALL")
def contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE event_id % 5 WHEN 0 THEN concat(props, ' junk') WHEN 1 THEN '[1,2]' WHEN 2 THEN '  ' WHEN 3 THEN props ELSE concat('{\"sample_id\":\"', event_id, '\"}') END")
    lines = _table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), value.alias("value"))
    return dataset.distribution(records.checked_lines(lines, records.RELABEL), F.col("reason"))


@_query("expressions", "SELECT l_orderkey, l_linenumber, ((l_partkey % 20 + l_suppkey % 7) * (-l_linenumber))::BIGINT AS value, concat('(', l_partkey % 20, ' + ', l_suppkey % 7, ') × -', l_linenumber) AS canonical FROM lineitem")
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("concat('($', l_partkey % 20, '+', l_suppkey % 7, '$)×- ', l_linenumber)").alias("t"))
    return rows.withColumn("e", parsing.expression("t")).select("l_orderkey", "l_linenumber", "e.value", "e.canonical")


# Geometry

_BOX = "l_partkey % 500 AS x0, l_suppkey % 300 AS y0, l_partkey % 500 + l_quantity::BIGINT * 10 AS x1, l_suppkey % 300 + l_linenumber * 40 AS y1"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    box = F.array(d(x0), d(y0), d(x0 + F.col("l_quantity").cast("long") * 10), d(y0 + F.col("l_linenumber") * 40))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))


@_query("best_iou", f"WITH b AS (SELECT l_orderkey AS o, l_linenumber % 2 AS k, {_BOX} FROM lineitem), p AS (SELECT p.o, greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS s FROM b p JOIN b t ON p.o = t.o AND p.k = 1 AND t.k = 0), m AS (SELECT o, max(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END) AS best FROM p GROUP BY o) SELECT DISTINCT b.o AS l_orderkey, round(coalesce(m.best, 0), 6) AS best_iou FROM b LEFT JOIN m USING (o)")
def best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    rows = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.when(odd, F.col("box"))).alias("p"), F.collect_list(F.when(~odd, F.col("box"))).alias("t"))
    return rows.select("l_orderkey", r6(G.best_iou(F.col("p"), F.col("t"))).alias("best_iou"))


@_query("relative_boxes", f"WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem) SELECT l_orderkey, l_linenumber, greatest(0, least(1000, round_even(x0 * 1000.0 / 1240, 0)))::INT AS r0, greatest(0, least(1000, round_even(y0 * 1000.0 / 700, 0)))::INT AS r1, greatest(0, least(1000, round_even(x1 * 1000.0 / 1240, 0)))::INT AS r2, greatest(0, least(1000, round_even(y1 * 1000.0 / 700, 0)))::INT AS r3 FROM b")
def relative_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.relative(F.col("box"), F.lit(1240), F.lit(700))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", *(r[i].alias(f"r{i}") for i in range(4)))


@_query("box_unions", f"WITH b AS (SELECT l_orderkey, {_BOX} FROM lineitem) SELECT l_orderkey, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM b GROUP BY l_orderkey")
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(G.union_of(F.col("box")).alias("u"))
    return rows.select("l_orderkey", *(F.col("u")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@_query("clamped_boxes", f"WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem), c AS (SELECT *, least(400, x0) AS a0, least(200, y0) AS a1, least(400, x1) AS a2, least(200, y1) AS a3 FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN a2 > a0 AND a3 > a1 THEN a0 END::DOUBLE AS c0, CASE WHEN a2 > a0 AND a3 > a1 THEN a1 END::DOUBLE AS c1, CASE WHEN a2 > a0 AND a3 > a1 THEN a2 END::DOUBLE AS c2, CASE WHEN a2 > a0 AND a3 > a1 THEN a3 END::DOUBLE AS c3 FROM c")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.sanitize(F.col("box"), F.lit(400.0), F.lit(200.0))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c[i].alias(f"c{i}") for i in range(4)))


@_query("grid_layout", "SELECT o_orderkey, (o_custkey // 23)::INT AS row_no, (o_custkey % 23)::INT AS column_no, round((90 + o_custkey % 23 * 44.1)::DOUBLE, 6) AS x, round((120.0 + (o_custkey // 23) * 80)::DOUBLE, 6) AS y FROM orders")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.grid_place(F.col("o_custkey"), F.lit(23), F.lit(90.0), F.lit(120.0), F.lit(44.1), F.lit(80.0))
    return _table(spark, sf_dir, "orders").select("o_orderkey", p["row"].alias("row_no"), p["column"].alias("column_no"), r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


# Programs and relabelling

_A = "CASE l_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN -2 ELSE -3 END AS x"
_B = "CASE WHEN l_suppkey % 18 < 9 THEN l_suppkey % 18 - 9 ELSE l_suppkey % 18 - 8 END AS y"
_C = "l_orderkey % 41 - 20 AS z"
_PARAMS = f"l_orderkey, l_linenumber, {_A}, {_B}, {_C}"
_PAREN = "CASE WHEN {0} < 0 THEN concat('(', {0}, ')') ELSE concat('', {0}) END"


def _params(spark: SparkSession, sf_dir: str, domain: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", _A, _B, _C)
    return rows.withColumn("domain", F.lit(domain)).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


_ROOT = "CASE WHEN (CASE WHEN x < 0 THEN -1 ELSE 1 END * x) // greatest(1, gcd(n, x)) = 1 THEN concat('', n * CASE WHEN x < 0 THEN -1 ELSE 1 END // greatest(1, gcd(n, x))) ELSE concat(n * CASE WHEN x < 0 THEN -1 ELSE 1 END // greatest(1, gcd(n, x)), '/', CASE WHEN x < 0 THEN -1 ELSE 1 END * x // greatest(1, gcd(n, x))) END"


@_query("linear_programs", f"WITH p AS (SELECT {_PARAMS} FROM lineitem), q AS (SELECT *, z - y AS n FROM p) SELECT l_orderkey, l_linenumber, concat(x, 'x ', CASE WHEN y > 0 THEN '+' ELSE '-' END, ' ', abs(y), ' = ', z) AS s1, concat(x, 'x = ', z, CASE WHEN y > 0 THEN ' - ' ELSE ' + ' END, abs(y)) AS s2, concat(x, 'x = ', n) AS s3, concat('x = ', {_ROOT}) AS s4 FROM q")
def linear_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, _ = programs.execute()
    rows = _params(spark, sf_dir, programs.LINEAR).withColumn("steps", steps)
    return rows.select("l_orderkey", "l_linenumber", *(F.col("steps")[i]["text"].alias(f"s{i + 1}") for i in range(4)))


@_query("arithmetic_mutants", f"WITH p AS (SELECT {_PARAMS} FROM lineitem) SELECT l_orderkey, l_linenumber, concat(x, ' + ', {_PAREN.format('y')}, ' = ', x + y) AS s2, concat({_PAREN.format('(x + y)')}, ' × ', {_PAREN.format('z')}, ' = ', (x + y) * z) AS s3, concat('答え ', (x + y) * z) AS s4, (x + y) * z = x + y * z AS final_ok FROM p")
def arithmetic_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    mutation = F.struct(F.lit("op-order-of-ops").alias("operator"), F.lit("s2").alias("site"), F.lit("概念/演算順序").alias("type"), F.lit(3).alias("severity"), *(F.lit(None).cast(t).alias(n) for n, t in (("delta", "int"), ("kind", "string"), ("value", "bigint"), ("tokens", "array<bigint>"), ("canonical", "string")))).cast(programs.MUTATION)
    steps, answer = programs.execute(mutation)
    gold = programs.execute()[1]
    rows = _params(spark, sf_dir, programs.ARITH).withColumn("steps", steps).withColumn("ok", answer["num"] == gold["num"])
    return rows.select("l_orderkey", "l_linenumber", *(F.col("steps")[i]["text"].alias(f"s{i + 1}") for i in (1, 2, 3)), F.col("ok").alias("final_ok"))


@_query("gate_two", f"WITH p AS (SELECT {_PARAMS} FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN y * z < 0 THEN 0 ELSE 2 END AS n_reasons FROM p")
def gate_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped sign: it changes nothing where the product is not negative, which the gate reports (no change, so no sound span)."""
    mutation = F.struct(F.lit("op-mult-sign-drop").alias("operator"), F.lit("s2").alias("site"), F.lit("計算/符号").alias("type"), F.lit(2).alias("severity"), *(F.lit(None).cast(t).alias(n) for n, t in (("delta", "int"), ("kind", "string"), ("value", "bigint"), ("tokens", "array<bigint>"), ("canonical", "string")))).cast(programs.MUTATION)
    site = F.lit("s2")

    def reasons(made: Column) -> Column:
        gold, mutant = made["gold"], made["mutant"]
        same = programs.step_text(gold, site) == programs.step_text(mutant, site)
        span = F.when(same, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        return programs.gate_two(gold, mutant, mutant, site, programs.affected_steps(site, gold, mutant), span)

    # bound: the gate uses each program in many places, and Catalyst would put the whole program into each
    made = F.struct(programs.execute()[0].alias("gold"), programs.execute(mutation)[0].alias("mutant"))
    return _params(spark, sf_dir, programs.ARITH).select("l_orderkey", "l_linenumber", F.size(N.bind(made, reasons)).alias("n_reasons"))


@_query("rubric_points", "WITH w AS (SELECT l_orderkey, l_linenumber, 2 + l_linenumber % 2 AS a, 3 + l_partkey % 3 AS b, 4 AS c, l_suppkey % 4 AS site, l_quantity::INT % 2 = 0 AS ok FROM lineitem) SELECT l_orderkey, l_linenumber, (CASE WHEN site = 0 THEN 0 ELSE a END + (b * (CASE WHEN site <= 1 THEN 0 WHEN site = 2 THEN 1 ELSE 2 END)) // 2 + CASE WHEN ok THEN c ELSE 0 END)::INT AS points FROM w")
def rubric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    n = F.col("l_suppkey") % 4
    site = F.concat(F.lit("s"), (n + 1).cast("string"))
    later = F.filter(F.array(*map(F.lit, ("s2", "s3", "s4"))), lambda i: i > site)
    points = programs.awarded([2 + F.col("l_linenumber") % 2, 3 + F.col("l_partkey") % 3, F.lit(4)], site, later, F.col("l_quantity").cast("int") % 2 == 0)
    return rows.select("l_orderkey", "l_linenumber", points.alias("points"))


_SIGNED = "concat(l_linenumber, 'x = ', l_partkey % 30 - 15, CASE WHEN l_suppkey % 3 = 0 THEN ' + ' WHEN l_suppkey % 3 = 1 THEN ' - ' ELSE ' × ' END, l_quantity::INT)"


@_query("flipped_signs", r"WITH e AS (SELECT l_orderkey, l_linenumber, " + _SIGNED + r" AS t FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN contains(t, ' + ') THEN replace(t, ' + ', ' - ') WHEN contains(t, ' - ') THEN replace(t, ' - ', ' + ') END AS flipped FROM e")
def flipped_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SIGNED.replace("l_quantity::INT", "cast(l_quantity as int)")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", T.flip_last_binary_sign(F.col("t")).alias("flipped"))


_Q, _R = "(l_partkey % 9 - 4)", "(l_suppkey % 9 - 4)"
_MV = f"CASE l_linenumber % 3 WHEN 0 THEN abs({_Q} * {_R}) WHEN 1 THEN {_Q} * {_R} + 1 ELSE {_Q} * {_R} - 7 END"


@_query("relabelled_products", f"WITH p AS (SELECT l_orderkey, l_linenumber, {_Q} * {_R} AS product, {_MV} AS mv FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN product < 0 AND mv = abs(product) THEN '符号・乗算' WHEN product > 0 THEN '符号・乗算' ELSE '概念/符号・乗算' END AS type_identifiable, CASE WHEN product < 0 AND mv = abs(product) THEN 'negative_equivalent' WHEN product > 0 THEN 'positive_false_identifiable' ELSE 'subtype_retained' END AS bucket, abs(mv - product) IN (1, 2) AS ambiguous_cross_family, CASE WHEN product = 0 THEN 'product of zero' END AS reject FROM p")
def relabelled_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"concat('(', {_Q}, ') × (', {_R}, ') = ', {_Q} * {_R})").alias("gold"), F.expr(f"concat('(', {_Q}, ') × (', {_R}, ') = ', {_MV})").alias("mutant"))
    out = relabel.relabelled(F.lit("op-llm-product-misconception"), F.lit("概念/符号・乗算"), F.lit("s2"), F.col("gold"), F.col("mutant"), F.lit(programs.ARITH))
    return rows.withColumn("r", out).select("l_orderkey", "l_linenumber", "r.type_identifiable", "r.bucket", "r.ambiguous_cross_family", "r.reject")


@_query("collection_plan_blocks", "SELECT * FROM (VALUES ('書き写し', '字形供給', 300, 20), ('書き写し', '評価専用', 600, 40), ('公平性', '評価専用', 330, 30), ('自力解答', '定性インベントリ(レンダラ校正)', 120, 30)) t(block, purpose, n_pages, n_writers)")
def collection_plan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = generators.collection_plan(spark)
    return plan.groupBy("block", "purpose").agg(F.count_distinct("page_id").cast("int").alias("n_pages"), F.count_distinct("writer_id").cast("int").alias("n_writers"))


@_query("kpi_grid", "WITH g AS (SELECT t.v AS tpr, a.v AS type_accuracy, s.v AS severity_accuracy FROM (SELECT unnest([0.75, 0.80, 0.85, 0.90, 0.93, 0.95, 0.97]::DOUBLE[]) AS v) t, (SELECT unnest([0.80, 0.90, 0.95]::DOUBLE[]) AS v) a, (SELECT unnest([0.80, 0.90, 0.95]::DOUBLE[]) AS v) s), p AS (SELECT *, tpr * type_accuracy * severity_accuracy AS i, greatest(0, (tpr - 0.5::DOUBLE) / 0.5) * greatest(0, (type_accuracy - 0.5::DOUBLE) / 0.5) * greatest(0, (severity_accuracy - 0.5::DOUBLE) / 0.5) AS c FROM g) SELECT tpr, type_accuracy, severity_accuracy, round(0.3 * 0.95 + 0.7 * (i + i * i) / 2, 6) AS independent, round(0.3 * 0.95 + 0.7 * (0.5 + 0.5 * (c + c * c) / 2), 6) AS correlated FROM p")
def kpi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.kpi_grid(spark).withColumns({c: r6(c) for c in ("independent", "correlated")})


# Splits, order, windows


@_query("split_isolated", "WITH g AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id FROM g ORDER BY sha256('11|' || conv_id), conv_id LIMIT 20), r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('5|' || conv_id), conv_id) AS i, count(*) OVER () AS n FROM g WHERE conv_id NOT IN (SELECT conv_id FROM k)) SELECT c.conv_id, c.turn, CASE WHEN k.conv_id IS NOT NULL THEN 'test' WHEN r.i <= round_even(r.n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id LEFT JOIN r ON r.conv_id = c.conv_id")
def split_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    test = splits.sample(rows.select("conv_id").distinct(), "conv_id", 20, 11)
    return splits.split_groups(rows, "conv_id", 0.1, 5, test).select("conv_id", "turn", "split")


@_query("split_shared_groups", "SELECT conv_id, count(DISTINCT role) AS n_parts FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 1")
def split_shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shared_keys(_table(spark, sf_dir, "conversations"), "conv_id", "role")


@_query("split_stats", "SELECT lang AS split, count(*) AS records, count(DISTINCT source) AS pairs, count(*) FILTER (WHERE n_chars >= 1000) AS error_records, count(*) FILTER (WHERE n_chars < 1000) AS control_records, round(count(*) FILTER (WHERE n_chars >= 1000) / nullif(count(*) FILTER (WHERE n_chars < 1000), 0), 6) AS error_to_control_ratio FROM documents GROUP BY GROUPING SETS ((lang), ())")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.split_stats(_table(spark, sf_dir, "documents"), "lang", "source", F.col("n_chars") < 1000)
    return out.withColumnRenamed("lang", "split").withColumn("error_to_control_ratio", r6("error_to_control_ratio"))


@_query("distribution", "SELECT lang, coalesce(CASE WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'good' END, '<none>') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return dataset.distribution(rows, F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good"), ["lang"])


@_query("messages_dataset", "SELECT conv_id, string_agg('- ' || role || ': ' || text, chr(10) ORDER BY turn) AS said, count(*) AS n FROM conversations GROUP BY conv_id")
def messages_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("step_id"), "text")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(steps.alias("steps"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", dataset.solution_text(F.col("steps")).alias("said"), "n")


@_query("dedup_priority", "WITH r AS (SELECT d.doc_id, d.source, d.n_chars, row_number() OVER (PARTITION BY text ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS k FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, source, n_chars FROM r WHERE k = 1")
def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))  # 128 bits name a text
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", text.alias("name"))
    return splits.keep_first(docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left"), "name", [F.desc_nulls_last("quality"), F.col("doc_id")]).select("doc_id", "source", "n_chars")


@_query("run_occurrences", "WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events) SELECT event_id, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS occurrence FROM l")
def run_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.run_occurrences(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "occurrence")


@_query("rollup_counters", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def rollup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return rows.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


# Audits


_COVERED = "WITH p AS (SELECT DISTINCT user_id, event_type FROM events), w AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id), o AS (SELECT count(DISTINCT event_type) AS k FROM events), s AS (SELECT list_sort(list(n)) AS v FROM w)"


@_query("coverage_summary", _COVERED + " SELECT count(*) AS n_writers, sum(n)::BIGINT AS n_pairs, min(n) AS min, (SELECT v[round_even((len(v) - 1) * 0.05, 0)::INT + 1] FROM s) AS p05, median(n)::DOUBLE AS median, round(avg(n), 6) AS mean, (SELECT v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] FROM s) AS p95, max(n) AS max, count(*) FILTER (WHERE n = k) AS n_complete_observed, count(*) FILTER (WHERE n >= 4) AS n_complete_expected, round(sum(n) / (count(*) * any_value(k)), 6) AS density, any_value(k) AS n_observed FROM w, o")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.coverage_summary(_table(spark, sf_dir, "events"), "user_id", "event_type", expected=4)
    return out.withColumns({"mean": r6("mean"), "density": r6("density")})


@_query("coverage_rows", "SELECT source AS writer, count(DISTINCT lang) AS n_classes FROM documents GROUP BY source")
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(_table(spark, sf_dir, "documents"), "source", "lang")


_ROWS_OF = "SELECT l_partkey AS item, l_suppkey AS sheet, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_returnflag = '{}'"


@_query("ranked_match", f"WITH g AS ({_ROWS_OF.format('A')}), b AS ({_ROWS_OF.format('R')}), f AS (SELECT item, min(ord) AS left_order, arg_min(sheet, ord) AS left_sheet FROM g GROUP BY item ORDER BY left_order LIMIT 50), r AS (SELECT f.*, b.ord AS right_order, b.sheet AS right_sheet, row_number() OVER (PARTITION BY f.item ORDER BY b.sheet <> f.left_sheet, b.ord) AS k FROM f JOIN b USING (item)) SELECT item, left_order, left_sheet, right_order, right_sheet FROM r WHERE k = 1")
def ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return audit.matched_samples(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), "item", "sheet", "ord", 50)


_CHARS = r"SELECT unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS char FROM {}"


@_query("char_oov", f"WITH c AS ({_CHARS.format('documents')}), k AS (SELECT DISTINCT char FROM ({_CHARS.format('benchmark')})), n AS (SELECT char, count(*) AS n FROM c WHERE char <> '' GROUP BY char) SELECT char, 'U+' || lpad(upper(to_hex(unicode(char))), 4, '0') AS codepoint, n FROM n WHERE char NOT IN (SELECT char FROM k)")
def char_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = audit.characters(_table(spark, sf_dir, "benchmark"), F.col("text"))
    return audit.out_of_vocabulary(_table(spark, sf_dir, "documents"), F.col("text"), known)[1]


@_query("char_oov_rate", f"WITH c AS ({_CHARS.format('documents')}), k AS (SELECT DISTINCT char FROM ({_CHARS.format('benchmark')})), n AS (SELECT char, count(*) AS n, char NOT IN (SELECT char FROM k) AS oov FROM c WHERE char <> '' GROUP BY char) SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE oov), 0)::BIGINT AS oov_occurrences, round(coalesce(sum(n) FILTER (WHERE oov), 0) / sum(n), 6) AS oov_rate, count(*) FILTER (WHERE oov) AS distinct_oov FROM n")
def char_oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = audit.characters(_table(spark, sf_dir, "benchmark"), F.col("text"))
    return audit.out_of_vocabulary(_table(spark, sf_dir, "documents"), F.col("text"), known)[0].withColumn("oov_rate", r6("oov_rate"))


@_query("charset_families", f"WITH c AS (SELECT DISTINCT lang, unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) AS char FROM documents) SELECT char, string_agg(lang, ',' ORDER BY lang) AS families FROM c WHERE char <> '' GROUP BY char")
def charset_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.split(T.without_spaces(F.col("text")), ""))).alias("char")).where("char <> ''")
    return audit.family_membership(chars, "lang", "char").select("char", F.array_join("families", ",").alias("families"))


@_query("undecodable_classes", "SELECT l_shipdate::DATE AS day, count(*) AS n, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS first_part FROM lineitem WHERE l_quantity > 45 GROUP BY day")
def undecodable_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_quantity") <= 45, "x").alias("char"))
    return audit.undecodable(rows, "day", "char", F.col("ord"), "l_partkey").select("day", "n", F.col("first.l_partkey").alias("first_part"))


# Probe and seeds

_TOLD = r"SELECT doc_id, 1 - quality AS y, regexp_replace(text, '\s', '', 'g') AS t FROM labels JOIN documents USING (doc_id)"
_BAYES = f"WITH d AS ({_TOLD}), g AS (SELECT doc_id, y, unnest([substr(t, i, 2) FOR i IN range(1, length(t))]) AS g FROM d), c AS (SELECT g, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0 FROM g GROUP BY g), n AS (SELECT sum(c1) AS t1, sum(c0) AS t0, count(*) + 1 AS v FROM c), p AS (SELECT count(*) FILTER (WHERE y = 1) AS d1, count(*) FILTER (WHERE y = 0) AS d0 FROM d)"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", (1 - F.col("quality")).alias("y"), T.without_spaces(F.col("text")).alias("t"))


@_query("bigram_top", _BAYES + " SELECT g AS bigram, round(ln((c1 + 1) / (t1 + v)) - ln((c0 + 1) / (t0 + v)), 6) AS log_ratio, c1, c0 FROM c, n WHERE c1 + c0 >= 20 ORDER BY ln((c1 + 1) / (t1 + v)) - ln((c0 + 1) / (t0 + v)) DESC, g DESC LIMIT 8")
def bigram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.top_bigrams(probe.fit_bayes(_told(spark, sf_dir), F.col("t"), "y")).withColumn("log_ratio", r6("log_ratio"))


@_query("bigram_scores", _BAYES + ", s AS (SELECT doc_id, sum(ln((c1 + 1) / (t1 + v)) - ln((c0 + 1) / (t0 + v))) AS s FROM g JOIN c USING (g), n GROUP BY doc_id) SELECT d.doc_id, round(ln(greatest(1, d1)) - ln(greatest(1, d0)) + coalesce(s, 0), 3) AS score FROM d LEFT JOIN s USING (doc_id), p")
def bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir)
    return probe.score_bayes(rows, F.col("t"), "doc_id", probe.fit_bayes(rows, F.col("t"), "y")).withColumn("score", F.round("score", 3))


@_query("auc", f"WITH j AS ({_JUDGED}), r AS (SELECT has_error, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS k FROM j) SELECT round((sum(k) FILTER (WHERE has_error) - count(*) FILTER (WHERE has_error) * (count(*) FILTER (WHERE has_error) + 1) / 2) / (count(*) FILTER (WHERE has_error) * count(*) FILTER (WHERE NOT has_error)), 6) AS auc, count(*) FILTER (WHERE has_error) AS n_pos, count(*) FILTER (WHERE NOT has_error) AS n_neg FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.auc(_judged(spark, sf_dir), "n_chars", F.col("has_error")).withColumn("auc", r6("auc"))


_DIGEST = "sha256('writer:' || length(source) || ':' || source || '|char:' || length(doc_id::VARCHAR) || ':' || doc_id)"


@_query("hash_pick", f"SELECT doc_id, (('0x' || substr({_DIGEST}, 1, 16))::UBIGINT % 40)::INT AS slot, round((('0x' || substr({_DIGEST}, 1, 16))::UBIGINT >> 11) / 9007199254740992, 9) AS unit FROM documents")
def hash_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = seeds.labelled_digest(writer=F.col("source"), char=F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", seeds.pick(digest, F.lit(40)).alias("slot"), F.round(seeds.unit(digest), 9).alias("unit"))


@_query("named_seeds", "SELECT page_id, ('0x' || substr(sha256('str:' || length(url) || ':' || url || '|str:4:page|int:1:7|'), 1, 16))::UBIGINT::DECIMAL(20, 0)::VARCHAR AS seed, 'style-' || substr(sha256(url), 1, 8) AS style_id, 'pw-' || substr(sha256('pseudo-writer:' || url), 1, 16) AS writer FROM pages")
def named_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    digest = seeds.named_digest((url, "str"), "page", 7)
    return _table(spark, sf_dir, "pages").select("page_id", seeds.seed(digest).cast("string").alias("seed"), seeds.style_id(url).alias("style_id"), seeds.pseudo_writer(url).alias("writer"))


@_query("rationals", "WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 61 - 30) AS n, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END * (l_linenumber + 1) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, (sign(d) * n // greatest(1, gcd(n, d)))::BIGINT AS num, (abs(d) // greatest(1, gcd(n, d)))::BIGINT AS den FROM p")
def rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("l_partkey") % 61 - 30, F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1) * (F.col("l_linenumber") + 1)
    return _table(spark, sf_dir, "lineitem").withColumn("r", N.rational(n, d)).select("l_orderkey", "l_linenumber", "r.num", "r.den")


# What the platform gives beyond the operators above


@_query("platform_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def platform_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_query("platform_set_operations", "(SELECT lang FROM documents INTERSECT ALL SELECT CASE WHEN quality = 0 THEN 'en' ELSE 'de' END FROM labels) UNION ALL (SELECT lang FROM documents EXCEPT ALL SELECT 'en' FROM labels)")
def platform_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, labels = _table(spark, sf_dir, "documents").select("lang"), _table(spark, sf_dir, "labels")
    return langs.intersectAll(labels.select(F.when(F.col("quality") == 0, "en").otherwise("de").alias("lang"))).unionAll(langs.exceptAll(labels.select(F.lit("en").alias("lang"))))


@_query("platform_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS quarter FROM events")
def platform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last_three"), F.lead("event_id").over(w).alias("next_event"), F.ntile(4).over(w).alias("quarter"))


@_query("platform_tumbling_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def platform_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@_query("platform_dates", "SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*) AS n, min(o_orderdate::DATE) AS first_day FROM orders GROUP BY ALL")
def platform_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"))


from labelframe.plans import cases, generated, scans  # noqa: E402, F401  (they register their queries)
