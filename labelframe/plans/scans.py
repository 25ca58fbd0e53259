"""Driver queries that write tables as lines or records into a shared folder and scan them back under the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.operators import programs, splits
from labelframe.plans.registry import query, table
from labelframe.sources import fixed, records, services, sinks, staging

# Lines of eight kinds, one file for each type of event

_VALUE = """CASE event_id % 8 WHEN 0 THEN concat(props, ' junk') WHEN 1 THEN '[1,2]' WHEN 2 THEN '  ' WHEN 3 THEN props WHEN 4 THEN concat('{"sample_id":"', event_id, '","text":"t"}')
  WHEN 5 THEN concat('{"sample_id":"same-', CAST(floor(event_id / 100) AS BIGINT), '"}') WHEN 6 THEN '{"sample_id":"","text":"x"}' ELSE '{"sample_id":7,"text":null}' END"""
_LINES = f"v AS (SELECT event_type AS file, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, {_VALUE} AS value FROM events)"
_PARSED = "CASE event_id % 8 WHEN 0 THEN 'bad json' WHEN 1 THEN 'not an object' WHEN 2 THEN 'blank' END"
_TWICE = "event_id % 8 = 5 AND count(*) OVER (PARTITION BY CASE WHEN event_id % 8 = 5 THEN event_id // 100 ELSE -1 - event_id END) > 1"
_NO_TEXT = "CASE WHEN event_id % 8 IN (3, 5, 7) THEN 'no text' END"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, value) of the lines as they stand in the files; ``file``: the event type."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.expr(_VALUE).alias("value"))
    path = staging.folder(spark)
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    lines = records.numbered_lines(spark, path, "*.txt")
    return lines.withColumn("file", F.regexp_extract("file", "event_type=([^/]*)/", 1))


_CONTRACTS = {"relabel": records.RELABEL, "evaluation": records.EVALUATION, "build": records.BUILD, "dataset": records.DATASET, "corpus": records.CORPUS}


@query("scanned_contracts", f"""WITH {_LINES}, r AS (SELECT file, event_id, {_PARSED} AS p, {_NO_TEXT} AS t, CASE WHEN event_id % 8 IN (3, 6, 7) THEN 'no sample_id' WHEN {_TWICE} THEN 'duplicate sample_id' END AS i FROM v)
SELECT 'relabel' AS contract, file, coalesce(p, i, '<none>') AS reason, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT c, file, coalesce(p, '<none>'), count(*) FROM r, (SELECT unnest(['evaluation', 'build']) AS c) GROUP BY ALL
UNION ALL SELECT 'dataset', file, coalesce(p, '<none>'), count(*) FROM r WHERE event_id % 8 <> 2 GROUP BY ALL UNION ALL SELECT 'corpus', file, coalesce(p, t, '<none>'), count(*) FROM r WHERE event_id % 8 <> 2 GROUP BY ALL""")  # fmt: skip
def scanned_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the five consumers' contracts on lines read from files."""
    lines = staging.staged(_written(spark, sf_dir))
    parts = [records.checked_lines(lines, c).select(F.lit(name).alias("contract"), "file", F.coalesce("reason", F.lit("<none>")).alias("reason")) for name, c in _CONTRACTS.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("contract", "file", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("scan_tolerant", f"WITH {_LINES} SELECT file, count(*) AS n FROM v WHERE event_id % 8 IN (4, 6) GROUP BY file UNION ALL SELECT '<malformed>', count(*) FROM v WHERE event_id % 8 NOT IN (2, 4, 6)")
def scan_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = records.tolerant(records.checked_lines(_written(spark, sf_dir), records.CORPUS))
    return good.groupBy("file").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.select(F.lit("<malformed>").alias("file"), F.col("malformed").alias("n")))


@query("scan_fatal", f"WITH {_LINES}, r AS (SELECT file, line, coalesce({_PARSED}, {_NO_TEXT}) AS reason FROM v WHERE event_id % 8 <> 2) SELECT string_agg(file || ':' || line || ': ' || reason, '; ' ORDER BY file, line) AS said FROM (SELECT * FROM r WHERE reason IS NOT NULL ORDER BY file, line LIMIT 5)")
def scan_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict scan raises."""
    try:
        records.strict(records.checked_lines(_written(spark, sf_dir), records.CORPUS))
        said = None
    except records.ContractError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


_ORDINAL = f"WITH {_LINES}, o AS (SELECT file, line, row_number() OVER (ORDER BY file, line) - 1 AS ordinal FROM v) SELECT * FROM o"


@query("line_ordinals", _ORDINAL)
def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global ordinals over several files."""
    return records.with_ordinal(_written(spark, sf_dir)).select("file", "line", "ordinal")


@query("first_lines", _ORDINAL + " WHERE ordinal < 500 AND ordinal % 7 = 0")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit over all chunks, and every seventh of what it leaves."""
    rows = splits.first_ordinals(records.with_ordinal(_written(spark, sf_dir)), 500)
    return splits.every_nth(rows, "ordinal", 7).select("file", "line", "ordinal")


@query("first_orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head(table(spark, sf_dir, "orders"), 40, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("resumable_chunks", "SELECT c::INT AS chunk, c NOT IN (3, 4) AND (SELECT count(*) FILTER (WHERE event_id % 5 = c) FROM events) > 0 AS complete FROM (SELECT unnest(range(5)) AS c)")
def resumable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five chunks need no second run: of the fourth an id is another chunk's, of the fifth a row is missing."""
    events = table(spark, sf_dir, "events")
    found = []
    for c in range(5):
        own = events.where(F.col("event_id") % 5 == c)
        prefix = F.when((F.lit(c) == 3) & (F.col("event_id") % 100 == 3), "c009-").otherwise(f"c{c:03d}-")
        lines = own.select(F.concat(F.lit('{"sample_id":"'), prefix, "event_id", F.lit('"}')).alias("value"))
        found.append((c, bool(records.resumable(lines, c, own.count() + (c == 4)))))
    return spark.createDataFrame(found, "chunk int, complete boolean")


@query("unique_labels", "SELECT doc_id::VARCHAR AS sample_id, CASE WHEN quality = 0 THEN 'low' ELSE 'good' END AS type_identifiable FROM labels UNION ALL SELECT '<said>', 'duplicate sample_id; duplicate sample_id; no type_identifiable' FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels)")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table that passes its check, and what the check says of one with a repeated key and a null."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("quality") == 0, "low").otherwise("good").alias("type_identifiable"))
    two = labels.orderBy("sample_id").limit(1)
    spoilt = two.unionByName(two).unionByName(spark.createDataFrame([("zz", None)], "sample_id string, type_identifiable string"))
    try:
        records.unique_map(spoilt)
        said = ""
    except records.ContractError as e:
        said = str(e)
    return records.unique_map(labels).unionByName(spark.createDataFrame([("<said>", said)], "sample_id string, type_identifiable string"))


# Images


@query("eligible_documents", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_sample_id' WHEN n_chars % 3 = 0 THEN 'missing_page_size' WHEN doc_id % 2 = 1 THEN 'missing_image' END AS reason FROM documents")
def eligible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 14 == 0, "").when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("sample_id"), F.struct((F.col("n_chars") % 3).alias("w"), F.lit(9).alias("h")).alias("page"))
    images = docs.where("doc_id % 2 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), F.lit(1).alias("length"))
    return records.eligibility(docs, images).select("doc_id", "reason")


@query("image_uris", "SELECT n.n_regionkey AS region, 'data:image/png;base64,' || base64(encode(string_agg(n_name || chr(10), '' ORDER BY n_nationkey))) AS uri, octet_length(encode(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)))::BIGINT AS length FROM nation n GROUP BY n_regionkey")
def image_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder as data URIs, and their listing."""
    path = staging.folder(spark)
    table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    parts = []
    for region in range(5):
        folder = f"{path}/n_regionkey={region}"
        parts.append(records.data_uris(spark, folder, "*.txt").join(records.listing(spark, folder, "*.txt"), "name").select(F.lit(region).alias("region"), "uri", "length"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("inside_paths", "SELECT page_id, page_id % 4 IN (0, 3) AS inside FROM pages")
def inside_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE page_id % 4 WHEN 0 THEN concat('images/', page_id, '.png') WHEN 1 THEN concat('/', page_id) WHEN 2 THEN concat('a/../', page_id) ELSE concat('a..b/', page_id) END")
    return table(spark, sf_dir, "pages").select("page_id", records.inside(path).alias("inside"))


# Sinks


_NATION = """concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","note":', CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '"é"' END, '}')"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 1, "é").alias("note"))


@query("jsonl_sink", f"SELECT 'data' AS part, {_NATION} AS value FROM nation UNION ALL SELECT 'stats', concat('{{\"n\":', count(*), '}}') FROM nation UNION ALL SELECT 'complete', 'true' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'same folder', 'refused' FROM region WHERE r_regionkey = 0")
def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with their statistics, the marker, and the refusal of a copy onto its source."""
    rows, path = _nations(spark, sf_dir), staging.folder(spark)
    sinks.write_with_stats(rows, rows.agg(F.count(F.lit(1)).alias("n")), f"{path}/data", f"{path}/stats")
    sinks.write_copy(rows, f"{path}/data", f"{path}/copy")
    try:
        sinks.write_copy(rows, f"{path}/data/", f"{path}/data")
        said = "written"
    except ValueError:
        said = "refused"
    complete = sinks.is_complete(f"{path}/data", spark) and sinks.is_complete(f"{path}/copy", spark) and not sinks.is_complete(f"{path}/none", spark)
    marks = spark.createDataFrame([("complete", str(complete).lower()), ("same folder", said)], "part string, value string")
    read = lambda part: spark.read.text(f"{path}/{part}").select(F.lit(part).alias("part"), "value")
    return read("data").unionByName(read("stats")).unionByName(marks)


@query("rejects_sink", f"SELECT row_number() OVER (ORDER BY n_name) AS line, {_NATION} AS value FROM nation")
def rejects_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects in order of their key: part files in order of name, lines in order of place."""
    path = staging.folder(spark)
    sinks.write_rejects(_nations(spark, sf_dir), path, "n_name")
    lines = records.with_ordinal(records.numbered_lines(spark, path, "*.txt"))
    return lines.select((F.col("ordinal") + 1).alias("line"), "value")


@query("csv_sink", "SELECT 1::BIGINT AS line, chr(65279) || 'n_nationkey,n_name,note' AS value FROM region WHERE r_regionkey = 0 UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_nationkey), concat_ws(',', n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'é' END) FROM nation")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark)
    sinks.write_csv(_nations(spark, sf_dir).orderBy("n_nationkey"), path)
    return records.numbered_lines(spark, path, "*.csv").select("line", "value")


@query("splits_sink", "SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, n_nationkey, n_name FROM nation")
def splits_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark)
    sinks.write_splits(_nations(spark, sf_dir).drop("note").withColumn("split", F.when(F.col("n_nationkey") % 5 == 0, "val").otherwise("train")), path)
    parts = [spark.read.schema("n_nationkey long, n_name string").json(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).select("split", F.col("n_nationkey").cast("int"), "n_name")


@query("summary_sink", """WITH s AS (SELECT count(*) AS n, round(avg(s_nationkey), 6) AS mean FROM supplier) SELECT concat('{', chr(10), '  "mean": ', mean, ',', chr(10), '  "missing": null,', chr(10), '  "n": ', n, chr(10), '}', chr(10)) AS json,
  concat('# Suppliers', chr(10), chr(10), '| metric | value |', chr(10), '|---|---|', chr(10), '| count | ', n, ' |', chr(10), '| mean | ', printf('%.6f', mean), ' |', chr(10), '| missing | N/A |', chr(10)) AS markdown FROM s""")
def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_nationkey"), 6).alias("mean"), F.lit(None).cast("double").alias("missing"))
    return spark.createDataFrame([sinks.summary(row, "Suppliers", {"n": "count"})], "json string, markdown string")


# Fixed-length records


def _hex(value: Column | str, size: int) -> Column:
    return F.lpad(F.hex(F.expr(value) if isinstance(value, str) else value), 2 * size, "0")


def _binary(spark: SparkSession, sf_dir: str, family: str, dummy: bool, image: Column | None = None) -> DataFrame:
    """Records made from suppliers (``image``: hex digits), written as one file in parts and scanned back; a 9B file begins with a dummy."""
    k = F.col("s_suppkey").cast("long")
    code = F.concat(F.lit("24"), _hex(33 + k % 83, 1))
    first, size, _, _ = fixed.IMAGES[family]
    if family == "9B":
        head = F.concat(_hex(k % 9 + 1, 2), code, F.hex(F.rpad(F.concat(F.lit("R"), (k % 90).cast("string")), 4, " ").cast("binary")))
    elif family == "9G":
        head = F.concat(_hex(k % 9 + 1, 2), code, F.hex(F.rpad(F.concat(F.lit("R"), k.cast("string")), 8, " ").cast("binary")), _hex(k * 3, 4), _hex(k % 4, 1), _hex(k % 5, 1), _hex(k % 2, 1), _hex(20 + k % 60, 1), _hex(k % 700, 2), _hex(k % 800, 2), _hex(k % 900, 2), _hex(k % 1000, 2), _hex(k % 200, 1), _hex(k % 210, 1), F.repeat(F.lit("00"), 34))
    else:
        head = F.concat(_hex(k % 65536, 2), F.hex(F.rpad(F.concat(F.lit("A"), (k % 10).cast("string")), 2, " ").cast("binary")), _hex(k % 30 + 1, 2), _hex(33 + k % 60, 1), _hex(k % 256, 1), _hex(k % 4, 1), _hex(k % 5, 1), _hex(k % 2, 1), _hex(20 + k % 60, 1), _hex(k * 3, 4), _hex(k % 700, 2), _hex(k % 800, 2), _hex(k % 900, 2), _hex(k % 1000, 2), _hex(k % 200, 1), _hex(k % 210, 1), _hex(k % 15, 1), _hex(k % 16, 1), F.repeat(F.lit("00"), 4))
    body = F.repeat(_hex(k % 256, 1), size) if image is None else image
    rest = F.repeat(F.lit("00"), fixed.LENGTHS[family] - first - size)
    keys, raw = table(spark, sf_dir, "supplier").select("s_suppkey"), F.unhex(F.concat(head, body, rest))
    if dummy:
        keys = spark.range(1).select(F.lit(None).cast("long").alias("s_suppkey")).unionByName(keys.where("s_suppkey is not null"))
        raw = F.when(F.col("s_suppkey").isNull(), F.unhex(F.repeat(F.lit("00"), fixed.LENGTHS[family]))).otherwise(raw)
    path = f"{staging.folder(spark)}-ETL{family}"
    sinks.write_fixed(keys, raw, "s_suppkey", fixed.LENGTHS[family], path)
    return fixed.scan_binary(spark, path, family, parts=True)


_KANA = "chr((12353 + s_suppkey % 83)::INT)"
_COMMON = "printf('24%02X', 33 + s_suppkey % 83) AS class_code"


@query("decoded_9b", f"SELECT row_number() OVER (ORDER BY s_suppkey) AS record_index, s_suppkey % 9 + 1 AS sheet_number, {_COMMON}, 'R' || (s_suppkey % 90) AS reading, {_KANA} AS char, CASE WHEN (s_suppkey % 256) >= 128 THEN 255 ELSE 0 END AS pixel FROM supplier")
def decoded_9b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _binary(spark, sf_dir, "9B", dummy=True).where("skipped is null")
    rows = fixed.with_char(fixed.decode(rows, "9B"), "9B").withColumn("p", fixed.pixels("9B"))
    return rows.select("record_index", "sheet_number", "class_code", "reading", "char", F.conv(F.hex(F.substring("p", 1, 1)), 16, 10).cast("int").alias("pixel"))


_NAMED = "s_suppkey % 4 AS individual_evaluation, s_suppkey % 5 AS group_evaluation, s_suppkey % 2 AS sex, 20 + s_suppkey % 60 AS age, s_suppkey % 700 AS industry_code, s_suppkey % 800 AS occupation_code, s_suppkey % 900 AS sheet_gathering_date, s_suppkey % 1000 AS scanning_date"


@query("decoded_9g", f"SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS record_index, s_suppkey % 9 + 1 AS sheet_number, {_COMMON}, 'R' || s_suppkey AS reading, s_suppkey * 3 AS serial_number, {_NAMED}, s_suppkey % 200 AS sample_position_x, s_suppkey % 210 AS sample_position_y, {_KANA} AS char, (s_suppkey % 256) // 16 * 17 AS high, s_suppkey % 16 * 17 AS low FROM supplier")
def decoded_9g(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixed.with_char(fixed.decode(_binary(spark, sf_dir, "9G", dummy=False), "9G"), "9G").withColumn("p", fixed.pixels("9G"))
    pixel = lambda at: F.conv(F.hex(F.substring("p", at, 1)), 16, 10).cast("long")
    return rows.select("record_index", "sheet_number", "class_code", "reading", "serial_number", *(c for c in rows.columns if c in ("individual_evaluation", "group_evaluation", "sex", "age", "industry_code", "occupation_code", "sheet_gathering_date", "scanning_date", "sample_position_x", "sample_position_y")), "char", pixel(1).alias("high"), pixel(2).alias("low"))


@query("decoded_1", f"SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS record_index, s_suppkey % 65536 AS data_number, s_suppkey % 30 + 1 AS sheet_number, 33 + s_suppkey % 60 AS jis_code, s_suppkey % 256 AS ebcdic_code, s_suppkey * 3 AS serial_number, {_NAMED}, s_suppkey % 15 AS minimum_scanned_level, s_suppkey % 16 AS maximum_scanned_level, 'A' || (s_suppkey % 10) AS reading, CASE WHEN 33 + s_suppkey % 60 = 92 THEN '¥' ELSE chr((33 + s_suppkey % 60)::INT) END AS char FROM supplier")
def decoded_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixed.with_char(fixed.decode(_binary(spark, sf_dir, "1", dummy=False), "1"), "1")
    return rows.select("record_index", "data_number", "sheet_number", "jis_code", "ebcdic_code", "serial_number", "individual_evaluation", "group_evaluation", "sex", "age", "industry_code", "occupation_code", "sheet_gathering_date", "scanning_date", "minimum_scanned_level", "maximum_scanned_level", "reading", "char")


_BLOCK = "s_suppkey % 6 + 2 AS w, s_suppkey % 9 + 2 AS h, s_suppkey % 15 + 1 AS v, s_suppkey % 4 + 1 AS u"


@query("glyphs_with_contrast", f"""WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS record_index, {_BLOCK} FROM supplier), o AS (SELECT *, greatest(u, v) AS hi, least(u, v) AS lo FROM b),
g AS (SELECT *, CASE WHEN hi > 1 THEN round_even(255.0 * (lo - 1) / (hi - 1), 0)::INT END AS grey FROM o)
SELECT record_index, CASE WHEN hi <= 1 THEN 1 WHEN grey < 10 THEN 2 * w ELSE 4 * w END::INT AS width, CASE WHEN hi <= 1 THEN 1 ELSE h END::INT AS height, CASE WHEN hi <= 1 THEN 0 WHEN v = hi OR grey < 10 THEN 255 ELSE grey END::INT AS first, CASE WHEN hi <= 1 THEN 0 WHEN u = hi OR grey < 10 THEN 255 ELSE grey END::INT AS last FROM g""")
def glyphs_with_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a left and a right block of two grey levels: the darker one becomes 255, faint ones go, the rest is cut off."""
    n = lambda c: F.col("s_suppkey").cast("int") % c
    two = lambda level: F.concat(F.lower(F.hex(level)), F.lower(F.hex(level)))
    w, h, blank = n(6) + 2, n(9) + 2, lambda times: F.repeat(F.lit("00"), times)
    row = F.concat(blank(F.lit(4)), F.repeat(two(n(15) + 1), w), F.repeat(two(n(4) + 1), w), blank(28 - 2 * w))
    image = F.concat(blank(F.lit(32 * 6)), F.repeat(row, h), blank(32 * (57 - h)))
    rows = _binary(spark, sf_dir, "1", dummy=False, image=image).withColumn("g", fixed.glyphs("1"))
    byte = lambda at: F.conv(F.hex(F.substring("g.pixels", at, 1)), 16, 10).cast("int")
    return rows.select("record_index", "g.width", "g.height", byte(1).alias("first"), byte(-1).alias("last"))


@query("picked_records", f"SELECT row_number() OVER (ORDER BY s_suppkey) AS record_index, {_KANA} AS char, s_suppkey % 9 + 1 AS sheet_number FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 83 ORDER BY s_suppkey) = 1")
def picked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each character, read again by path and place."""
    rows = fixed.with_char(fixed.decode(_binary(spark, sf_dir, "9B", dummy=True).where("skipped is null"), "9B"), "9B")
    index = rows.groupBy("char").agg(F.min_by(F.struct("path", "record_index"), "record_index").alias("at")).select("char", "at.*")
    return fixed.glyph_at(index, rows.drop("char")).select("record_index", "char", "sheet_number")


@query("discovered_files", "SELECT CASE s_suppkey % 6 WHEN 0 THEN '9G' WHEN 1 THEN '9B' WHEN 2 THEN '1' WHEN 3 THEN '6' END AS family, count(*) AS n FROM supplier WHERE s_suppkey % 6 < 2 OR (s_suppkey % 6 < 4 AND s_suppkey % 4 > 0) GROUP BY 1")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of a listing: some files are of no whole number of records, lie outside a marked folder, or are information files."""
    name = F.expr("CASE s_suppkey % 6 WHEN 0 THEN concat('x/ETL9G_', s_suppkey) WHEN 1 THEN concat('x/ETL9B_', s_suppkey) WHEN 2 THEN concat(CASE WHEN s_suppkey % 8 = 4 THEN 'd/plain/ETL1C_' ELSE 'd/ETL1/ETL1C_' END, s_suppkey) WHEN 3 THEN concat('ETL6/ETL6C_', s_suppkey) WHEN 4 THEN concat('ETL9G/ETL9INFO_', s_suppkey) ELSE concat('x/readme', s_suppkey) END")
    size = F.expr("2052 * s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END")
    files = [(r[0], int(r[1])) for r in table(spark, sf_dir, "supplier").select(name, size).collect()]  # a listing is the driver's
    return spark.createDataFrame([(f, len(paths)) for f, paths in fixed.discover(files).items() if paths], "family string, n long")


# Services and small operators over records


def _busy_on_sevens(prompt: str) -> str:
    if prompt.endswith("7"):
        raise ConnectionError("busy")
    return prompt[::-1]


@query("answered_prompts", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 7 THEN reverse('ask ' || s_suppkey) END AS raw, CASE WHEN s_suppkey % 10 = 7 THEN 'ConnectionError: busy' END AS service_error FROM supplier")
def answered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected service that fails on some prompts each time."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("ask "), "s_suppkey").alias("prompt"))
    return services.answered(rows, "prompt", _busy_on_sevens).drop("prompt")


@query("namespaced_ids", "SELECT o_orderkey, printf('c%03d-s%d', o_custkey % 40, o_orderkey) AS sample_id, printf('c%03d-p%d', o_custkey % 40, o_custkey) AS pair_id FROM orders")
def namespaced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("s"), "o_orderkey").alias("sample_id"), F.concat(F.lit("p"), "o_custkey").alias("pair_id"))
    return programs.namespaced(rows, (F.col("o_custkey") % 40).cast("int")).drop("o_custkey")
