from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from labelframe.plans import pipelines
from labelframe.sources import fixed, records, services, sinks
from labelframe.streaming import incremental

LINES = ['{"sample_id":"a","text":"t"}', "", '{"sample_id":"b","text":"t"} junk', "[1,2]", '{"sample_id":5,"text":7}', '{"sample_id":"a","text":"u"}']


@pytest.fixture
def chunk(tmp_path):
    (tmp_path / "chunk_000.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(tmp_path)


@pytest.mark.parametrize(
    ("contract", "bad"),
    [
        (records.RELABEL, {1: "duplicate sample_id", 2: "blank", 3: "bad json", 4: "not an object", 5: "no sample_id", 6: "duplicate sample_id"}),
        (records.EVALUATION, {2: "blank", 3: "bad json", 4: "not an object"}),
        (records.DATASET, {3: "bad json", 4: "not an object"}),
        (records.CORPUS, {3: "bad json", 4: "not an object", 5: "no text"}),
    ],
)
def test_contracts(spark, chunk, contract, bad):
    rows = records.checked_lines(records.numbered_lines(spark, chunk), contract)
    assert {r["line"]: r["reason"] for r in rows.where("not ok").collect()} == bad
    with pytest.raises(records.ContractError, match="chunk_000.jsonl"):
        records.strict(rows)
    good, counts = records.tolerant(rows)
    assert counts.first()["malformed"] == len(bad) and good.count() == len(LINES) - len(bad) - (1 if contract.skip_blank else 0)


def test_typed_records_and_ordinals(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"chunk_{k:03d}.jsonl").write_text("".join(json.dumps({"sample_id": f"c{k:03d}-{i}", "text": "x"}) + "\n" for i in range(k + 2)))
    path = str(tmp_path)
    rows = records.read_records(spark, path, "sample_id string, text string")
    assert rows.count() == 9
    lines = records.numbered_lines(spark, path)
    assert [r["ordinal"] for r in records.with_ordinal(lines).orderBy("ordinal").collect()] == list(range(9))
    one = lines.where(F.col("file").contains("chunk_001"))
    assert records.resumable(one, 1, 3) and not records.resumable(one, 1, 4) and not records.resumable(one, 2, 3)
    with pytest.raises(records.ContractError):
        records.read_records(spark, path, "sample_id string", glob="none_*.jsonl")


def test_unique_map(spark):
    good = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, type_identifiable string")
    assert records.unique_map(good).count() == 2
    for bad in ([("a", "x"), ("a", "y")], [("a", None)], [("", "x")]):
        with pytest.raises(records.ContractError):
            records.unique_map(spark.createDataFrame(bad, "sample_id string, type_identifiable string"))


def test_images(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"\x89PNG" + name.encode())
    rows = spark.createDataFrame([("a", (1, 1)), ("c", (1, 1)), ("b", (0, 1)), (None, (1, 1))], "sample_id string, page struct<w:int,h:int>")
    got = {r["sample_id"]: r["reason"] for r in records.eligibility(rows, records.listing(spark, str(tmp_path))).collect()}
    assert got == {"a": None, "c": "missing_image", "b": "missing_page_size", None: "missing_sample_id"}
    import base64

    uri = {r["name"]: r["uri"] for r in records.data_uris(spark, str(tmp_path)).collect()}["a.png"]
    assert base64.b64decode(uri.split(",")[1]) == b"\x89PNGa.png"
    paths = spark.createDataFrame([("images/a.png",), ("../a",), ("/etc/x",), ("a/../../b",), ("C:\\x",)], "p string")
    assert [r[0] for r in paths.select(records.inside(F.col("p"))).collect()] == [True, False, False, False, False]


def g_record(sheet, code, serial=1):
    raw = bytearray(8199)
    raw[0:2], raw[2:4], raw[4:12], raw[12:16] = sheet.to_bytes(2, "big"), code, b"READ    ", serial.to_bytes(4, "big")
    raw[19] = 33
    return bytes(raw)


def b_record(sheet, code):
    raw = bytearray(576)
    raw[0:2], raw[2:4], raw[4:8] = sheet.to_bytes(2, "big"), code, b"AB  "
    return bytes(raw)


def m_record(sheet, mnemonic, jis):
    raw = bytearray(2052)
    raw[2:4], raw[4:6], raw[6] = mnemonic, sheet.to_bytes(2, "big"), jis
    return bytes(raw)


def test_fixed_length_audit(spark, tmp_path):
    codes = [b"\x30\x21", b"\x30\x22", b"\x7e\x7e", b"\x30\x21"]
    path = tmp_path / "ETL9G_01"
    path.write_bytes(b"".join(g_record(s, c) for s, c in zip([1, 1, 2, 1, 0], [*codes, codes[0]], strict=True)))
    rows, summary, bad = pipelines.family_audit(spark, [str(path)], "9G")
    got = rows.orderBy("record_index").collect()
    assert [r["writer"].split(":")[-1] for r in got] == ["occ=1", "occ=1", "occ=1", "occ=2", "occ=1"]
    assert [r["char"] for r in got] == ["亜", "唖", None, "亜", "亜"] and got[0]["age"] == 33 and got[0]["reading"] == "READ"
    s = summary.first()
    assert (s["n_writers"], s["n_pairs"], s["n_observed"], s["min"], s["max"]) == (3, 4, 3, 1, 2)
    assert [(r["class_code"], r["n"], r["first"]["record_index"]) for r in bad.collect()] == [("7E7E", 1, 2)]


def test_fixed_length_partitions_align(spark, tmp_path):
    path = tmp_path / "ETL9B_1"
    path.write_bytes(b"".join(b_record(k, b"\x24\x22") for k in range(40)))
    spark.dataSource.register(fixed.FixedLength)
    rows = spark.read.format("fixed_length").option("recordLength", 576).option("rowsPartition", 7).option("path", str(path)).load()
    assert rows.rdd.getNumPartitions() == 6
    got = fixed.decode(rows, "9B").orderBy("record_index").select("record_index", "sheet_number").collect()
    assert [(r[0], r[1]) for r in got] == [(k, k) for k in range(40)]
    marked = fixed.scan(spark, [str(path)], "9B")
    assert marked.where("skipped = 'dummy'").count() == 1 and marked.where("skipped = 'model'").count() == 0
    other = fixed.scan_binary(spark, str(path), "9B")
    assert sorted((r["record_index"], bytes(r["raw"]), r["skipped"]) for r in other.collect()) == sorted((r["record_index"], bytes(r["raw"]), r["skipped"]) for r in marked.collect())
    (tmp_path / "ETL9B_2").write_bytes(b"x" * 577)
    with pytest.raises(Exception, match="no whole number"):
        fixed.scan(spark, [str(tmp_path / "ETL9B_2")], "9B").count()


def test_binary_scan_is_linear_in_its_file(spark, tmp_path):
    """Each record once copied the whole file: 60,000 records of 576 bytes would have copied 2 TB."""
    path, n = tmp_path / "ETL9B_1", 60_000
    path.write_bytes(b"".join(b_record(k % 65536, b"\x24\x22") for k in range(n)))
    began = time.monotonic()
    got = fixed.decode(fixed.scan_binary(spark, str(path), "9B"), "9B").agg(F.count(F.lit(1)), F.count_if(F.col("sheet_number") == F.col("record_index"))).first()
    assert tuple(got) == (n, n) and time.monotonic() - began < 60


def test_records_in_parts_are_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 576 * 40)
    monkeypatch.setattr(fixed, "WRITTEN_9B", {999: 990})
    k = F.col("k")
    keys = spark.range(1000).select(F.when(F.col("id") > 0, 1000 - F.col("id")).alias("k"))
    raw = F.unhex(F.concat(F.lpad(F.hex(F.coalesce(k, F.lit(0))), 4, "0"), F.repeat(F.lit("C20A"), 286), F.lit("0D00")))
    sinks.write_fixed(keys, raw, "k", 576, str(tmp_path / "made"))
    assert len(list((tmp_path / "made").glob("part-*"))) > 10
    rows = fixed.scan_binary(spark, str(tmp_path / "made"), "9B", parts=True)
    got = fixed.decode(rows, "9B").orderBy("record_index").select("path", "record_index", "sheet_number", "skipped").collect()
    assert [(r[1], r[2]) for r in got] == [(i, i) for i in range(1000)] and {r[0] for r in got} == {str(tmp_path / "made")}
    assert [r[3] for r in got] == ["dummy", *[None] * 990, *["model"] * 9]
    assert {bytes(r["raw"])[2:] for r in rows.collect()} == {b"\xc2\x0a" * 286 + b"\x0d\x00"}
    with pytest.raises(Exception, match="zero byte at its end"):
        sinks.write_fixed(keys, F.unhex(F.repeat(F.lit("01"), 576)), "k", 576, str(tmp_path / "bad"))


def test_numbers_of_many_suppliers_wrap(spark, tmp_path):
    """Two bytes hold a number up to 65,535; the SQL takes the remainder."""
    from labelframe.plans import bindings

    spark.createDataFrame([(65_535,), (65_536,), (359_999,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = bindings.QUERIES["decoded_1"](spark, str(tmp_path)).orderBy("record_index").collect()
    assert [(r["record_index"], r["data_number"], r["serial_number"]) for r in got] == [(0, 65_535, 196_605), (1, 0, 196_608), (2, 359_999 % 65_536, 1_079_997)]


def test_single_byte_characters(spark, tmp_path):
    path = tmp_path / "ETL1C_01"
    records_ = [(b"A ", 0), (b" A", 0xB1), (b"((", 0x28), (b"/X", 0), (b"KA", 0xB6), (b",,", 0xDE), (b"-6", 0x20)]
    path.write_bytes(b"".join(m_record(1, m, j) for m, j in records_))
    rows = fixed.with_char(fixed.decode(fixed.scan(spark, [str(path)], "1"), "1"), "1")
    assert [r["char"] for r in rows.orderBy("record_index").collect()] == ["A", "ア", "[", None, "カ", "゛", " "]
    assert fixed.x0201(0x5C) == "¥" and fixed.x0201(0x80) is None and fixed.x0208(b"\x21\x21") == "　"


def test_files_are_told_by_name():
    names = {"ETL9G_01": "9G", "ETL9B_1": "9B", "ETL1C_01": "1", "ETL6C_12": "6", "ETL9INFO": None, "ETL2_1": None, "notes.txt": None, "etl9g-3.bin": "9G"}
    assert {n: fixed.family_of(n) for n in names} == names


def test_discovery_needs_whole_marked_files():
    files = [("/d/ETL9G/ETL9G_01", 8199), ("/d/ETL1/ETL1C_01", 2052 * 3), ("/d/ETL1/ETL1C_02", 2053), ("/d/ETL1/ETL1INFO", 2052), ("/d/ETL6C_02", 2052), ("/d/x/notes", 2052)]
    assert fixed.discover(files) == {"1": ["/d/ETL1/ETL1C_01"], "6": ["/d/ETL6C_02"], "9G": ["/d/ETL9G/ETL9G_01"], "9B": []}


def test_pixels(spark, tmp_path):
    raw = bytearray(b_record(1, b"\x24\x22"))
    raw[8] = 0b10100000
    big = bytearray(g_record(1, b"\x30\x21"))
    big[64] = 0x1F
    (tmp_path / "ETL9B_1").write_bytes(bytes(raw) * 2)
    (tmp_path / "ETL9G_1").write_bytes(bytes(big))
    one = bytes(fixed.scan(spark, [str(tmp_path / "ETL9B_1")], "9B").select(fixed.pixels("9B")).first()[0])
    assert len(one) == 64 * 63 and list(one[:4]) == [255, 0, 255, 0]
    two = bytes(fixed.scan(spark, [str(tmp_path / "ETL9G_1")], "9G").select(fixed.pixels("9G")).first()[0])
    assert len(two) == 128 * 127 and list(two[:3]) == [17, 255, 0]


def test_glyph_picks(spark):
    import hashlib

    from labelframe.operators import audit

    rows = spark.createDataFrame([("9G", "f", i, "亜" if i % 2 else "唖", f"w{i}") for i in range(10)] + [("9B", "g", 0, "亜", "v")], "family string, path string, record_index long, char string, writer string")
    index = audit.glyph_index(rows)
    wanted = spark.createDataFrame([("pw-1", "亜"), ("pw-2", "唖"), ("pw-1", "x")], "w string, c string")
    got = {(r["w"], r["c"]): r for r in audit.picked_glyphs(wanted, index, "w", "c").collect()}
    for (w, c), r in got.items():
        n = {"亜": 6, "唖": 5, "x": 0}[c]
        seed = int.from_bytes(hashlib.sha256(f"writer:{len(w)}:{w}|char:{len(c)}:{c}".encode()).digest()[:8], "big")
        assert r["_slot"] == (seed % n if n else None) and (r["path"] is None) == (n == 0)
    assert {r["family"]: r["n_glyphs"] for r in audit.glyph_summary(index).collect()} == {"9G": 10, "9B": 1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, None), ("a", 2, "漢")], "sample_id string, n int, t string")
    path = str(tmp_path / "out")
    sinks.write_with_stats(rows, rows.agg(F.count(F.lit(1)).alias("n")), path, str(tmp_path / "stats"))
    assert sinks.is_complete(path, spark) and not sinks.is_complete(str(tmp_path / "none"), spark)
    said = [json.loads(line) for f in sorted(os.listdir(path)) if f.startswith("part") for line in open(os.path.join(path, f), encoding="utf-8")]
    assert sorted(said, key=lambda r: r["sample_id"]) == [{"sample_id": "a", "n": 2, "t": "漢"}, {"sample_id": "b", "n": 1, "t": None}]
    with pytest.raises(ValueError):
        sinks.write_copy(rows, path, path + "/")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    data = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfsample_id,n,t")
    sinks.write_splits(rows.withColumn("split", F.lit("val")), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=val").is_dir()
    text, table = sinks.summary(rows.agg(F.avg("n").alias("mean"), F.max("t").alias("t"), F.lit(None).cast("double").alias("none")), "T")
    assert json.loads(text)["mean"] == 1.5 and "| none | N/A |" in table and "| mean | 1.500000 |" in table


def test_services_retry_and_never_fail(spark):
    rows = spark.createDataFrame([("ok",), ("bad",)], "p string")

    def ask(prompt):
        if prompt == "bad":
            raise OSError("down")
        return prompt.upper()

    got = {r["p"]: (r["raw"], r["service_error"]) for r in services.answered(rows, "p", ask, retries=1).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "OSError: down")}


def test_incremental_runs_read_files_once(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.makedirs(source)

    def put(k):
        with open(os.path.join(source, f"chunk_{k}.jsonl"), "w") as f:
            f.writelines(json.dumps({"id": k * 10 + i, "v": random.random()}) + "\n" for i in range(5))

    run = lambda: incremental.process_new(spark, source, "id long, v double", lambda df: df.select("id"), target, check)
    put(0)
    put(1)
    assert run() == 1
    put(2)
    assert run() == 1 and run() == 0
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == sorted(k * 10 + i for k in range(3) for i in range(5))


def test_contrast_of_glyphs():
    """A neighbour's stroke at the side neither sets the white point nor the cut of a 9G glyph; a faint shade and the background go."""
    import numpy as np

    image = np.full((127, 128), 34, np.uint8)
    image[40:80, :5] = 255
    image[50:70, 60:90] = 136
    image[50, 60], image[50, 61] = 52, 60
    out = fixed.with_contrast(image, "9G")
    assert out.shape == (24, 34) and out[4, 10] == 255 and out[0].max() == 0 and (out[2:22, 2:32] > 0).sum() == 20 * 30 - 1
    assert out[2, 2] == 0 and out[2, 3] == round(255 * (9 / 85) ** 0.75)
    plain = fixed.with_contrast(image, "1")  # a noisy border sets the ground there
    assert plain.shape == (1, 1) or plain.max() <= 255
    assert fixed.with_contrast(np.zeros((63, 64), np.uint8), "6").tolist() == [[0]] and fixed.with_contrast(np.zeros((2, 2), np.uint8), "6").tolist() == [[0]]
