from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelframe.llm import simhash
from labelframe.llm.common import written
from test_llm_operators import brute_lines, containment, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted cases of each stage."""
    rnd = random.Random(21)
    folder = tmp_path_factory.mktemp("tables")
    shared = "This very line is shared by a good many of the documents"
    items = [(k, prose(rnd, 20, 3000)) for k in range(5)]
    docs, kind = [], {}

    def add(text, what):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 7}", len(text)))
        kind[i] = what

    for k in range(260):
        text = prose(rnd, rnd.randrange(60, 160), 6000)
        what = k % 13
        if what == 0:
            add(" ".join(w + "%%%" for w in text.split()), "low")
        elif what == 1:
            add(text + " awful17 awful99 awful3", "toxic")
        elif what == 2:
            add(text + " " + items[k % 5][1] + " " + prose(rnd, 30, 6000), "leak")
        elif what == 3:
            copy = text.split()
            copy[10] = "changed"
            add(text, "clean")
            add(" ".join(copy), "copy")
            add(text, "copy")
        elif what == 4:
            add(text + "\n" + shared, "line")
        else:
            add(text, "clean")
    labels = [(i, int(w != "low"), int(w == "toxic")) for i, w in kind.items() if i // 15 % 3]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), docs, kind, items


def test_each_stage_does_its_work_and_keeps_the_rest(spark, tables):
    folder, docs, kind, items = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    seen, last = {}, ""
    for name, stage in corpus_pipeline.STAGES:
        before = seen[last] if name == "packing" else {r["doc_id"]: r["text"] for r in now.collect()}
        now = written(stage(spark, now, folder))
        if name == "packing":
            break
        assert now.columns == columns
        after = seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
        gone = set(before) - set(after)
        if name == "quality":
            assert gone == {i for i, w in kind.items() if w in ("low", "toxic")}
        elif name == "line_dedup":
            assert after == {i: text for i, _, _, text in brute_lines(list(before.items()))} and not gone
        elif name == "near_dedup":
            sets = {i: set(simhash._shingle_set(t, 5).tolist()) for i, t in before.items()}
            assert gone == {i for i in before if any(j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in before)}
        elif name == "decontaminate":
            assert gone == {i for i, t in before.items() if any((containment(t, q) or 0) >= 0.8 for _, q in items)}
        last = name
    ids = {r[0] for r in now.select("doc_id").distinct().collect()}
    assert ids == set(before)
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_gives_the_last_stage(spark, tables):
    folder = tables[0]
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_stages_take_empty_and_odd_tables(spark, tables, tmp_path):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50_000, None, "s", 1)], docs.schema)
    for some, least in ((docs.limit(0), 0), (odd.withColumn("key", F.lit("clash")).withColumn("uid", F.lit(0)), 1)):
        now = some
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, folder))
            if name != "packing":
                assert now.columns == some.columns
        assert now.count() >= least
