r"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of letters and digits (``\p{L}``, ``\p{N}``) of the lower-cased text; an item of q distinct ``width``-word shingles is contained
in a document that holds ``share`` of them or more. The search sketches the short side: under a random order (the hash of a shingle's hash)
an item keeps its least shingles, and since a document that contains the item may miss (1 - share) q of its shingles at most, a sketch of one shingle
more always meets it. Items are partitioned by size, sizes from 2^k up to 2^(k+1) each, and a partition's sketches are as large as its
largest size asks. A document is a candidate for an item when it holds as many shingles of the sketch as it must; no true pair is lost, whatever the document's length.
Candidates are verified by exact containment over all shingles of item and document.

Sketches and item shingles are broadcast only behind a count of their rows (``small``); beyond it the joins shuffle on the shingle hash.

Defined results: items or documents without words (null or empty texts) contain nothing and are in nothing; an item of fewer words than ``width`` has one shingle, its
whole word sequence, looked for in documents as such; repeated rows (same id and text) give one result, equal ids with other texts are documents or
items of their own; null ids stay null; very long texts are searched whole; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelframe.llm.common import cut, small, table

WIDTH, SHARE = 5, 0.8
GAP = r"[^\p{L}\p{N}]+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def words(col: str) -> Column:
    """Array of words; of one empty string for none."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), EDGES, ""), GAP)


def exploded(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (columns with an array ``words``) by each run of ``width`` words: other columns, ``h``, the run's hash."""
    n = F.size("words") - (width - 1)
    shifted = [F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in range(width)]
    keep = [c for c in rows.columns if c != "words"]
    runs = rows.where(n > 0).select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*(f"w{k}" for k in range(width))))
    return runs.select(*keep, F.xxhash64(*(f"w{k}" for k in range(width))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, item, n_shared, n_shingles): every pair of a document and an item it contains; ``tag`` is the hash of the document's text."""
    said = items.select(F.col(item_col).alias("item"), words(text_col).alias("words")).where("words[0] <> ''").distinct()
    said = cut(said.withColumn("n_words", F.least(F.size("words"), F.lit(width))))
    said = cut(said.withColumn("uid", F.monotonically_increasing_id()))
    widths = sorted(r[0] for r in said.select("n_words").distinct().collect())  # at most ``width`` numbers
    shingles = None
    for w in widths:
        some = exploded(said.where(F.col("n_words") == w).select("uid", "words"), w).select("uid", F.lit(w).alias("w"), "h").distinct()
        shingles = some if shingles is None else shingles.unionByName(some)
    if shingles is None:
        shingles = said.select("uid", F.col("n_words").alias("w"), F.lit(0).cast("long").alias("h")).limit(0)
    q = Window.partitionBy("uid")
    missing = F.floor(F.round((1 - share) * F.col("q"), 9)).cast("int")
    shingles = shingles.withColumn("q", F.count(F.lit(1)).over(q)).withColumn("rank", F.row_number().over(q.orderBy(F.xxhash64(F.lit(1), "h"), "h")))
    shingles = cut(shingles.withColumn("size_class", F.length(F.bin("q")) - 1))
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    sketch_size = F.floor(F.round((1 - share) * largest, 9)).cast("int") + 1
    sketch = shingles.where(F.col("rank") <= sketch_size).select("uid", "w", "h", (F.least(sketch_size, F.col("q")) - missing).alias("needed"))
    sketch, full = small(sketch, 1_000_000), small(shingles.select("uid", "w", "h", "q"), 1_000_000)

    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(doc_col).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    candidates = None
    for w in widths:
        found = exploded(named.select("doc", "tag", words("text").alias("words")), w).join(sketch.where(F.col("w") == w).drop("w"), "h")
        found = found.groupBy("doc", "tag", "uid", "needed").agg(F.count_distinct("h").alias("hits")).where("hits >= needed").select("doc", "tag", "uid")
        candidates = found if candidates is None else candidates.unionByName(found)
    kind = named.schema["doc"].dataType
    if candidates is None:
        candidates = named.select("doc", "tag", F.lit(0).cast("long").alias("uid")).limit(0)
    candidates = cut(candidates)
    asked = small(candidates.select(F.col("doc").alias("d"), F.col("tag").alias("t")).distinct())
    again = named.join(asked, named["doc"].eqNullSafe(F.col("d")) & (named["tag"] == F.col("t")), "left_semi")
    verified = None
    for w in widths:
        hits = exploded(again.select("doc", "tag", words("text").alias("words")), w).join(full.where(F.col("w") == w).drop("w"), "h")
        counted = hits.groupBy("doc", "tag", "uid", "q").agg(F.count_distinct("h").alias("n_shared")).where(F.col("n_shared") >= share * F.col("q") - 1e-9)
        verified = counted if verified is None else verified.unionByName(counted)
    if verified is None:
        verified = candidates.select("doc", "tag", "uid", F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("n_shared"))
    pairs = candidates.select(F.col("doc").alias("d"), F.col("tag").alias("t"), F.col("uid").alias("u"))
    verified = verified.join(pairs, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")) & (F.col("uid") == F.col("u")), "left_semi")
    return verified.join(said.select("uid", "item"), "uid").select(F.col("doc").cast(kind).alias("doc"), "tag", "item", F.col("n_shared").cast("long").alias("n_shared"), F.col("q").cast("long").alias("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those that contain an item; columns unchanged."""
    bad = cut(contained(docs, items, doc_col=doc_col, text_col=text_col, **how).select(F.col("doc").alias("of"), F.col("tag").alias("said")).distinct())
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(small(bad), docs[doc_col].eqNullSafe(bad["of"]) & (F.xxhash64(text) == bad["said"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of all pairs at the share or above."""
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: Shingles of items and of documents by width: items of fewer than five words are looked for by all their words.
OP5_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, unnest([array_to_string(w[k:k + least(len(w), 5) - 1], ' ') FOR k IN range(1, len(w) - least(len(w), 5) + 2)]) AS s FROM iw WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS q FROM i GROUP BY item_id),
widths AS (SELECT DISTINCT n FROM i),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, n, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS s FROM dw, widths WHERE len(w) >= n)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(q)::BIGINT AS n_shingles, round(count(*) / any_value(q), 6) AS containment
FROM d JOIN i USING (n, s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {SHARE} * any_value(q) - 1e-9"""
