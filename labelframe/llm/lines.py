r"""Operator 10: line dedup across documents, by range-partitioned line hashes.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends, A-Z lower-cased. Keys of ``least_chars`` code points or more in
``least_docs`` documents or more lose all lines but those in the largest id.

128-bit key hashes with (id, position) are range-partitioned by (hash, id), so that a line of a third of all documents is
dealt over as many tasks as it fills, and streamed in order (secondary sort by document and position). Of a key's run the stream
holds the lines of two documents at most: from the third on, all but the newest are bound to go. The runs at a partition's ends may go on next door; what is
undecided of them (the lines of two documents at most) comes out with the run's counts, two runs a partition, and is settled by a sum over them.
The result is a compressed keep bitmap for each document that loses lines, not text.

Defined results: a null or empty text is one empty line; documents are told apart by id (rows with equal ids count as one
document, null ids as one below all others, which an id of -2^63 is taken for); rows repeated with equal texts get equal results; very long texts are split whole; extra columns are ignored,
but none may begin with ``_lf_``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import cut, reserved, shuffle_partitions, small, table, text_or_empty

LEAST_CHARS, LEAST_DOCS = 20, 3
SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
#: Bytes of bitmaps up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def line_keys(text: str, least_chars: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(position, 16-byte hash) of the lines whose keys are long enough."""
    out = []
    for position, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(SPACES).lower()
        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
            out.append((position, xxhash.xxh3_128_digest(key)))
    return out


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed keep bitmap, up to the last dropped position in whole bytes; lines after it stay."""
    bits = np.ones(int(dropped.max()) // 8 * 8 + 8, bool)
    bits[dropped] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def keep_lines(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    kept = [line for line, stays in zip(lines, bits.tolist(), strict=False) if stays] + lines[len(bits) :]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    reserved(docs)
    text = text_or_empty(text_col)
    return docs.withColumns({"_lf_key": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_lf_tag": F.xxhash64(text)})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_lf_key, _lf_tag, n_dropped, bitmap) of the documents that lose lines: id (a stand-in for null), hash of the text, keep bitmap."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, positions, hashes = [], [], []
            for row, text in enumerate(batch.column(2)):
                for position, h in line_keys(text.as_py(), least_chars):
                    rows.append(row)
                    positions.append(position)
                    hashes.append(h)
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(of), batch.column(1).take(of), pa.array(positions, pa.int32())], names=["h1", "h2", "doc", "tag", "pos"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n_docs, at_edge = ["h1", "h2", "doc", "tag", "pos"], None, 0, True

        def decided(cols: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(cols[c][rows]) for c in names[2:]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=[*names, "n", "last"])

        def undecided(cols: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
            count = np.zeros(len(cols["doc"]), np.int64)
            count[0] = n
            return pa.RecordBatch.from_arrays([*(pa.array(cols[c]) for c in names), pa.array(count), pa.array(np.full(len(count), cols["doc"][-1]))], names=[*names, "n", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: v.to_numpy() for c, v in zip(names, batch.columns, strict=True)}
            n_held = 0
            if held is not None:
                n_held = len(held["doc"])
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            size = len(cols["doc"])
            new_key, new_doc = np.ones(size, bool), np.ones(size, bool)
            new_key[1:] = (cols["h1"][1:] != cols["h1"][:-1]) | (cols["h2"][1:] != cols["h2"][:-1])
            new_doc[1:] = new_key[1:] | (cols["doc"][1:] != cols["doc"][:-1])
            starts = np.flatnonzero(new_key)
            counts = np.add.reduceat(new_doc.astype(np.int64), starts)
            if n_held:  # documents of this run that are no longer held
                counts[0] += n_docs - int(new_doc[:n_held].sum())
            sizes = np.diff(np.append(starts, size))
            last_doc = cols["doc"][np.append(starts[1:], size) - 1]
            goes = np.repeat(counts >= least_docs, sizes) & (cols["doc"] != np.repeat(last_doc, sizes))
            if len(starts) > 1 and at_edge:  # the first run is over: what is not bound to go by now is settled later
                own = {c: cols[c][: sizes[0]][~goes[: sizes[0]]] for c in names}
                yield undecided(own, int(counts[0]))
                at_edge = False
            drop = np.flatnonzero(goes)
            if len(drop):
                yield decided(cols, drop)
            tail = np.arange(starts[-1], size)[~goes[starts[-1] :]]
            held, n_docs = {c: cols[c][tail] for c in names}, int(counts[-1])
        if held is not None:
            yield undecided(held, n_docs)

    keyed = _keyed(docs, id_col, text_col).select("_lf_key", "_lf_tag", text_or_empty(text_col).alias("text"))
    lines = cut(keyed.mapInArrow(split, "h1 long, h2 long, doc long, tag long, pos int"))
    ranged = lines.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "tag", "pos")
    seen = cut(ranged.mapInArrow(stream, "h1 long, h2 long, doc long, tag long, pos int, n long, last long"))
    ends = seen.where("n is not null")
    sums = ends.groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("last").alias("newest")).where(F.col("docs") >= least_docs)
    dropped = seen.where("n is null").select("doc", "tag", "pos").unionByName(ends.join(sums, ["h1", "h2"]).where("doc <> newest").select("doc", "tag", "pos"))
    by_doc = dropped.groupBy("doc", "tag").agg(F.collect_set("pos").alias("dropped"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([pack_bitmap(x) for x in lists], pa.binary())], names=["_lf_key", "_lf_tag", "n_dropped", "bitmap"])

    return by_doc.mapInArrow(packed, "_lf_key long, _lf_tag long, n_dropped long, bitmap binary")


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    bitmaps = cut(keep_bitmaps(docs, id_col, text_col, **how)).select("_lf_key", "_lf_tag", F.col("bitmap").alias("_lf_bitmap"))
    n_bytes = bitmaps.agg(F.sum(F.length("_lf_bitmap"))).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:  # and no more rows than ``small`` allows
        bitmaps = small(bitmaps)
    return _keyed(docs, id_col, text_col).join(bitmaps, ["_lf_key", "_lf_tag"], "left")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` without the lines that go; columns unchanged, the count of characters (if there is one) brought up to date."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else keep_lines(t, b)[0] for t, b in zip(text, bitmap, strict=True)], dtype=object)

    joined, bitmap = _with_bitmaps(docs, id_col, text_col, **how), F.col("_lf_bitmap")
    joined = joined.withColumn("_lf_kept", kept(F.when(bitmap.isNotNull(), F.col(text_col)), bitmap))
    joined = joined.withColumn(text_col, F.when(bitmap.isNotNull(), F.col("_lf_kept")).otherwise(F.col(text_col)))
    if n_chars_col in docs.columns:
        kind = docs.schema[n_chars_col].dataType
        joined = joined.withColumn(n_chars_col, F.when(bitmap.isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(n_chars_col)))
    return joined.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [keep_lines(t.as_py(), b.as_py()) for t, b in zip(batch.column(1), batch.column(2), strict=True)]
            arrays = [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = _with_bitmaps(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), "_lf_bitmap")
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS newest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.newest AS goes FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
