"""Operator 6: best-fit packing with certified bin counts.

Documents become token ids and an end token; only those over ``size`` are cut, from the end, into pieces of ``size``
with a shorter first piece. Full pieces are sequences of their own. The others are dealt evenly over partitions and packed by
best-fit decreasing. Dual-feasible functions (Martello and Toth's thresholds, Fekete and Schepers' roundings) turn the lengths of a
partition into lower bounds on its bins; a partition whose count meets the bound is certified optimal, and final if its bins have less than a bin of free space
in all. One with a gap keeps its full bins and releases the others; the released documents of all partitions are exchanged and packed anew by half as many
partitions.

The counts of all lengths give the same bound for the whole table. Rounds end when the number of sequences meets that bound (the packing is optimal as a whole, as with
documents that no others fit beside), when nothing is released, when a round neither saves nor fills a sequence, or after the one of a single partition. So they grow with the logarithm of the partitions at most, and
documents are not gathered in one partition to no end. Certificates in the result: ``n_bins`` and ``bound`` for the pieces that a partition of the last round that moved them holds, ``all_bins`` and ``all_bound`` for the
whole table; their difference is what an optimal packing could save at most.

Defined results: a null text counts as empty (the end token alone); repeated rows are packed each by itself, equal lengths in the order of rows; very long texts
are cut into as many pieces as they need; null ids stay null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import cut, table, text_or_empty
from labelframe.llm.tokens import default_engine, engine

SIZE, END_ID = 1024, 2
#: Items that one partition packs at first, about.
ITEMS = 20_000


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """The best of some dual-feasible functions' lower bounds on the bins that ``lengths`` need."""
    return counted_bound(np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)) if len(lengths) else 0


def counted_bound(counts: np.ndarray) -> int:
    """The same for ``counts`` of the lengths from 0 to the size."""
    if not counts.any():
        return 0
    size = len(counts) - 1
    x = np.arange(size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * x)
    k = np.arange(0, size // 2 + 1)
    above = number[-1] - number[size - k]  # longer than size - k: alone but for pieces shorter than k
    middle = total[size - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int((above + -(-middle // size)).max())
    for j in range(1, 33):  # u(x) = x where (j + 1) x is whole, else floor((j + 1) x) / j, x as a share of the size
        whole = (j + 1) * x % size == 0
        numerator = np.where(whole, j * x, (j + 1) * x // size * size)  # of u(x) j size
        best = max(best, int(-(-(counts * numerator).sum() // (j * size))))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given, and the free space of each bin; ties go by position."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    free: list[int] = []
    open_at = 0  # bit r: some bin has r free
    for item in order.tolist():
        n = int(lengths[item])
        fit = open_at >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_at &= ~(1 << r)
        else:
            r, b = size, len(free)
            free.append(size)
        bins[item], offsets[item] = b, size - r
        free[b] = r - n
        if r > n:
            room[r - n].append(b)
            open_at |= 1 << (r - n)
    return bins, offsets, np.array(free, np.int64)


def released(free: np.ndarray, bound: int, size: int = SIZE) -> np.ndarray:
    """Which bins a partition gives up: all that are not full, unless its count meets the bound and no other partition's documents could save a bin (its free space is less than one)."""
    return (free > 0) & ((len(free) > bound) | (int(free.sum()) >= size))


def pieces(docs: DataFrame, tokenizer: tuple, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: the pieces of each document's ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = engine(*tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for to, v in zip(rows, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        to.append(v)
            of = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([of, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


PLACED = "uid long, length long, sequence_id long, offset long, out boolean, n_bins long, bound long, n_kept long, bound_kept long"


def pack(items: DataFrame, size: int = SIZE, per_partition: int = ITEMS) -> tuple[DataFrame, int, int]:
    """(placed items, their sequences, a lower bound on these) for items (uid long, length long below ``size``).

    Placed: uid, sequence_id, offset, n_bins, bound; the last two: bins that hold what the partition has kept, and their certified lower bound.
    """

    def packer(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not held:
                return
            uid, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(uid)  # the same whatever order a retried task reads in
            uid, lengths = uid[order], lengths[order]
            bins, offsets, free = best_fit_decreasing(lengths, size)
            bound = lower_bound(lengths, size)
            goes = released(free, bound, size)
            out, kept = goes[bins], lower_bound(lengths[~goes[bins]], size)
            sequence = np.int64(number) << 58 | np.int64(TaskContext.get().partitionId()) << 34 | bins
            numbers = (np.full(len(uid), n) for n in (len(free), bound, int((~goes).sum()), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, lengths, sequence, offsets, out, *numbers)], names=[f.split()[0] for f in PLACED.split(", ")])

        return run

    pool, final, parts = items.select("uid", "length"), [], None
    counts = np.zeros(size + 1, np.int64)
    for length, n in pool.groupBy("length").count().collect():  # ``size`` rows at most
        counts[length] = n
    least, n, kept, before, number = counted_bound(counts), int(counts.sum()), 0, None, 0
    while True:
        number += 1
        parts = max(1, min(-(-n // per_partition), n if parts is None else parts // 2))
        done = cut(pool.repartition(parts).mapInArrow(packer(number), PLACED))
        n_bins, n_out, n = (x or 0 for x in done.agg(F.count_if(F.expr("offset = 0")), F.count_if(F.expr("offset = 0 and out")), F.count_if("out")).first())
        now = kept + n_bins
        if now == least or not n or parts == 1 or (before is not None and now >= before and n_out == n_bins):
            final.append(done.select("uid", "sequence_id", "offset", "n_bins", "bound"))
            break
        final.append(done.where("not out").select("uid", "sequence_id", "offset", F.col("n_kept").alias("n_bins"), F.col("bound_kept").alias("bound")))
        pool, kept, before = done.where("out").select("uid", "length"), kept + n_bins - n_out, now
    whole = final[0]
    for more in final[1:]:
        whole = whole.unionByName(more)
    return whole, now, least


def pack_documents(docs: DataFrame, tokenizer: tuple, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", per_partition: int = ITEMS) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place in a sequence of ``size`` tokens at most; the certificates n_bins, bound, all_bins, all_bound."""
    cutup = cut(pieces(docs, tokenizer, size, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    placed, n_bins, bound = pack(cutup.where(F.col("length") < size), size, per_partition)
    n_full = cutup.where(F.col("length") == size).count()
    one = F.lit(1).cast("long")
    full = cutup.where(F.col("length") == size).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("n_bins"), one.alias("bound"))
    full = full.withColumn("sequence_id", -1 - F.col("sequence_id"))  # below zero: never an id of a packed one
    both = full.unionByName(cutup.where(F.col("length") < size).join(placed, "uid")).drop("uid")
    return both.withColumns({"all_bins": F.lit(n_full + n_bins).cast("long"), "all_bound": F.lit(n_full + bound).cast("long")})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_engine())
