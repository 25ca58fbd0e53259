"""Comparisons inside the buckets of a key, exact and even whatever a bucket's size.

Rows are range-partitioned by (key, id), so that even a key that holds a third of all rows is dealt
over many tasks, and streamed in that order. A run of a key that lies inside a partition and has at
most ``BLOCK`` rows is compared on the spot. Rows of longer runs, and of the runs at a partition's
ends, which may go on next door, come out open; these are cut into blocks of about ``BLOCK`` rows, and each pair
of blocks is compared in a group of its own. No row is dropped, and no task holds over
two blocks of a key plus an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import cut, shuffle_partitions

BLOCK = 1024


def _runs(cols: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Starts of the runs of equal values of ``names``."""
    n = len(cols[names[0]])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in names])
    return np.flatnonzero(new)


def as_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as numpy arrays: numbers as they are, fixed-width binaries as rows of bytes."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
            width = len(col[0].as_py()) if len(col) else 0
            out[name] = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _pick(cols: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in cols.items()}


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "smallint": pa.int16()}
Solve = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def compare(rows: DataFrame, solve: Solve, result: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Apply ``solve`` to every bucket of ``rows`` (key long, id long, numbers and fixed-width binaries).

    ``solve(columns, starts)`` gets rows of whole groups, one after the other, with each group's first row; where a
    bucket was cut, column ``block`` tells the two sides of a pair of blocks, and pairs within one side are found only
    in the group of that block with itself. It returns columns by ``result`` (name: Spark type), nullable numbers as
    float or long arrays.
    """
    spark = rows.sparkSession
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
    names = [n for n, _ in fields]
    schema = ", ".join([*(f"r_{n} {t}" for n, t in result.items()), *(f"{n} {t}" for n, t in fields), "found boolean"])
    types = [ARROW[t] for t in result.values()], [ARROW[t] for _, t in fields]

    def out(found: dict[str, np.ndarray] | None, opened: dict[str, np.ndarray] | None) -> pa.RecordBatch:
        n = len(next(iter((found or opened).values())))
        cols = [pa.array(found[c], t) if found else pa.nulls(n, t) for c, t in zip(result, types[0], strict=True)]
        for c, t in zip(names, types[1], strict=True):
            v = None if found else opened[c]
            cols.append(pa.nulls(n, t) if v is None else pa.array([x.tobytes() for x in v] if v.ndim == 2 else v, t))
        cols.append(pa.array(np.full(n, found is not None)))
        return pa.RecordBatch.from_arrays(cols, names=[*(f"r_{c}" for c in result), *names, "found"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict[str, np.ndarray]] = []  # the run that is not yet known to be over
        size, at_edge, long = 0, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = as_arrays(batch)
            starts = _runs(cols, ("key",))
            ends = np.append(starts[1:], batch.num_rows)
            k = 0
            if pending and pending[-1]["key"][-1] == cols["key"][0]:  # the pending run goes on
                piece = _pick(cols, slice(0, ends[0]))
                k = 1
                if long:
                    yield out(None, piece)
                    pending = [_pick(piece, slice(-1, None))]
                else:
                    pending.append(piece)
                    size += ends[0]
                    if size > block:
                        yield out(None, _join(pending))
                        pending, long = [_pick(piece, slice(-1, None))], True
                if k == len(starts):
                    continue
            if pending and not long:  # it is over
                whole = _join(pending)
                if at_edge:
                    yield out(None, whole)
                elif size > 1:
                    found = solve(whole, np.array([0]))
                    if len(found[next(iter(result))]):
                        yield out(found, None)
            if pending:
                at_edge = False
            pending = []
            last = len(starts) - 1
            if k < last:  # runs that lie inside the batch
                if at_edge:
                    yield out(None, _pick(cols, slice(starts[k], ends[k])))
                    at_edge, k = False, k + 1
            if k < last:
                sizes = ends[k:last] - starts[k:last]
                fit = (sizes > 1) & (sizes <= block)
                keep = np.repeat(fit, sizes)
                if fit.any():
                    found = solve(_pick(cols, np.flatnonzero(keep) + starts[k]), np.cumsum(np.append(0, sizes[fit][:-1])))
                    if len(found[next(iter(result))]):
                        yield out(found, None)
                if (sizes > block).any():
                    yield out(None, _pick(cols, np.flatnonzero(np.repeat(sizes > block, sizes)) + starts[k]))
            piece = _pick(cols, slice(starts[last], None))
            size, long = batch.num_rows - starts[last], False
            if size > block:
                yield out(None, piece)
                pending, long = [_pick(piece, slice(-1, None))], True
            else:
                pending = [piece]
        if pending and not long:
            yield out(None, _join(pending))

    order = ["key", "id"]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    once = cut(ranged.mapInArrow(first, schema))
    opened = once.where("not found").select(*names)
    counts = opened.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    cutup = opened.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    pairs = cutup.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    pairs = pairs.select(*names, "block", F.least("block", "other").cast("int").alias("b1"), F.greatest("block", "other").cast("int").alias("b2"))
    return once.where("found").select(*(F.col(f"r_{n}").alias(n) for n in result)).unionByName(grouped(pairs, ("key", "b1", "b2"), solve, result))


def grouped(rows: DataFrame, group: tuple[str, ...], solve: Solve, result: dict[str, str]) -> DataFrame:
    """Apply ``solve`` to all rows of each ``group``, streamed in order; for groups whose size is bounded."""
    types = [ARROW[t] for t in result.values()]

    def batch_of(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(found[next(iter(result))]):
            yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in zip(result, types, strict=True)], names=list(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = as_arrays(batch)
            if rest is not None:
                cols = _join([rest, cols])
            starts = _runs(cols, group)
            if len(starts) > 1:
                yield from batch_of(solve(_pick(cols, slice(0, starts[-1])), starts[:-1]))
            rest = _pick(cols, slice(starts[-1], None))
        if rest is not None:
            yield from batch_of(solve(rest, np.array([0])))

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *group).sortWithinPartitions(*group, "id")
    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in result.items()))


def spanning_forest(distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a least spanning forest of the pairs at distance ``most`` or less (Prim's rule)."""
    n, far = len(distance), np.iinfo(np.int32).max
    weights = np.where(distance <= most, distance.astype(np.int32), far)
    np.fill_diagonal(weights, far)
    best, parent, todo, a, b = np.full(n, far, np.int32), np.full(n, -1), np.ones(n, bool), [], []
    for _ in range(n):
        i = int(np.argmin(best))
        if best[i] == far:
            i = int(np.argmax(todo))
        else:
            a.append(parent[i])
            b.append(i)
        todo[i], best[i] = False, far
        nearer = todo & (weights[i] < best)
        best[nearer], parent[nearer] = weights[i][nearer], i
    return np.array(a, np.int64), np.array(b, np.int64)
