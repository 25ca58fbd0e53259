"""Operator 9: embedding near-duplicates by random-hyperplane signs, exact cosines and connected components.

Equal vectors are first taken together with their number. A table hashes a vector to the signs of its products with ``bits``
random hyperplanes. Vectors at cosine c agree on a sign with probability 1 - arccos(c) / pi, so ``tables`` is set for a pair at the threshold to meet
in some table with probability ``recall`` at least; ``bits`` follows the logarithm of the number of vectors,
so that buckets keep their expected size.

What travels for each table is narrow: id, bucket and a sketch of ``SKETCH`` more signs. Within a bucket (``buckets.compare``: hot buckets are cut into blocks, all of whose pairs
are compared) pairs whose sketches differ in more bits than pairs at the threshold do (mean and four standard deviations: about three in 100,000 are lost) are passed over, as are those that
one of the first tables has brought together. Only vectors with a pair left travel themselves, once for each bucket or pair of blocks, where cosines are exact, in double precision. A
pair counts in the first table where the two meet and in no other, so counts of
links add up; a bucket reports each vector's number of links and a spanning forest of them, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links, are their own component and are kept; vectors of different
lengths don't link; components are scaled before they are squared, so none overflows; equal vectors link with each other; rows that repeat an id are vectors of their own; rows with a null id take part, but give no component its
name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.buckets import BLOCK, compare, grouped, spanning_forest
from labelframe.llm.common import cut, table
from labelframe.llm.components import components

THRESHOLD, RECALL, SEED, BUCKET = 0.9, 0.995, 7, 256
#: Signs of a sketch.
SKETCH = 192


def parameters(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = min(36, max(6, math.ceil(math.log2(max(2, n) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def farthest(threshold: float) -> int:
    """Differing bits up to which two sketches count as near."""
    p = math.acos(threshold) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p))))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by their largest component."""
    out = vectors.astype(np.float64)
    return out / np.abs(out).max(axis=1, keepdims=True)


def signs(vectors: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(rows, n) booleans: on which side of ``n`` random hyperplanes. Sums go in one order, so a vector has the same signs in any batch."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], n))
    total = np.zeros((len(vectors), n))
    for values, plane in zip(vectors.T, planes, strict=True):
        total += values[:, None] * plane
    return total >= 0


def codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) codes of scaled ``vectors``."""
    parts = [signs(vectors[at : at + 2000], bits * tables, seed).reshape(-1, tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) for at in range(0, len(vectors), 2000)]
    return np.concatenate(parts) if parts else np.zeros((0, tables), np.int64)


def heads(code: np.ndarray, bits: int) -> np.ndarray:
    """The codes of the first tables in one number, as many as go into 63 bits."""
    return sum((code[:, k] << k * bits for k in range(min(63 // bits, code.shape[1]))), np.zeros(len(code), np.int64))


def near_solver(bits: int, most: int):
    """Solve for ``compare``: rows (key, b1, b2, block, id) of all that may have a link of their own here: near by their sketches, and apart in the first tables."""
    mask = np.int64((1 << bits) - 1)

    def solve(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        n = len(cols["id"])
        words = [cols[f"s{w}"].view(np.uint64) for w in range(SKETCH // 64)]
        head, table, cut = cols["head"], cols["key"] >> 53, "block" in cols
        marked = np.zeros(n, bool)
        for at, end in zip(starts, np.append(starts[1:], n), strict=True):
            if end - at < 2:
                continue
            distance = np.zeros((end - at, end - at), np.uint8)
            for w in words:
                distance += np.bitwise_count(w[at:end, None] ^ w[None, at:end])
            i, j = np.nonzero(distance <= most)
            keep = i < j
            i, j = i[keep] + at, j[keep] + at
            if cut and cols["b1"][at] != cols["b2"][at]:  # pairs of one block are the work of that block with itself
                across = cols["block"][i] != cols["block"][j]
                i, j = i[across], j[across]
            for k in range(min(63 // bits, int(table[at]))):
                apart = ((head[i] ^ head[j]) >> k * bits & mask) != 0
                i, j = i[apart], j[apart]
            marked[i] = marked[j] = True
        rows = np.flatnonzero(marked)
        same = np.zeros(len(rows), np.int32)
        return {"key": cols["key"][rows], **{c: cols[c][rows] if cut else same for c in ("b1", "b2", "block")}, "id": cols["id"][rows]}

    return solve


def cosine_solver(width: int, dtype: str, bits: int, tables: int, threshold: float, seed: int):
    """Solve for ``grouped``: rows (a, a, links of a found here) and (a, b, 0) for a spanning forest of the links."""

    def solve(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        ids, times, n = cols["id"], cols["times"], len(cols["id"])
        vectors = scaled(np.ascontiguousarray(cols["vector"]).view(dtype).reshape(n, width))
        code = codes(vectors, bits, tables, seed)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        at_table, side, cross = cols["key"] >> 53, cols["block"], cols["b1"] != cols["b2"]
        degree, a, b = np.zeros(n, np.int64), [], []

        def mine(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs that meet in no earlier table, and across the two blocks where there are two."""
            return ((code[i] == code[j]).argmax(1) == at_table[i]) & (~cross[i] | (side[i] != side[j]))

        def count(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(degree, i, times[j])
            np.add.at(degree, j, times[i])

        sizes = np.diff(np.append(starts, n))
        for s in range(2, 9):
            at = starts[sizes == s]
            for x in range(s if len(at) else 0):
                for y in range(x):
                    i, j = at + y, at + x
                    near = np.einsum("nd,nd->n", vectors[i], vectors[j]) >= threshold
                    i, j = i[near], j[near]
                    own = mine(i, j)
                    i, j = i[own], j[own]
                    count(i, j)
                    a.append(i)
                    b.append(j)
        for k in np.flatnonzero(sizes > 8):
            at, s = starts[k], sizes[k]
            part = vectors[at : at + s]
            i, j = np.nonzero(np.triu(part @ part.T >= threshold, 1))
            if not len(i):
                continue
            own = np.concatenate([mine(at + i[m : m + 65536], at + j[m : m + 65536]) for m in range(0, len(i), 65536)])
            i, j = i[own], j[own]
            count(at + i, at + j)
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            distance = np.ones((len(used), len(used)), np.int8)
            p, q = back[: len(i)], back[len(i) :]
            distance[p, q] = distance[q, p] = 0
            x, y = spanning_forest(distance, 0)
            a.append(at + used[x])
            b.append(at + used[y])
        some = np.flatnonzero(degree)
        a, b = (np.concatenate([some, *x]) for x in (a, b))
        return {"a": ids[a], "b": ids[b], "n": np.concatenate([degree[some], np.zeros(len(a) - len(some), np.int64)])}

    return solve


KEYED = ", ".join(f"{c} long" for c in ("key", "id", "head", *(f"s{w}" for w in range(SKETCH // 64))))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component, kept."""
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = {"float": "<f4"}.get(item, "<f8")
    v, infinite = F.col(vector_col), float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))).alias("name"))  # 128 bits name a vector
    classes = rows.where("v is not null").groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v"))
    classes = cut(cut(classes).withColumn("uid", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    bits, tables = parameters(n, threshold, recall)

    def padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(lists.offsets.to_numpy())
        values = np.zeros((len(lengths), width), dtype)
        values[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
        return values, lengths.astype(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                values, lengths = padded(some.column(1))
                v = scaled(values)
                code = codes(v, bits, tables, seed)
                sketch = np.packbits(signs(v, SKETCH, seed + 1), axis=1, bitorder="little").view(np.int64)
                keys = np.arange(tables, dtype=np.int64) << 53 | (lengths[:, None] & 0x1FFFF) << 36 | code
                again = lambda x: pa.array(np.repeat(x, tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), again(some.column(0).to_numpy()), again(heads(code, bits)), *(again(sketch[:, w]) for w in range(SKETCH // 64))], names=KEYED.replace(" long", "").split(", "))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in padded(batch.column(2))[0]], pa.binary())], names=["id", "times", "vector"])

    keyed = classes.select("uid", "v").mapInArrow(hashed, KEYED)
    near = cut(compare(keyed, near_solver(bits, farthest(threshold)), {"key": "long", "b1": "int", "b2": "int", "block": "int", "id": "long"}, block))
    wanted = classes.join(near.select(F.col("id").alias("uid")).distinct(), "uid", "left_semi").select("uid", "times", "v").mapInArrow(as_bytes, "id long, times long, vector binary")
    solve = cosine_solver(width, dtype, bits, tables, threshold, seed)
    found = cut(grouped(near.join(wanted, "id"), ("key", "b1", "b2"), solve, {"a": "long", "b": "long", "n": "long"}))
    degrees = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b"))
    placed = classes.join(roots, classes["uid"] == roots["node"], "left").select("name", "uid", "times", "first", F.coalesce("root", "uid").alias("root"))
    placed = placed.join(placed.groupBy("root").agg(F.min("first").alias("component")), "root").join(degrees, F.col("uid") == F.col("a"), "left")
    placed = placed.select("name", "component", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"))
    component = F.coalesce("component", "id")
    return rows.select("id", "name").join(placed, "name", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id"""
