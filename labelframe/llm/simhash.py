"""Operator 1: SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint is the majority, bit by bit, of the 64-bit hashes of its word shingles.

``near_fingerprints`` links documents whose 64-bit fingerprints differ in at most two bits. The
fingerprint is cut into segments of 22, 21 and 21 bits. With two errors at most, one of the three
segments has none (pigeonhole), and the 23 bits that follow it (cyclically) have two at most, so
the two words have a common index among the Golay codewords within four bits of each
(``golay.near_indices``). The keys of a fingerprint are, for each segment, the segment itself with
each of these one or six indices: 3 to 18 keys of 33 or 34 bits, complete for two bits. Every
candidate in a bucket is verified by its exact distance.

``near_texts`` links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more. It takes the candidates that the keys give for the fingerprints of these sets (majority over distinct
shingles). At 0.8 sets differ in about ten of 64 bits, for which the keys are not complete, so an exact search completes them, a prefix filter. All shingles have one order (by hash, those common in a sample
of the documents last). The sets of a pair share ``similarity`` times the larger one's size at least, so their first
common shingle is among the first ``n - ceil(similarity n) + 1`` of each; these are a document's keys, and a pair is reported in the
bucket of its first common one. Sizes, places in the order and a sketch (for each of 512 classes of shingles, whether
their number is odd) bound the shared shingles from above, so they drop no link. All candidates are verified on the whole shingle sets:
first those of small buckets and of least spanning forests of large ones, then all that are left in large buckets between documents that
the verified links have not joined. So no link is lost, whatever the fingerprints say; but documents of a large bucket that are just less similar than ``similarity`` cost a verification for each pair.

Defined results: a null text counts as empty; texts without words share the fingerprint zero and
link with each other; a text with fewer words than a shingle is one shingle; repeated rows and
exact copies are links like any other; rows with a null id take part and get the component of
their text (an id of -2^63 counts as null); very long texts are taken whole; extra columns are ignored, but none may begin with ``_lf_``; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm import golay
from labelframe.llm.buckets import BLOCK, compare, spanning_forest
from labelframe.llm.common import cut, reserved, shuffle_partitions, small, table, text_or_empty
from labelframe.llm.components import components

SEED = 42
#: First bit and length of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits of the sketch of a shingle set; first shingles of a document that go with each of its keys.
SKETCH, HEAD = 512, 4
#: Rows of a bucket up to which all its candidates are verified at once.
SMALL = 8
#: One of so many documents is looked at for common shingles, how often one must stand there, and how many are told apart at most (16 MB in each worker).
SAMPLED, COMMON, MOST_COMMON = 16, 8, 2_000_000
#: Hashes of shingle sets that a task keeps at hand while it verifies candidates.
HELD = 1 << 21
LANES = np.uint64(0x0101010101010101)


def words_of(text: str) -> list[bytes]:
    """Words of the text in UTF-8, A-Z lower-cased, parted by ASCII white space."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of all shingles in order; of the whole sequence if it is shorter; none for no words."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The majority word of each group of ``sizes`` (all above zero) consecutive hashes.

    Bits are counted eight at a time in the byte lanes of 64-bit sums over at most 255 rows.
    """
    blocks = -(-sizes // 255)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks)
    first = first + 255 * (np.arange(len(first)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    counts = np.empty((len(first), 64), np.int64)
    for k in range(8):
        counts[:, k::8] = np.add.reduceat(hashes >> np.uint64(k) & LANES, first).view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0)
    return np.packbits(2 * totals > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majority_of(hashes: np.ndarray) -> np.int64:
    """The majority word of one group; zero for none."""
    return majority(hashes.view(np.uint64), np.array([len(hashes)])).view(np.int64)[0] if len(hashes) else np.int64(0)


def _batched(texts: Iterator[str], width: int, fold: Callable, shape: tuple[int, ...], most: int = 1 << 18) -> np.ndarray:
    """Fold the shingle hashes of texts, some hundred thousand shingles at a time; zero for no words."""
    out, held, n = [], [], 0

    def flush() -> None:
        sizes = np.array([len(h) for h in held])
        rows = np.zeros((len(held), *shape), np.uint64)
        if sizes.any():
            rows[sizes > 0] = fold(np.concatenate(held), sizes[sizes > 0])
        out.append(rows)

    for text in texts:
        held.append(h := shingle_hashes(words_of(text), width))
        n += len(h)
        if n >= most:
            flush()
            held, n = [], 0
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros((0, *shape), np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long): the 64-bit fingerprint of each document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _batched((x.as_py() for x in batch.column(1)), width, majority, ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of 64-bit fingerprints."""
    rows, keys = [], []
    for number, (first, length) in enumerate(SEGMENTS):
        turned = fps >> np.uint64(first) | (fps << np.uint64(64 - first) if first else np.uint64(0))
        exact = (turned & np.uint64((1 << length) - 1)).astype(np.int64)
        near = golay.near_indices((turned >> np.uint64(length) & np.uint64((1 << 23) - 1)).astype(np.int64))
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(np.int64(number) << 34 | exact[row] << 12 | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(u ^ v).sum(-1, dtype=np.int32)


def link_solver(most: int, owner: Callable | None = None) -> Callable:
    """Solve for ``compare``: in each bucket, links at ``most`` differing bits or fewer.

    Groups of up to eight rows give all their links, larger ones a least spanning forest of them. ``owner`` may tell
    for row numbers whether this bucket reports the pair (some bucket must).
    """

    def solve(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        ids, fps, n = cols["id"], np.ascontiguousarray(cols["fp"]), len(cols["id"])
        fps = fps.view(np.uint64).reshape(n, -1)
        sizes = np.diff(np.append(starts, n))
        a, b = [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            near = _distances(fps[i], fps[j]) <= most
            i, j = i[near], j[near]
            if owner is not None and len(i):
                mine = owner(cols, fps, i, j)
                i, j = i[mine], j[mine]
            a.append(i)
            b.append(j)

        for s in range(2, 9):
            at = starts[sizes == s]
            for x in range(s if len(at) else 0):
                for y in range(x):
                    keep(at + y, at + x)
        for k in np.flatnonzero(sizes > 8):
            at, s = starts[k], sizes[k]
            part = fps[at : at + s]
            distance = np.zeros((s, s), np.int32)
            for w in range(part.shape[1]):
                distance += np.bitwise_count(part[:, w, None] ^ part[None, :, w])
            if owner is not None:
                i, j = np.nonzero(np.triu(distance <= most, 1))
                distance = np.full((s, s), most + 1, np.int32)
                mine = owner(cols, fps, at + i, at + j)
                i, j = i[mine], j[mine]
                distance[i, j] = distance[j, i] = _distances(part[i], part[j])
            i, j = spanning_forest(distance, most)
            a.append(at + i)
            b.append(at + j)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return {"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}

    return solve


def fingerprint_links(prints: DataFrame, most: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints of column ``fp``, enough to join all that hang together.

    ``most`` is 2 at most: for so many errors the keys are complete.
    """
    if most > 2:
        raise ValueError("the keys are complete for two differing bits at most")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows, keys = golay_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), pa.array(fps[rows])], names=["key", "id", "fp"])

    rows = prints.select("fp").distinct().mapInArrow(keyed, "key long, id long, fp long")
    return compare(rows, link_solver(most), {"a": "long", "b": "long"}, block).distinct()


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document: id, fp, component (smallest id reachable by links of ``most`` bits or fewer)."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(fingerprint_links(classes, most, block))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(placed.select("fp", "root").join(least, "root"), "fp").select("id", "fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    out = near_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Links by shingle similarity


def _shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), width).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the sorted ``hashes``, those in the sorted ``common`` last: any set this similar shares one, the first common one."""
    if not len(hashes):
        return hashes
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a set: bit k tells whether an odd number of hashes is k modulo ``SKETCH``.

    Two sets differ in as many hashes as their sketches in bits, or more.
    """
    return np.packbits(np.bincount(hashes.view(np.uint64) % np.uint64(SKETCH), minlength=SKETCH) & 1 == 1, bitorder="little")


def candidate_solver(similarity: float, every: bool = False) -> Callable:
    """Solve for ``compare``: pairs (of different ``root``, if there is such a column) that may be as similar as ``similarity`` and have their first common shingle here.

    Groups of up to ``SMALL`` rows give all of them, larger ones those in a least spanning forest (rows of one root hang together already), or all if ``every``.
    """
    share = similarity / (1 + similarity)  # of both sizes: what such a pair has in common at least

    def solve(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        ids, size, place, n = cols["id"], cols["size"], cols["pos"], len(cols["id"])
        roots = cols.get("root", ids)
        prints = np.ascontiguousarray(cols["fp"]).view(np.uint64).reshape(n, -1)
        heads = np.ascontiguousarray(cols["head"]).view(np.int64).reshape(n, HEAD)
        a, b = [], []

        def bits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Differing bits of the sketches; more than ``SKETCH`` where the pair can't be a link."""
            distance = sum(np.bitwise_count(prints[i, w] ^ prints[j, w]).astype(np.int16) for w in range(prints.shape[1]))
            both = size[i] + size[j]
            least = share * both - 1e-6
            may = (np.minimum(size[i] - place[i], size[j] - place[j]) >= least) & (both - 2 * least >= distance)
            if "block" in cols:  # pairs of one block are the work of that block with itself
                may &= (cols["b1"][i] == cols["b2"][i]) | (cols["block"][i] != cols["block"][j])
            apart = roots[i] != roots[j]
            return np.where(may & apart, distance, np.where(apart | every, SKETCH + 1, 0))

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            """Those that have no earlier shingle in common, as far as the heads tell."""
            before = [np.arange(HEAD) < place[x][:, None] for x in (i, j)]
            met = (heads[i][:, :, None] == heads[j][:, None, :]) & before[0][:, :, None] & before[1][:, None, :]
            mine = ~met.any((1, 2))
            a.append(i[mine])
            b.append(j[mine])

        sizes = np.diff(np.append(starts, n))
        for s in range(2, SMALL + 1):
            at = starts[sizes == s]
            for x in range(s if len(at) else 0):
                for y in range(x):
                    near = (bits(at + y, at + x) <= SKETCH) & (roots[at + y] != roots[at + x])
                    keep((at + y)[near], (at + x)[near])
        for k in np.flatnonzero(sizes > SMALL):
            rows = starts[k] + np.arange(sizes[k])
            distance = bits(rows[:, None], rows[None, :])
            i, j = np.nonzero(np.triu(distance <= SKETCH, 1)) if every else spanning_forest(distance, SKETCH)
            apart = roots[rows[i]] != roots[rows[j]]
            i, j = i[apart], j[apart]
            for at in range(0, len(i), 1 << 16):
                keep(rows[i[at : at + (1 << 16)]], rows[j[at : at + (1 << 16)]])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return {"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}

    return solve


def repeated_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (key long, id long, pos int) without most of those whose key no other row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, True  # the last row, and whether it stays whatever follows (a partition's first may go on next door)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            same = np.diff(keys := whole.column(0).to_numpy()) == 0
            stays = np.zeros(len(keys), bool)
            stays[0] = matched
            stays[1:] |= same
            stays[:-1] |= same
            if len(keys) > 1:
                yield from whole.slice(0, len(keys) - 1).filter(pa.array(stays[:-1])).to_batches()
            held, matched = whole.slice(len(keys) - 1).to_batches()[0], bool(stays[-1])
        if held is not None:
            yield held

    order = ["key", "id"]
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "key long, id long, pos int")


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles in ``COMMON`` or more of the sampled documents of ``docs`` (key, tag, text); only the search's speed depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                if len(hashes := _shingle_set(text.as_py(), width)):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes)], names=["h"])

    some = docs.where(F.pmod("tag", F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    counts = cut(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON))
    # from how often on: by powers of two, so that no task sorts them all
    sizes = {r["k"]: r["of"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("of")).collect()}
    least, kept = 64, 0
    while least > 0 and kept + sizes.get(least - 1, 0) <= MOST_COMMON:
        least -= 1
        kept += sizes.get(least, 0)
    return np.sort(counts.where(F.col("n") >= F.lit(float(2**least))).select("h").toArrow()["h"].to_numpy())


NO_ID = -(2**63)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, tag, text): id with a stand-in for null, hash that tells the texts of one id apart, text."""
    text = text_or_empty(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the ``links`` (a, b) between nodes; nodes without a row are roots of their own."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = cut(components(between)).select(F.col("node").alias("was"), F.col("root").alias("now"))
    alone = joined.join(roots, joined["was"] == roots["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return cut(roots.join(joined, roots["root"] == joined["was"], "left").select("node", F.coalesce("now", "root").alias("root")).union(alone))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One row per document: key (its id), tag (hash of its text), root (one value per group of near duplicates), first.

    ``first`` is true for one row of each group, the one of the smallest id.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is above zero and one at most")
    named = _named(docs, id_col, text_col)
    common = common_shingles(named, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(2):
                words = words_of(text.as_py())
                hashes = np.unique(shingle_hashes(words, width).view(np.int64))
                for to, v in zip(rows, (xxhash.xxh3_128_digest(b" ".join(words)), len(hashes), parities(hashes).tobytes(), int(majority_of(hashes)), prefix(hashes, common, similarity)), strict=True):
                    to.append(v)
            found = (pa.array(r, t) for r, t in zip(rows, (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["key", "tag", "name", "size", "fp", "print", "firsts"])

    prints = named.mapInArrow(run, "key long, tag long, name binary, size int, fp binary, print long, firsts array<bigint>")
    prints = cut(prints.withColumn("uid", F.monotonically_increasing_id()))
    order = F.struct((F.col("key") == NO_ID).alias("none"), "key", "uid")
    classes = cut(prints.groupBy("name").agg(F.min_by(F.struct("key", "uid", "tag", "size", "fp", "print", "firsts"), order).alias("m")).select("name", "m.*"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [np.resize(np.array(x.as_py(), np.int64), HEAD).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.binary())], names=["id", "size", "fp", "head"])

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [zlib.compress(b" ".join(words_of(x.as_py())), 1) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["uid", "z"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def shingles(uid: int, z: pa.Scalar) -> np.ndarray:
            found = held.pop(uid, None)
            if found is None:
                found = np.unique(shingle_hashes(zlib.decompress(z.as_buffer()).split(), width))
            held[uid] = found  # now the last to go
            while len(held) > 2 and sum(map(len, held.values())) > HELD:
                held.pop(next(iter(held)))
            return found

        for batch in batches:
            links = []
            for row, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = shingles(a, batch.column(2)[row]), shingles(b, batch.column(3)[row])
                common = len(np.intersect1d(x, y, assume_unique=True))
                links.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    def verified(candidates: DataFrame) -> DataFrame:
        """The candidates that are links. Texts travel as compressed words, once for each document and once for each candidate."""
        ends = candidates.select(F.col("a").alias("uid")).union(candidates.select("b")).distinct()
        asked = cut(classes.join(ends, "uid").select("key", "tag", "uid"))
        fetched = named.join(small(asked), ["key", "tag"]).select("uid", "text").mapInArrow(squeezed, "uid long, z binary")
        texts = fetched.groupBy("uid").agg(F.first("z").alias("z"))  # a repeated row gives its text again
        x, y = texts.select(F.col("uid").alias("a"), F.col("z").alias("x")), texts.select(F.col("uid").alias("b"), F.col("z").alias("y"))
        return cut(candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))

    def pairs(rows: DataFrame, every: bool = False) -> DataFrame:
        return compare(rows, candidate_solver(similarity, every), {"a": "long", "b": "long"}, block).distinct()

    # candidates of the fingerprints, and of the prefix filter
    of_print = classes.groupBy("print").agg(F.min("uid").alias("first"))
    end = lambda c: of_print.select(F.col("print").alias(c), F.col("first").alias(f"{c}_first"))
    between = fingerprint_links(classes.select(F.col("print").alias("fp")), 2, block).join(end("a"), "a").join(end("b"), "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    within = classes.select("print", "uid").join(of_print, "print").where(F.col("uid") != F.col("first")).select(F.col("first").alias("a"), F.col("uid").alias("b"))
    keyed = classes.select(F.col("uid").alias("id"), F.posexplode("firsts").alias("pos", "key")).select("key", "id", "pos")
    sketches = classes.select(F.col("uid").alias("id"), "size", "fp", F.slice("firsts", 1, HEAD)).mapInArrow(headed, "id long, size int, fp binary, head binary")
    repeated = cut(repeated_keys(keyed).join(sketches, "id").select("key", "id", "pos", "size", "fp", "head"))
    roots = cut(components(verified(cut(pairs(repeated).union(between).union(within).distinct()))))

    # what large buckets have left out, between documents of different roots
    again = repeated.join(roots, repeated["id"] == roots["node"], "left").select(*repeated.columns, F.coalesce("root", "id").alias("root"))
    parted = again.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"))
    thinned = cut(parted.where((F.col("rows") > SMALL) & (F.col("least") < F.col("most"))).select("key"))
    if not thinned.isEmpty():  # the forests may have left out links for candidates that are none
        roots = joined_roots(roots, verified(cut(pairs(again.join(small(thinned), "key", "left_semi"), every=True))))
    least = F.struct((F.col("key") == NO_ID).alias("none"), F.col("key"), F.col("uid"))
    placed = classes.join(roots, classes["uid"] == roots["node"], "left").select("name", F.coalesce("root", "uid").alias("root"), least.alias("least"))
    leaders = placed.groupBy("root").agg(F.min("least").alias("lead"))
    placed = placed.select("name", "root").join(leaders, "root")
    return prints.join(placed, "name").select("key", "tag", "root", (F.col("uid") == F.col("lead.uid")).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document, the one of the smallest id, of each group of ``near_texts``; columns unchanged."""
    reserved(docs)
    groups = cut(near_texts(docs, id_col, text_col, **how).groupBy("key", "tag").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n")))
    tagged = docs.withColumns({"_lf_key": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_lf_tag": F.xxhash64(text_or_empty(text_col))})
    named = lambda df: df.select(F.col("key").alias("_lf_key"), F.col("tag").alias("_lf_tag"))
    kept = tagged.join(small(named(groups.where("not first"))), ["_lf_key", "_lf_tag"], "left_anti")
    repeated = named(groups.where("first and n > 1"))
    if not repeated.isEmpty():  # rows with the same id and text: one stays
        repeated = small(repeated)
        once = kept.join(repeated, ["_lf_key", "_lf_tag"], "left_semi").dropDuplicates(["_lf_key", "_lf_tag"])
        kept = kept.join(repeated, ["_lf_key", "_lf_tag"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
