"""Operator 7: quality classifier with hierarchical empirical Bayes over sites.

Document evidence: two logistic models, for low quality and for toxicity, over a few shape features and the words
and word beginnings that tell the labels apart (chosen by their likelihood ratio). They are fitted on the driver on at most ``sample`` labelled documents, drawn by the hash of
their id; everything else covers all documents.

Site evidence: with p the document's probability of being bad, grouped aggregation gives for each host and each path of a host the number of documents, the sum of p and of its
squares. An analysis of variance of these sums estimates how far hosts differ from each other, and paths within hosts; it sets how strongly a
host's rate shrinks toward the global rate and a path's toward its host's. A sparse site thus keeps its prior, a large one its own record. A document's own p is taken out of its
sites' sums before they speak about it (leave one out). The document's log odds plus the shift of its path's log odds from the global ones decide.

A site is a string like ``host/path/...``, with or without a scheme: the host (A-Z lower-cased) is what stands before the first ``/``, the path the first segment after it. In
a table whose sites are hosts only, each host has one path, and paths add nothing. A document's language, length or any other column is no site.

Texts are scored once; what is kept of them (id, a hash, site, two probabilities) gives both the sums and the decisions.

Defined results: a null text counts as empty, a very long one is read whole; null sites are one site of their own; rows without labels are scored like any other; labels
that are null are left out, and of repeated labels the worst counts; without labels of both kinds a model says nothing against a document (p = 0); repeated rows are
documents of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import cut, small, table

#: Labelled documents to fit on, at most; words kept per model; documents of the sample that a word must be in; its least z score.
SAMPLE, WORDS, LEAST_DOCS, LEAST_Z = 10_000, 300, 5, 4.0
#: Lengths in bytes of the word beginnings that count as words of their own (families of inflected forms).
STEMS = (4, 5, 6, 7)
#: Stands for certainty: log odds are held within plus or minus this.
MOST_LOGIT = 12.0

_PUNCTUATION = bytes.maketrans(b".,;:!?()[]\"'", b" " * 12)
_PLAIN = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum() or chr(c).isspace() or chr(c) in ".,;:?'\"()-")
_NOT_UPPER = bytes(c for c in range(256) if chr(c) not in string.ascii_uppercase)
_NOT_DIGIT = bytes(c for c in range(256) if chr(c) not in string.digits)


def features(text: str) -> tuple[list[float], set[bytes]]:
    """(shape features, distinct words in lower case)."""
    raw = text.encode()
    words = raw.lower().translate(_PUNCTUATION).split()
    distinct = set(words)
    n, n_words = max(1, len(raw)), max(1, len(words))
    symbols, upper, digits = (len(raw.translate(None, delete)) / n for delete in (_PLAIN, _NOT_UPPER, _NOT_DIGIT))
    variety = len(distinct) / n_words ** 0.85 if words else 0.0
    return [math.log1p(100 * symbols), math.log1p(100 * upper), math.log1p(100 * digits), variety, math.log1p(n_words), min(40.0, len(raw) / n_words), float(not words)], distinct


def with_stems(distinct: set[bytes]) -> set[bytes]:
    """The words themselves and their beginnings, these marked by a ``^``."""
    return distinct.union(*({b"^" + w[:n] for w in distinct if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class Model:
    """A logistic model over shape features, held within the range (low, high) of the sample, and word presences."""

    bias: float
    shape: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    words: dict[bytes, float]

    def probability(self, shape: list[float], distinct: set[bytes]) -> float:
        z = self.bias
        for w, x, low, high in zip(self.shape, shape, self.low, self.high, strict=True):
            z += w * (low if x < low else high if x > high else x)
        z += sum(self.words[w] for w in self.words.keys() & distinct)
        return 1 / (1 + math.exp(-max(-MOST_LOGIT, min(MOST_LOGIT, z))))


def fit(shapes: np.ndarray, present: list[list[int]], chosen: list[bytes], bad: np.ndarray, ridge: float = 1.0) -> Model | None:
    """Ridge logistic regression by Newton's method; None without both labels. ``present``: numbers of the ``chosen`` words of each document."""
    if not len(bad) or bad.all() or not bad.any():
        return None
    mean, spread = shapes.mean(0), shapes.std(0)
    spread[spread < 1e-6] = 1.0
    k = 1 + shapes.shape[1]
    x = np.zeros((len(bad), k + len(chosen)))
    x[:, 0], x[:, 1:k] = 1, (shapes - mean) / spread
    for row, words in enumerate(present):
        x[row, [k + w for w in words]] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - bad) + penalty * weights
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    scaled = weights[1:k] / spread
    return Model(float(weights[0] - scaled @ mean), tuple(scaled.tolist()), tuple(shapes.min(0).tolist()), tuple(shapes.max(0).tolist()), {w: float(v) for w, v in zip(chosen, weights[k:], strict=True)})


def _telling(counts: DataFrame, flag: str, n_bad: int, n: int, n_words: int) -> list[bytes]:
    """The words that tell documents with ``flag`` from others best, by the root of the likelihood ratio statistic."""
    seen, worse = F.col("n").cast("double"), F.col(flag).cast("double")
    cells = [(worse, seen * n_bad), (seen - worse, seen * (n - n_bad)), (n_bad - worse, (n - seen) * n_bad), (n - seen - n_bad + worse, (n - seen) * (n - n_bad))]
    ratio = sum((F.when(c > 0, c * F.ln(c * n / e)).otherwise(0.0) for c, e in cells), F.lit(0.0))
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))
    rows = counts.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(n_words).collect()
    return [bytes(r[0]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_words: int = WORDS) -> dict[str, Model | None]:
    """Models ``low`` and ``toxic`` from at most ``sample`` labelled documents."""
    known = labels.where("quality is not null and toxic is not null").groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") < 1).cast("int").alias("low"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    said = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "_id")
    said = cut(said.select("_id", "text", "low", "toxic").dropDuplicates(["_id"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                words = [list(with_stems(features(x.as_py())[1])) for x in some.column(0)]
                of = pa.array(np.repeat(np.arange(len(words)), [len(w) for w in words]))
                yield pa.RecordBatch.from_arrays([pa.array([w for ws in words for w in ws], pa.binary()), some.column(1).take(of), some.column(2).take(of)], names=["word", "low", "toxic"])

    counts = said.select("text", "low", "toxic").mapInArrow(count, "word binary, low int, toxic int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCS)
    counts = cut(counts)
    n, n_low, n_toxic = said.agg(F.count(F.lit(1)), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = {"low": _telling(counts, "low", n_low, n, n_words), "toxic": _telling(counts, "toxic", n_toxic, n, n_words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: {w: k for k, w in enumerate(words)} for name, words in chosen.items()}
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(1)]
            stems = [with_stems(f[1]) for f in found]
            held = [pa.array([sorted(at[name][w] for w in at[name].keys() & s) for s in stems], pa.list_(pa.int32())) for name in ("low", "toxic")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.float64())), *held, batch.column(2), batch.column(3)], names=["id", "shape", "low_words", "toxic_words", "low", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = said.mapInArrow(run, f"id {kind}, shape array<double>, low_words array<int>, toxic_words array<int>, low int, toxic int").toArrow().sort_by("id")
    if not rows.num_rows:
        return {"low": None, "toxic": None}
    shapes = np.array(rows["shape"].to_pylist())
    return {name: fit(shapes, rows[f"{name}_words"].to_pylist(), chosen[name], rows[name].to_numpy()) for name in chosen}


def scorer(models: dict[str, Model | None]):
    """Arrow-batched column function: text to struct(low, toxic) of probabilities."""

    every = frozenset().union(*(m.words for m in models.values() if m))
    by_length = {n: {w[1:] for w in every if w[:1] == b"^" and len(w) == n + 1} for n in STEMS}
    by_length = {n: stems for n, stems in by_length.items() if stems}

    @F.pandas_udf("low double, toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            shape, distinct = features(text)
            known = set(every & distinct)
            for n, stems in by_length.items():
                known.update(b"^" + w for w in {w[:n] for w in distinct if len(w) > n} & stems)
            rows.append(tuple(m.probability(shape, known) if m else 0.0 for m in (models["low"], models["toxic"])))
        return pd.DataFrame(rows, columns=["low", "toxic"])

    return score


def _logit(p: Column) -> Column:
    least = 1 / (1 + math.exp(MOST_LOGIT))
    held = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return F.ln(held / (1 - held))


def _strength(rate: float, total: float, squares: float, groups: int, between: float, within: float) -> float:
    """Prior strength in documents: rate (1 - rate) over the variance between groups, less one, from 1 to a million.

    ``between``: sum of n (group rate - parent rate)^2; ``within``: sum of squared deviations inside groups; ``squares``: sum of n^2 / parent's n;
    ``groups``: degrees of freedom between.
    """
    if groups < 1 or total - squares <= 0:
        return 1e6
    noise = within / max(1.0, total - groups - 1)
    spread = (between - groups * noise) / (total - squares)
    return 1e6 if spread <= 0 else min(1e6, max(1.0, rate * (1 - rate) / spread - 1))


@dataclass(frozen=True)
class Prior:
    """Global rate, and strengths of the host's and the path's priors in documents."""

    rate: float
    host: float
    path: float


def site_sums(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """(by host and path: documents and sums of p of host and path, the priors); ``scored``: host, path, p."""
    by_path = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), F.sum("p").alias("p_path"), F.sum(F.col("p") * F.col("p")).alias("pp")))
    by_host = by_path.groupBy(F.col("host").alias("of")).agg(F.sum("n_path").alias("n_host"), F.sum("p_path").alias("p_host"), F.count(F.lit(1)).alias("n_paths"))
    both = by_path.join(by_host, F.col("host").eqNullSafe(F.col("of"))).select("host", "path", "n_path", "p_path", "pp", "n_host", "p_host", "n_paths")
    rate_path, rate_host = F.col("p_path") / F.col("n_path"), F.col("p_host") / F.col("n_host")
    first = (F.col("n_path") / F.col("n_host")).alias("share")  # each path's part of its host, so that hosts can be summed over paths
    sums = both.select("*", first).agg(
        F.sum("n_path"), F.sum("p_path"), F.count(F.lit(1)), F.sum(F.lit(1) / F.col("n_paths")),
        F.sum(F.col("n_path") * F.pow(rate_path - rate_host, 2)), F.sum(F.col("pp") - F.col("p_path") * rate_path),
        F.sum(F.col("n_path") * F.col("share")), F.sum(F.col("share") * F.col("p_host") * rate_host), F.sum(F.col("share") * F.col("n_host") * F.col("n_host")),
    ).first()
    n = float(sums[0] or 0)
    if not n:
        return both, Prior(0.0, 1.0, 1.0)
    rate, n_paths, n_hosts = sums[1] / n, int(sums[2]), round(sums[3])
    between_hosts = max(0.0, sums[7] - n * rate * rate)
    host = _strength(rate, n, sums[8] / n, n_hosts - 1, between_hosts, sums[5] + sums[4])
    path = _strength(rate, n, sums[6], n_paths - n_hosts, sums[4], sums[5])
    return both, Prior(rate, host, path)


def site_of(site: Column) -> tuple[Column, Column]:
    """(host, path) of a site; null for null."""
    bare = F.regexp_replace(site, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(F.split(bare, "/")[0], upper, lower), F.when(bare.isNotNull(), F.coalesce(F.get(F.split(bare, "/"), 1), F.lit("")))


def with_posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, p and others) with ``site_rate`` (the path's posterior without the row itself) and ``p_bad`` (both together)."""
    sums, prior = site_sums(scored.select("host", "path", "p"))
    sums = sums.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n_path", "p_path", "n_host", "p_host")
    joined = scored.join(small(sums), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    host = (prior.host * prior.rate + F.col("p_host") - F.col("p")) / (prior.host + F.col("n_host") - 1)
    site = F.greatest(F.lit(0.0), (prior.path * host + F.col("p_path") - F.col("p")) / (prior.path + F.col("n_path") - 1))
    shift = _logit(site) - _logit(F.lit(prior.rate)) if 0 < prior.rate < 1 else F.lit(0.0)
    bad = 1 / (1 + F.exp(-(_logit(F.col("p")) + shift)))
    return joined.select(*scored.columns, site.alias("site_rate"), bad.alias("p_bad"))


def _tag(site: Column, text: Column) -> Column:
    """Hash of what decides about a document, besides the other documents."""
    return F.xxhash64(F.coalesce(text, F.lit("")), site.isNull(), site)


def judgements(docs: DataFrame, labels: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each of ``docs``: id, tag (hash of text and site), host, path, p_low, p_toxic, p (the document alone), site_rate (its path's rate without it) and p_bad (both together)."""
    score = scorer(train(docs, labels, id_col, text_col, sample))
    text, (host, path) = F.coalesce(F.col(text_col), F.lit("")), site_of(F.col(site_col))
    scored = docs.select(F.col(id_col).alias("id"), _tag(F.col(site_col), F.col(text_col)).alias("tag"), host.alias("host"), path.alias("path"), score(text).alias("s"))
    p = 1 - (1 - F.col("s.low")) * (1 - F.col("s.toxic"))
    return with_posteriors(cut(scored.select("id", "tag", "host", "path", F.col("s.low").alias("p_low"), F.col("s.toxic").alias("p_toxic"), p.alias("p"))))


def drop_rejected(docs: DataFrame, labels: DataFrame, most: float = 0.5, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those whose probability of being bad is above ``most``; columns unchanged."""
    bad = judgements(docs, labels, site_col, id_col, text_col, **how).where(F.col("p_bad") > most).select(F.col("id").alias("of"), F.col("tag").alias("said"))
    bad = small(cut(bad.distinct()))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["of"]) & (_tag(docs[site_col], docs[text_col]) == bad["said"]), "left_anti")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low, p_toxic, site_rate, p_bad, keep of all documents."""
    out = judgements(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(F.col("id").alias("doc_id"), r("p_low"), r("p_toxic"), r("site_rate"), r("p_bad"), (F.col("p_bad") <= 0.5).alias("keep"))
