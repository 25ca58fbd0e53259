"""Diagnostics: a text-only leak probe (bigram naive Bayes and AUC), fault injection, and the closed form of the KPI simulation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelframe.functions import text as T
from labelframe.operators import programs as P
from labelframe.sources.staging import staged


#: Bigrams of a model that is broadcast.
VOCABULARY = 400_000


def bigram_rows(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(T.bigrams(text)).alias("bigram"))


def fit_bayes(rows: DataFrame, text: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """(bigram, c1, c0) and one row (d1, d0, t1, t0, v): documents and bigrams per label, vocabulary size plus one."""
    one = F.col(label) == 1
    docs = rows.agg(F.count_if(one).alias("d1"), F.count_if(~one).alias("d0"))
    # written: totals and scores use the counts again, and would count all bigrams again
    counts = staged(bigram_rows(rows, text, label).groupBy("bigram").agg(F.count_if(one).alias("c1"), F.count_if(~one).alias("c0")))
    totals = counts.agg(F.coalesce(F.sum("c1"), F.lit(0)).alias("t1"), F.coalesce(F.sum("c0"), F.lit(0)).alias("t0"), (F.count(F.lit(1)) + 1).alias("v"))
    return counts, totals.join(F.broadcast(docs))


def _log_ratio(c1: Column, c0: Column) -> Column:
    return F.ln((c1 + 1) / (F.col("t1") + F.col("v"))) - F.ln((c0 + 1) / (F.col("t0") + F.col("v")))


def score_bayes(rows: DataFrame, text: Column, key: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, score): log odds of label 1; unknown bigrams count as zero in both labels. A vocabulary of up to ``VOCABULARY`` bigrams goes to the rows, so these are summed where they are; with a larger one, bigrams are counted per row before they meet it."""
    counts, totals = model
    own = bigram_rows(rows, text, key)
    if counts.count() <= VOCABULARY:
        own, counts = own.withColumn("n", F.lit(1)), F.broadcast(counts)
    else:
        own = own.groupBy(key, "bigram").agg(F.count(F.lit(1)).alias("n"))
    scored = own.join(counts, "bigram", "left").join(F.broadcast(totals))
    sums = scored.groupBy(key).agg(F.sum(F.col("n") * _log_ratio(F.coalesce("c1", F.lit(0)), F.coalesce("c0", F.lit(0)))).alias("s"))
    prior = F.ln(F.greatest(F.lit(1), F.col("d1"))) - F.ln(F.greatest(F.lit(1), F.col("d0")))
    return rows.select(key).join(sums, key, "left").join(F.broadcast(totals)).select(key, (prior + F.coalesce("s", F.lit(0.0))).alias("score"))


def top_bigrams(model: tuple[DataFrame, DataFrame], k: int = 8, least: int = 20) -> DataFrame:
    """The ``k`` bigrams with the largest log ratios among those seen ``least`` times (ties: the larger bigram first)."""
    counts, totals = model
    rows = counts.where(F.col("c1") + F.col("c0") >= least).join(F.broadcast(totals))
    return rows.select("bigram", _log_ratio(F.col("c1"), F.col("c0")).alias("log_ratio"), "c1", "c0").orderBy(F.desc("log_ratio"), F.desc("bigram")).limit(k)


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: probability that a positive scores above a negative, ties half; 0.5 without both.

    Counts per distinct score and a running sum over them give all pairs' outcome without a pair. The running sum is made
    in two levels (ranges of scores, then inside), so no window holds all scores in one partition.
    """
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    edges = counts.approxQuantile("s", [i / 64 for i in range(1, 64)], 0.005) if not counts.isEmpty() else []
    edges = sorted({e for e in edges if e is not None})
    bucket = reduce(lambda at, e: at + F.when(F.col("s") > e, 1).otherwise(0), edges, F.lit(0))
    counts = counts.withColumn("b", bucket)
    sums = counts.groupBy("b").agg(F.sum("n").alias("nb"))
    before = sums.select("b", F.coalesce(F.sum("nb").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("below", inside).join(F.broadcast(before), "b")
    wins = F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("n") / 2.0))
    pairs = F.sum("p").cast("double") * F.sum("n")
    return placed.agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.5)).alias("auc"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"))


# Fault injection


def injected(rows: DataFrame, seed: int) -> DataFrame:
    """Each row (idx, gold steps) in five arms with texts: clean, benign_paraphrase, verbose_faithful, digit_change, minus_drop."""
    pick = lambda what, n: P.choose(seed, F.col("idx"), what, n)
    texts = F.transform("gold", lambda s: s["text"])
    n = F.size("gold")
    put = lambda at, new: F.transform(texts, lambda t, i: F.when(i == at, new).otherwise(t))
    word = F.get(F.array(*map(F.lit, ("よって ", "したがって ", "ゆえに "))), pick("word", 3))
    at = pick("step", n)
    known = F.flatten(F.transform(texts, T.number_tokens))
    token = F.get(known, pick("token", F.size(known)))
    token = F.when(pick("flip", 2) == 0, token).otherwise(F.when(token.startswith("-"), F.substring(token, F.lit(2), F.length(token))).otherwise(F.concat(F.lit("-"), token)))
    clause = F.get(F.array(F.concat(F.lit("両辺から "), token, F.lit(" を引くと、")), F.concat(F.lit("両辺を "), token, F.lit(" で割って、")), F.concat(F.lit("左辺の "), token, F.lit(" を消すために、"))), pick("clause", 3))
    text = F.get(texts, at)
    digits = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).rlike("[0-9]"))
    where = F.get(digits, pick("digit", F.size(digits)))
    new = ((F.substring(text, where, F.lit(1)).cast("int") + 1 + pick("by", 8)) % 10).cast("string")
    changed = put(at, F.concat(F.substring(text, F.lit(1), where - 1), new, F.substring(text, where + 1, F.length(text))))
    negative = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(texts, i).rlike("-[0-9]"))
    target = F.get(negative, pick("minus", F.greatest(F.lit(1), F.size(negative))))
    dropped = F.when(F.size(negative) > 0, put(target, F.regexp_replace(F.get(texts, target), r"^(.*?)-([0-9])", "$1$2"))).otherwise(changed)
    arms = {"clean": texts, "benign_paraphrase": put(at, F.concat(word, text)), "verbose_faithful": put(at, F.concat(clause, text)), "digit_change": changed, "minus_drop": dropped}
    return rows.select(*rows.columns, F.inline(F.array(*(F.struct(F.lit(k).alias("arm"), v.alias("texts")) for k, v in arms.items()))))


def gate_efficacy(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Per arm: texts, flagged texts and their share. Arms with a fault should be near 1, the others near 0."""
    rows = P.problems(spark, n, seed)
    rows = injected(rows.withColumn("gold", P.execute()[0]), seed)
    flagged = F.size(P.check_texts(F.col("gold"), F.col("texts"))) > 0
    return rows.withColumn("flagged", flagged).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("flagged_rate"))


# KPI


CONTROL, TNR = 0.30, 0.95


def kpi_expected(tpr: Column, type_accuracy: Column, severity_accuracy: Column, easy: Column) -> Column:
    """Expected share of exact scores: controls hit by the true negative rate; errors (one or two a sheet) need all of detection, type and severity, unless a sheet is easy."""
    rest = lambda p: F.greatest(F.lit(0.0), (p - easy) / (1 - easy))
    s = rest(tpr) * rest(type_accuracy) * rest(severity_accuracy)
    return CONTROL * TNR + (1 - CONTROL) * (easy + (1 - easy) * (s + s * s) / 2)


def kpi_grid(spark: SparkSession) -> DataFrame:
    """The grid of 7 x 3 x 3 rates with the expected score under independence and under a half of easy sheets."""
    values = lambda name, xs: F.explode(F.array(*map(F.lit, xs))).alias(name)
    grid = spark.range(1).select(values("tpr", (0.75, 0.80, 0.85, 0.90, 0.93, 0.95, 0.97)))
    grid = grid.select("tpr", values("type_accuracy", (0.80, 0.90, 0.95))).select("*", values("severity_accuracy", (0.80, 0.90, 0.95)))
    kpi = lambda easy: kpi_expected(F.col("tpr"), F.col("type_accuracy"), F.col("severity_accuracy"), F.lit(easy))
    return grid.select("*", kpi(0.0).alias("independent"), kpi(0.5).alias("correlated"))


def kpi_simulated(grid: DataFrame, trials: int = 20_000, seed: int = 7, easy: float = 0.0) -> DataFrame:
    """The same by simulation: ``trials`` rows a cell."""
    rest = lambda c: F.greatest(F.lit(0.0), (F.col(c) - easy) / (1 - easy))
    u = [F.rand(seed + i) for i in range(9)]
    rows = grid.select("tpr", "type_accuracy", "severity_accuracy", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).repartition("tpr", "type_accuracy", "severity_accuracy")
    rows = rows.select("*", *(x.alias(f"u{i}") for i, x in enumerate(u)))
    right = lambda a: (F.col(f"u{a}") < rest("tpr")) & (F.col(f"u{a + 1}") < rest("type_accuracy")) & (F.col(f"u{a + 2}") < rest("severity_accuracy"))
    errors = (F.col("u1") < easy) | right(3) & ((F.col("u2") < 0.5) | right(6))
    hit = F.when(F.col("u0") < CONTROL, F.col("u1") < TNR).otherwise(errors)
    return rows.groupBy("tpr", "type_accuracy", "severity_accuracy").agg(F.avg(hit.cast("double")).alias("rate"))
