"""Relabelling to the finest type that the surface of an answer can show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions import text as T
from labelframe.operators.programs import ARITH, required_step
from labelframe.schema import FAMILIES, FAMILY

MOVED, PRODUCT = FAMILIES


def family_of(kind: Column) -> Column:
    """The family of a type; the type itself outside the families."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FAMILY.items() for x in pair))[kind], kind)


def relabelled(operator: Column, legacy: Column, site: Column, gold: Column, mutant: Column, domain: Column) -> Column:
    """struct(type_identifiable, subtype_retained, ambiguous_cross_family, unidentifiable, bucket, reject) by the rules of the operator.

    ``gold`` and ``mutant``: the expression of the changed step. A moved term whose proposal equals the mechanical sign flip
    (white space aside) can't be told from a sign slip, nor a wrong product that is the right one without its minus, nor any wrong positive product.
    ``reject`` tells why a row has no label: no binary sign to flip, no numbers, or a product of zero.
    """
    moved_llm, product_llm = operator == "op-llm-transpose-misconception", operator == "op-llm-product-misconception"
    flipped = T.flip_last_binary_sign(gold)
    same = T.without_spaces(flipped) == T.without_spaces(mutant)
    q_r, values = T.integers(gold), T.integers(mutant)
    q, r, told = F.get(q_r, 0), F.get(q_r, 1), F.try_element_at(values, F.lit(-1))
    product = q * r
    dropped = (product < 0) & (told == F.abs(product))
    reject = F.when(moved_llm & flipped.isNull(), "no binary sign to flip").when(product_llm & (r.isNull() | told.isNull()), "no numbers of the product").when(product_llm & (product == 0), "product of zero")
    bucket = F.when(moved_llm, F.when(same, "equivalent").otherwise("subtype_retained")).when(product_llm, F.when(dropped, "negative_equivalent").when(product > 0, "positive_false_identifiable").otherwise("subtype_retained"))
    coarse = F.when((operator == "op-transpose-sign") | (bucket == "equivalent"), MOVED).when((operator == "op-mult-sign-drop") | bucket.isin("negative_equivalent", "positive_false_identifiable"), PRODUCT)
    near = product_llm & F.abs(told - product).isin(1, 2)
    slip = (operator == "op-arith-slip") & (site == "s2") & (domain == ARITH)
    no = lambda c: F.coalesce(c, F.lit(False))
    fields = {"type_identifiable": F.coalesce(coarse, legacy), "subtype_retained": no(bucket == "subtype_retained"), "ambiguous_cross_family": no(near) | no(slip), "unidentifiable": coarse.isNotNull(), "bucket": bucket, "ambiguous_product": no(near), "ambiguous_arith": no(slip), "reject": reject}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def relabel_map(records: DataFrame) -> DataFrame:
    """One row per error record: the relabel map's columns and the rule's details; ``reject`` is null where the rules apply."""
    error = F.get("injected_errors", 0)
    rows = records.where(F.size("injected_errors") > 0).select("sample_id", error["type"].alias("type_legacy"), error["operator"].alias("operator"), error["mutation_site"].alias("site"), F.col("problem.domain").alias("domain"), "gold_solution", "mutant_solution")
    needs = F.col("operator").isin("op-llm-transpose-misconception", "op-llm-product-misconception")
    step = lambda steps: F.when(needs, required_step(F.col(steps), F.col("site")))
    rows = rows.withColumn("_r", relabelled(F.col("operator"), F.col("type_legacy"), F.col("site"), step("gold_solution"), step("mutant_solution"), F.col("domain")))
    return rows.select("sample_id", "_r.type_identifiable", "_r.subtype_retained", "_r.ambiguous_cross_family", "type_legacy", "operator", "_r.unidentifiable", "_r.bucket", "_r.ambiguous_product", "_r.ambiguous_arith", "_r.reject")


def relabel_stats(rows: DataFrame) -> DataFrame:
    """One row of counts, and ``healthy``: no row that can't be told keeps a subtype."""
    n = F.count(F.lit(1))
    in_bucket = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return rows.agg(n.alias("n_error_records"), F.count_if("unidentifiable").alias("n_unidentifiable"), F.coalesce(F.try_divide(F.count_if("subtype_retained").cast("double"), n), F.lit(0.0)).alias("subtype_coverage"), in_bucket("equivalent"), in_bucket("negative_equivalent"), in_bucket("positive_false_identifiable"), in_bucket("subtype_retained"), F.count_if("ambiguous_product").alias("ambiguous_product"), F.count_if("ambiguous_arith").alias("ambiguous_arith"), F.count_if("ambiguous_cross_family").alias("ambiguous"), (F.count_if(F.col("unidentifiable") & F.col("subtype_retained")) == 0).alias("healthy"))


def attach(records: DataFrame, labels: DataFrame, key: str = "sample_id", mandatory: Column | None = None) -> DataFrame:
    """``records`` with the columns of the lookup table ``labels``. Rows where ``mandatory`` holds and no label is found make the job fail."""
    # a map has a row per record: Parquet files of millions of them pass for small, and a broadcast would hold all in the driver and each executor
    found = records.join(labels.withColumn("_found", F.lit(True)).hint("merge"), key, "left")
    if mandatory is None:
        return found.drop("_found")
    missing = mandatory & F.col("_found").isNull()
    # the check stands in a column that is used, so that the optimiser can't prune it
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return found.withColumn(key, checked.cast(records.schema[key].dataType)).drop("_found")


def missing(records: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """Keys of ``records`` without a label."""
    return records.join(labels, key, "left_anti").select(key)


def equivalence_rate(rows: DataFrame, group: str, left: Column, right: Column) -> DataFrame:
    """Per group: rows, rows whose two surfaces are equal (white space aside), their share."""
    same = T.without_spaces(left) == T.without_spaces(right)
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"), F.avg(F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)).alias("rho"))
