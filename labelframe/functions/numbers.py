"""Numbers: safe ratios, rationals, percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: expressions are trees, so a value used n times would stand in the plan n times."""
    return F.get(F.transform(F.array(value), use), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def share(flag: Column, of: Column | None = None) -> Column:
    """Aggregate: mean of a flag (null counts as false) over the rows where ``of`` holds; null for no rows."""
    value = F.when(F.coalesce(flag, F.lit(False)), 1.0).otherwise(0.0)
    return F.avg(value if of is None else F.when(of, value))


def nearest_rank(value: Column, times: Column, p: float) -> Column:
    """Aggregate over distinct values with their numbers: the value at index (n - 1) p, rounded half to even, of all sorted values; 0 for none.

    What it gathers is one entry a distinct value, so count the values first.
    """
    entries = F.sort_array(F.collect_list(F.struct(value.cast("long").alias("v"), times.cast("long").alias("c"))))
    index = F.bround((F.sum(times) - 1) * F.lit(p), 0)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))
    step = lambda s, e: F.struct((s["seen"] + e["c"]).alias("seen"), F.coalesce(s["found"], F.when(s["seen"] + e["c"] > index, e["v"])).alias("found"))
    return F.coalesce(F.aggregate(entries, start, step, lambda s: s["found"]), F.lit(0).cast("long"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers by Euclid's rule, which takes five steps at most for each decimal digit of the smaller one, and one if that comes first."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    digits = F.length(F.least(F.abs(a).cast("long"), F.abs(b).cast("long")).cast("string"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(F.try_mod(s["a"], s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), 5 * digits), start, step, lambda s: s["a"])


def rational(num: Column, den: Column) -> Column:
    """(num, den) in lowest terms, den above zero."""
    whole = F.struct(num.cast("long").alias("n"), den.cast("long").alias("d"))
    signed = lambda v: F.when(v["d"] < 0, -1).otherwise(1) * F.greatest(F.lit(1).cast("long"), gcd(v["n"], v["d"]))
    reduced = lambda v: bind(F.struct(v["n"].alias("n"), v["d"].alias("d"), signed(v).alias("g")), lambda r: F.struct((r["n"] / r["g"]).cast("long").alias("num"), (r["d"] / r["g"]).cast("long").alias("den")))
    return bind(whole, reduced)


def rational_text(r: Column) -> Column:
    return F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.concat(r["num"].cast("string"), F.lit("/"), r["den"].cast("string")))


def rational_tokens(r: Column) -> Column:
    return F.when(r["den"] == 1, F.array(r["num"].cast("string"))).otherwise(F.array(r["num"].cast("string"), r["den"].cast("string")))
