"""Corpus audits: coverage matrices, undecodable classes, characters out of vocabulary, sample matching, the glyph index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelframe.functions.numbers import nearest_rank
from labelframe.functions.seeds import labelled_digest, pick
from labelframe.functions.text import SPACES


def coverage(rows: DataFrame, writer: str, item: str, valid: Column | None = None) -> DataFrame:
    """(writer, n_classes): distinct classes of each valid writer."""
    rows = rows if valid is None else rows.where(valid)
    return rows.select(F.col(writer).alias("writer"), F.col(item).alias("item")).distinct().groupBy("writer").agg(F.count(F.lit(1)).alias("n_classes"))


def coverage_summary(rows: DataFrame, writer: str, item: str, expected: int | None = None, valid: Column | None = None) -> DataFrame:
    """One row: writers, classes, pairs, density of the matrix, spread of classes per writer, complete writers. Zeros for no rows."""
    observed = rows.agg(F.count_distinct(item).alias("n_observed"))
    # writers by their number of classes: no more rows than there are classes, so order statistics need no list of writers
    sizes = coverage(rows, writer, item, valid).groupBy("n_classes").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(observed))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n, c = F.col("n_classes"), F.col("c")
    complete = lambda least: zero(F.sum(F.when(n >= least, c)))
    out = sizes.agg(zero(F.sum(c)).alias("n_writers"), zero(F.sum(n * c)).alias("n_pairs"), zero(F.min(n)).alias("min"), nearest_rank(n, c, 0.05).alias("p05"), F.coalesce(F.percentile(n, 0.5, c), F.lit(0.0)).alias("median"), F.coalesce(F.try_divide(F.sum(n * c).cast("double"), F.sum(c)), F.lit(0.0)).alias("mean"), nearest_rank(n, c, 0.95).alias("p95"), zero(F.max(n)).alias("max"), complete(F.col("n_observed")).alias("n_complete_observed"), (complete(F.lit(expected)) if expected is not None else F.lit(0).cast("long")).alias("n_complete_expected"))
    out = out.join(F.broadcast(observed))
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("n_pairs").cast("double"), F.col("n_writers") * F.col("n_observed")), F.lit(0.0)))


def undecodable(rows: DataFrame, item: str, char: str, order: Column, *details: str) -> DataFrame:
    """Classes without a character: rows, and details of the first one in scan order."""
    first = F.min_by(F.struct(*details), order) if details else F.lit(None)
    return rows.where(F.col(char).isNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).orderBy(item)


def characters(rows: DataFrame, text: Column) -> DataFrame:
    """(char, n) of all characters but white space. Rows are counted partially before they are shuffled."""
    chars = rows.select(F.explode(F.split(F.regexp_replace(text, SPACES, ""), "")).alias("char")).where("char <> ''")
    return chars.groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def out_of_vocabulary(rows: DataFrame, text: Column, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: total, oov occurrences, rate, distinct; characters (char, codepoint, n) in code point order). ``available``: column char."""
    counted = characters(rows, text).join(available.select("char").distinct().withColumn("_known", F.lit(True)), "char", "left")
    unknown = F.col("_known").isNull()
    total = F.coalesce(F.sum("n"), F.lit(0))
    missing = F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0))
    stats = counted.agg(total.alias("total"), missing.alias("oov_occurrences"), F.coalesce(F.try_divide(missing.cast("double"), total), F.lit(0.0)).alias("oov_rate"), F.count_if(unknown).alias("distinct_oov"))
    return stats, counted.where(unknown).select("char", code_point(F.col("char")).alias("codepoint"), "n").orderBy("char")


def code_point(char: Column) -> Column:
    """U+ and at least four hex digits of a single character."""
    number = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def family_membership(sets: DataFrame, family: str, char: str) -> DataFrame:
    """(char, families): the sorted families that have each character."""
    return sets.select(family, char).distinct().groupBy(char).agg(F.array_sort(F.collect_set(family)).alias("families"))


def matched_samples(left: DataFrame, right: DataFrame, item: str, sheet: str, order: str, n: int) -> DataFrame:
    """For the first ``n`` classes of ``left`` in scan order: their first record and the match in ``right``: same sheet first, else first seen.

    Both sides: ``item``, ``sheet``, ``order``. Classes without a match are left out.
    """
    first = left.groupBy(item).agg(F.min_by(F.struct(F.col(order).alias("left_order"), F.col(sheet).alias("left_sheet")), order).alias("l")).select(item, "l.*").orderBy("left_order").limit(n)
    pairs = right.join(F.broadcast(first), item)
    best = F.min(F.struct((F.col(sheet) != F.col("left_sheet")).alias("_other"), F.col(order).alias("right_order"), F.col(sheet).alias("right_sheet")))
    return pairs.groupBy(item, "left_order", "left_sheet").agg(best.alias("b")).select(item, "left_order", "left_sheet", "b.right_order", "b.right_sheet")


def glyph_index(rows: DataFrame) -> DataFrame:
    """Long form of the index: (char, slot, family, path, record_index, writer), slots from 0 in order of family, path and place.

    A slot is the place within a file plus the character's glyphs in the files before, so a character of very many glyphs is numbered file by file.
    """
    own = rows.where(F.col("char").isNotNull()).select("char", "family", "path", "record_index", "writer")
    files = ["char", "family", "path"]
    sizes = own.groupBy(*files).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("char").orderBy("family", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.withColumn("_at", F.row_number().over(Window.partitionBy(*files).orderBy("record_index")))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in files]
    both = placed.alias("o").join(sizes.select(*files, before.alias("_before")).alias("f"), same)
    return both.select("o.char", (F.col("_before") + F.col("_at") - 1).alias("slot"), "o.family", "o.path", "record_index", "writer")


def glyph_summary(index: DataFrame) -> DataFrame:
    """Per family: glyphs, characters, writers."""
    return index.groupBy("family").agg(F.count(F.lit(1)).alias("n_glyphs"), F.count_distinct("char").alias("n_chars"), F.count_distinct("writer").alias("n_writers"))


def picked_glyphs(wanted: DataFrame, index: DataFrame, writer: str, char: str) -> DataFrame:
    """``wanted`` with the glyph of the index that the hash of (writer, char) picks; null where the character has none."""
    sizes = index.groupBy("char").agg(F.count(F.lit(1)).alias("_n"))
    rows = wanted.join(sizes, wanted[char] == sizes["char"], "left").drop(sizes["char"])
    rows = rows.withColumn("_slot", pick(labelled_digest(writer=F.col(writer), char=F.col(char)), F.col("_n")))
    found = index.select(F.col("char").alias("_c"), F.col("slot").alias("_s"), "family", "path", "record_index")
    return rows.join(found, (F.col(char) == F.col("_c")) & (F.col("_slot") == F.col("_s")), "left").drop("_c", "_s", "_n")
