"""Boxes as arrays [x0, y0, x1, y1] of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelframe.functions.numbers import bind

SCALE = 1000


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for a missing or degenerate box."""
    at = lambda box, i: F.get(box, i)
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(at(a, 0), at(b, 0)), F.least(at(a, 2), at(b, 2))) * side(F.greatest(at(a, 1), at(b, 1)), F.least(at(a, 3), at(b, 3)))
    area = lambda box: side(at(box, 0), at(box, 2)) * side(at(box, 1), at(box, 3))
    whole = area(a) + area(b) - inter
    return F.when((F.coalesce(F.size(a), F.lit(0)) == 4) & (F.coalesce(F.size(b), F.lit(0)) == 4) & (whole > 0), inter / whole).otherwise(0.0)


def best_iou(predicted: Column, truth: Column) -> Column:
    """The best ``iou`` of all pairs; 0 for none."""
    pairs = F.flatten(F.transform(predicted, lambda p: F.transform(truth, lambda t: iou(p, t))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def union(boxes: Column, strict: bool = False) -> Column:
    """The box around all boxes of four numbers; null for none. ``strict``: null if any box is malformed."""

    def around(good: Column) -> Column:
        edge = lambda pick, i: pick(F.transform(good, lambda b: b[i]))
        return F.when(F.size(good) > 0, F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 2), edge(F.array_max, 3)))

    whole = lambda b: F.coalesce(F.size(b) == 4, F.lit(False))
    out = bind(F.filter(boxes, whole), around)
    return F.when(F.forall(boxes, whole), out) if strict else out


def union_of(box: Column) -> Column:
    """Aggregate: the box around the boxes of four numbers; null for none. Partial sums of four numbers, no list."""
    fine = F.when(F.size(box) == 4, box)
    edges = [F.min(fine[0]), F.min(fine[1]), F.max(fine[2]), F.max(fine[3])]
    return F.when(edges[0].isNotNull(), F.array(*edges))


def outward(box: Column) -> Column:
    """The box rounded outward to whole numbers."""
    return bind(box, lambda b: F.when(b.isNotNull(), F.array(F.floor(b[0]), F.floor(b[1]), F.ceil(b[2]), F.ceil(b[3]))))


def relative(box: Column, width: Column, height: Column) -> Column:
    """The box on a scale of 0 to 1000, rounded half to even and clamped."""
    sides = (width, height, width, height)
    place = lambda b, i: F.greatest(F.lit(0), F.least(F.lit(SCALE), F.bround(b[i] * float(SCALE) / sides[i], 0).cast("int")))
    return bind(box, lambda b: F.when(b.isNotNull(), F.array(*(place(b, i) for i in range(4)))))


def sanitize(box: Column, width: Column, height: Column) -> Column:
    """The box clamped to the page; null unless it is four finite numbers with an area left."""
    fine = (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clamp = lambda i, most: F.greatest(F.lit(0.0), F.least(most, F.get(box, i)))
    x0, y0, x1, y1 = clamp(0, width), clamp(1, height), clamp(2, width), clamp(3, height)
    return F.when(F.coalesce(fine, F.lit(False)) & (x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def characters_between(chars: Column, lo: Column, hi: Column, widen: int = 4) -> Column:
    """Characters (structs with ``i``) with lo <= i < hi; if there are none those up to 1, 2 ... ``widen`` places off; else all."""

    def within(pad: int) -> Column:
        return F.filter(chars, lambda c: (c["i"] >= lo - pad) & (c["i"] < hi + pad))

    near = [within(pad) for pad in range(widen + 1)]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in near), chars)


def span_boxes(chars: Column) -> Column:
    """One outward box per row of characters (structs with ``row`` and ``bbox``), rows in order."""
    rows = F.array_sort(F.array_distinct(F.transform(chars, lambda c: c["row"])))
    return F.transform(rows, lambda r: outward(union(F.transform(F.filter(chars, lambda c: c["row"] == r), lambda c: c["bbox"]))))


def grid_place(cell: Column, columns: Column, start_x: Column, base_y: Column, pitch: Column, line_gap: Column) -> Column:
    """(row, column, x, y) of a cell in a grid of ``columns`` columns."""
    row, column = F.floor(cell / columns), F.pmod(cell, columns)
    return F.struct(row.cast("int").alias("row"), column.cast("int").alias("column"), (start_x + column * pitch).alias("x"), (base_y + row * line_gap).alias("y"))


def natural_places(advances: Column, noises: Column, start_x: float, wrap_x: float, right: float) -> Column:
    """(row, x) of characters set one after the other: a new row begins where an advance would pass ``right``."""
    start = F.struct(F.lit(float(start_x)).alias("x"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,x:double>>").alias("out"))

    def put(state: Column, pair: Column) -> Column:
        wraps = state["x"] + pair["a"] > right
        x, row = F.when(wraps, float(wrap_x)).otherwise(state["x"]), F.when(wraps, state["row"] + 1).otherwise(state["row"])
        return F.struct((x + pair["a"] + pair["n"]).alias("x"), row.alias("row"), F.concat(state["out"], F.array(F.struct(row.alias("row"), x.alias("x")))).alias("out"))

    pairs = F.transform(F.arrays_zip(advances.alias("a"), noises.alias("n")), lambda p: F.struct(p["a"].cast("double").alias("a"), p["n"].cast("double").alias("n")))
    return F.aggregate(pairs, start, put, lambda s: s["out"])


def fallback_rate(sources: Column) -> Column:
    """Share of glyph sources that are ``font``; 0 for none."""
    return F.when(F.size(sources) > 0, F.size(F.filter(sources, lambda s: s == "font")) / F.size(sources)).otherwise(0.0)


def alignment(gold: Column, mutant: Column, lo: Column, hi: Column) -> Column:
    """Per mutant character (stable id, grid cell), by the single span lo to hi of the mutant; null where the rest does not match.

    Characters before the span keep their places, those after it the places they have in the gold text, those in it get
    ids of their own and share the gold span's cells, so that nothing after it moves.
    """
    given = F.struct(gold.alias("g"), mutant.alias("m"), lo.alias("lo"), hi.alias("hi"), F.length(gold).alias("n"), F.length(mutant).alias("k"))

    def aligned(v: Column) -> Column:
        lo, hi, tail = v["lo"], v["hi"], v["k"] - v["hi"]
        gold_hi = v["n"] - tail
        part = lambda text, a, size: F.substring(text, a + 1, size)
        fine = (lo >= 0) & (lo < hi) & (hi <= v["k"]) & (gold_hi >= lo) & (part(v["g"], F.lit(0), lo) == part(v["m"], F.lit(0), lo)) & (part(v["g"], gold_hi, tail) == part(v["m"], hi, tail))
        cell = lambda i: F.when(i < lo, i).when(i >= hi, i - (v["k"] - v["n"])).otherwise(lo + F.least(i - lo, F.greatest(F.lit(0), gold_hi - lo - 1)))
        name = lambda i: F.when((i >= lo) & (i < hi), F.format_string("mutation:%d:%d", lo, i - lo)).otherwise(cell(i).cast("string"))
        return F.when(fine, F.transform(F.sequence(F.lit(0), v["k"] - 1), lambda i: F.struct(name(i).alias("id"), cell(i).alias("cell"))))

    return bind(given, aligned)
