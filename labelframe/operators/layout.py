"""Page geometry of records as numbers: one cell per character on a grid, boxes by step and by error span. No pixels are drawn.

A character's box is its cell (the font's size wide and high), moved by the writer's placement if settings are given. Twins
share cells outside the changed span, because cells follow the alignment with the gold text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import seeds
from labelframe.functions.numbers import bind
from labelframe.functions.text import SPACES
from labelframe.operators.programs import step_text

#: Page size, margins, first line and line height in pixels (fixed values).
PAGE_W, PAGE_H, MARGIN_X, TOP_Y, LINE_GAP = 1240, 1754, 150, 140, 96
INDENT, SIZE = 60, 44
PITCH = SIZE * 1.05


def steps_on_page() -> Column:
    """The mutant's steps, or the gold ones of a control."""
    return F.when(F.col("control_flag.error_free"), F.col("gold_solution")).otherwise(F.col("mutant_solution"))


def laid_out(records: DataFrame, settings: dict | None = None) -> DataFrame:
    """``records`` with ``render``: page, boxes by step, boxes of error spans by row, boxes of characters, alignment."""
    site, span = F.get("injected_errors", 0)["mutation_site"], F.get("injected_errors", 0)["span"]
    control = F.col("control_flag.error_free")
    lines = F.concat(F.array(F.struct(F.lit("problem").alias("key"), F.col("problem.text_ja").alias("text"))), F.transform(steps_on_page(), lambda s: F.struct(s["step_id"].alias("key"), s["text"].alias("text"))))
    plain = lambda t: F.transform(F.sequence(F.lit(0), F.length(t) - 1), lambda i: F.struct(i.cast("string").alias("id"), i.alias("cell")))
    changed = F.when(~control, G.alignment(step_text(F.col("gold_solution"), site), step_text(F.col("mutant_solution"), site), F.get(span, 0), F.get(span, 1)))
    rows = records.where(steps_on_page().isNotNull()).withColumns({"_lines": lines, "_changed": changed})

    def gridded(line: Column) -> Column:
        key, text = line["key"], line["text"]
        start = F.when(key == "problem", float(MARGIN_X)).otherwise(float(MARGIN_X + INDENT))
        columns = F.greatest(F.lit(1), F.floor((PAGE_W - MARGIN_X - start) / PITCH).cast("int"))
        aligned = F.when((key == site) & F.col("_changed").isNotNull(), F.col("_changed")).when(F.length(text) > 0, plain(text)).otherwise(F.array().cast("array<struct<id:string,cell:int>>"))
        return F.struct(key.alias("key"), text.alias("text"), aligned.alias("cells"), columns.alias("columns"), start.alias("start"))

    def counted(line: Column) -> Column:
        return line.withField("rows", F.coalesce(F.array_max(F.transform(line["cells"], lambda c: F.floor(c["cell"] / line["columns"]).cast("int"))), F.lit(0)) + 1)

    def lowered(line: Column, at: Column) -> Column:
        # heights of the lines above: a page has a handful of lines
        return line.withField("y", TOP_Y + LINE_GAP * F.aggregate(F.slice("_lines", F.lit(1), at), F.lit(0), lambda sum_, above: sum_ + above["rows"]))

    # a page's lines stay in its row: lines as rows would have to meet again in a shuffle, with all their characters
    rows = rows.withColumn("_lines", F.transform("_lines", gridded)).withColumn("_lines", F.transform("_lines", counted)).withColumn("_lines", F.transform("_lines", lowered))

    def box(line: Column, c: Column, i: Column) -> Column:
        def at(p: Column, x: Column, y: Column) -> Column:
            return F.struct(i.alias("i"), p["row"].alias("row"), F.substring(line["text"], i + 1, F.lit(1)).alias("char"), F.array(*(v.cast("double") for v in (x, y, x + SIZE, y + SIZE))).alias("bbox"), F.lit("font").alias("glyph_source"))

        def moved(p: Column) -> Column:
            if settings is None:
                return at(p, p["x"], p["y"])
            shift = seeds.placement(settings, F.col("pair_id"), line["key"], c["id"], p["row"], p["x"], F.lit(PITCH))
            return bind(F.struct(p["row"].alias("row"), (p["x"] + shift["spacing_offset_px"]).alias("x"), (p["y"] + shift["baseline_offset_px"]).alias("y")), lambda q: at(q, q["x"], q["y"]))

        return bind(G.grid_place(c["cell"], line["columns"], line["start"], line["y"], F.lit(PITCH), F.lit(LINE_GAP)), moved)

    chars = lambda line: F.filter(F.transform(line["cells"], lambda c, i: box(line, c, i)), lambda c: ~c["char"].rlike(f"^{SPACES}$"))
    rows = rows.withColumn("_all", F.transform("_lines", lambda line: F.struct(line["key"].alias("key"), chars(line).alias("chars"))))
    steps = F.filter("_all", lambda a: (a["key"] != "problem") & (F.size(a["chars"]) > 0))
    boxes = F.transform(steps, lambda a: F.struct(a["key"].alias("step_id"), F.transform(G.outward(G.union(F.transform(a["chars"], lambda c: c["bbox"]))), lambda v: v.cast("double")).alias("bbox")))
    of_site = lambda e: F.get(F.filter("_all", lambda a: a["key"] == e["mutation_site"]), 0)["chars"]
    spans = F.transform("injected_errors", lambda e, i: F.struct(i.alias("error_ref"), F.transform(G.span_boxes(G.characters_between(of_site(e), e["span"][0], e["span"][1])), lambda b: F.transform(b, lambda v: v.cast("double"))).alias("boxes")))
    spans = F.transform(spans, lambda s: F.struct(s["error_ref"].alias("error_ref"), s["boxes"].alias("boxes"), (F.size(s["boxes"]) > 1).alias("multiline")))
    every = F.flatten(F.transform(F.filter("_all", lambda a: a["key"] != "problem"), lambda a: F.transform(a["chars"], lambda c: c["glyph_source"])))
    exact = F.when(control | F.col("_changed").isNotNull(), "exact").otherwise("fallback")
    render = F.struct(seeds.style_id(F.col("pair_id")).alias("style_id"), F.struct(F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h")).alias("page"), boxes.alias("boxes_px"), spans.alias("error_span_boxes_px"), F.map_from_entries(F.transform(F.filter("_all", lambda a: a["key"] != "problem"), lambda a: F.struct(a["key"], a["chars"]))).alias("char_boxes_px"), seeds.pseudo_writer(F.col("pair_id")).alias("pseudo_writer_id"), G.fallback_rate(every).alias("glyph_fallback_rate"), exact.alias("char_id_alignment"), F.lit("grid").alias("pitch_mode"))
    return rows.withColumn("render", render).drop("_lines", "_all", "_changed")


def style_invariance(records: DataFrame) -> DataFrame:
    """One row: pairs, and pairs whose records all have one style."""
    by = records.groupBy("pair_id").agg(F.count_distinct("render.style_id").alias("n"))
    return by.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("n") == 1).alias("n_same"))


def box_acceptance(records: DataFrame, n: int = 100) -> DataFrame:
    """One row over the first ``n`` error records: how many have a box for their span, within the page."""
    inside = F.exists("render.error_span_boxes_px", lambda s: F.exists(s["boxes"], lambda b: (b[2] > b[0]) & (b[3] > b[1]) & (b[0] >= 0) & (b[2] <= PAGE_W) & (b[3] <= PAGE_H)))
    rows = records.where(F.size("injected_errors") > 0).orderBy("sample_id").limit(n)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_boxed"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("accepted"))
