"""Pages made up of texts and rules, for tests and for tables that hold no geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.layout import ir
from galley.operators.tables import slices


def from_text(docs: DataFrame, per_line: int = 10, per_page: int = 40) -> DataFrame:
    """Pages of the words of documents (doc_id, text): lines of equal pitch, a head and a foot; every third page has a striped table at its foot, every fourth a chart, every fifth a box."""
    # Words, lines and pages are cut from a text where it is, so that texts alone are moved.
    whole = docs.where("doc_id is not null").select("doc_id", "text").repartition(slices(docs), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    cut = lambda a, n: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda p: F.slice(a, p * n + 1, F.lit(n))))
    words = whole.select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.posexplode(cut(F.col("w"), per_line * per_page)).alias("p", "w"))
    pages = words.select("doc_id", (F.col("p") + 1).alias("page"), F.transform(cut(F.col("w"), per_line), lambda ws: F.array_join(ws, " ")).alias("ts"))
    struct = lambda t, x0, y0, x1, s, bold: F.struct(
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + s).alias("y1"), t.alias("text"), s.alias("size"), (y0 + 0.8 * s).alias("baseline"), F.lit("Arial").alias("font"), bold.alias("bold"), F.lit(False).alias("italic"),
        F.lit(False).alias("mono"), F.lit(0.0).alias("dir_y"), F.lit(None).cast("string").alias("link"),
    )

    def own(t: Column, k: Column) -> Column:
        y, size = 72.0 + 13.0 * k + 8.0 * F.floor(k / 8), F.when((k == 0) & (F.length(t) < 60), 16.0).otherwise(10.0)
        return struct(t, F.lit(72.0), y, 72.0 + F.when(F.length(t) > 50, 468.0).otherwise(5.0 * F.length(t)), size, size > 10)

    page, no = F.col("page").cast("string"), F.lit(False)
    head = struct(F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" page "), page), F.lit(72.0), F.lit(30.0), F.lit(200.0), F.lit(10.0), no)
    foot = struct(page, F.lit(300.0), F.lit(760.0), F.lit(310.0), F.lit(10.0), no)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.array(*[struct(F.concat(F.lit(c), r.cast("string")), F.lit(80.0 + 150 * j), 650.0 + 20 * r, F.lit(100.0 + 150 * j), F.lit(10.0), no) for j, c in enumerate("ab")])))
    shape = lambda kind, x0, y0, x1, y1, fill: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(kind).alias("shape"), F.lit(fill).cast("string").alias("fill"), F.lit(None).cast("string").alias("stroke"), F.lit(1.0).alias("thick"))
    at = F.lit
    stripes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: shape("rect", at(72.0), 645.0 + 20 * r, at(400.0), 665.0 + 20 * r, "eeeeee"))
    chart, box = F.array(shape("curve", at(420.0), at(640.0), at(530.0), at(700.0), None)), F.array(shape("rect", at(60.0), at(68.0), at(560.0), at(86.0), "dddddd"))
    none = F.array().cast(ir._DRAWING)
    drawings = F.concat(F.when(F.col("page") % 3 == 0, stripes).otherwise(none), F.when(F.col("page") % 4 == 0, chart).otherwise(none), F.when(F.col("page") % 5 == 0, box).otherwise(none))
    texts = F.concat(F.transform("ts", own), F.array(head, foot), F.when(F.col("page") % 3 == 0, cells).otherwise(F.array().cast(ir._LINE)))
    return pages.select("doc_id", "page", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), texts.cast(ir._LINE).alias("lines"), drawings.cast(ir._DRAWING).alias("drawings"), F.array().cast(ir._IMAGE).alias("images"), F.array().cast(ir._GLYPH).alias("glyphs"))


def edge_cases(spark: SparkSession) -> DataFrame:
    """Documents of one page each: 1 landscape, 2 sizes that differ from page to page, 3 a line at an angle, 4 a tiny page, 5 huge letters, 6 an empty page."""

    def page(doc, number, w, h, *lines):
        return doc, number, w, h, [(x, y, x + 0.5 * s * len(t), y + s, t, s, y + 0.8 * s, "Arial", False, False, False, turn, None) for t, x, y, s, turn in lines], [], [], []

    made = [
        page(1, 1, 792.0, 612.0, ("landscape", 72.0, 72.0, 10.0, 0.0)), page(2, 1, 612.0, 792.0, ("first", 72.0, 72.0, 10.0, 0.0)), page(2, 2, 300.0, 300.0, ("second", 40.0, 40.0, 8.0, 0.0)),
        page(3, 1, 612.0, 792.0, ("turned", 72.0, 72.0, 10.0, 0.7), ("straight", 72.0, 100.0, 10.0, 0.0)), page(4, 1, 20.0, 20.0, ("t", 2.0, 2.0, 4.0, 0.0)), page(5, 1, 612.0, 792.0, ("HUGE", 10.0, 10.0, 300.0, 0.0)), page(6, 1, 612.0, 792.0),
    ]
    return spark.createDataFrame(made, ir.PAGE)
