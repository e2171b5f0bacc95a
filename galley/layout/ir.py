"""The table of objects on pages: text lines, drawings, images and undecoded glyphs, read from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import tunables as K
from galley.functions.geometry import Box, is_backdrop

#: A page as JSON has it: one line of a file, of any file system that Spark reads.
_BOX = "x0:double,y0:double,x1:double,y1:double"
_LINE = f"array<struct<{_BOX},text:string,size:double,baseline:double,font:string,bold:boolean,italic:boolean,mono:boolean,dir_y:double,link:string>>"
_DRAWING = f"array<struct<{_BOX},shape:string,fill:string,stroke:string,thick:double>>"
_IMAGE = f"array<struct<{_BOX},data:string>>"
_GLYPH = f"array<struct<{_BOX},size:double>>"
PAGE = f"doc_id bigint, page int, page_w double, page_h double, lines {_LINE}, drawings {_DRAWING}, images {_IMAGE}, glyphs {_GLYPH}"
OBJECTS = (
    "doc_id bigint, page int, page_w double, page_h double, kind string, oid bigint, x0 double, y0 double, x1 double, y1 double, text string, size double, baseline double, font string, "
    "bold boolean, italic boolean, mono boolean, dir_y double, link string, shape string, fill string, stroke string, thick double, data string"
)
_FIELDS = [tuple(f.split()) for f in OBJECTS.split(", ")]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON lines; a record that is no page fails the read."""
    return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)


def objects(pages: DataFrame) -> DataFrame:
    """One row per object: kind line, drawing, image or glyph, numbered within its page and kind. Pages are read once."""
    empty = F.array().cast(f"array<struct<kind:string,oid:bigint,{','.join(f'{n}:{t}' for n, t in _FIELDS[6:])}>>")

    def shaped(column: str, kind: str) -> Column:
        own = pages.schema[column].dataType.elementType.fieldNames()
        field = lambda o, n: o[n] if n in own else F.lit(None)
        return F.coalesce(F.transform(column, lambda o, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("oid"), *[field(o, n).cast(t).alias(n) for n, t in _FIELDS[6:]])), empty)

    each = [shaped(*x) for x in (("lines", "line"), ("drawings", "drawing"), ("images", "image"), ("glyphs", "glyph"))]
    return pages.select("doc_id", "page", "page_w", "page_h", F.inline(F.concat(*each))).select(*[F.col(n).cast(t).alias(n) for n, t in _FIELDS])


def normalised(rows: DataFrame) -> DataFrame:
    """Objects without backdrops, and rotated lines apart (kind rotated); drawn and undecoded marks before a line become its bullet.

    The steps go in this order. A mark needs a line that begins near to its right at its height, no other mark
    on that line, and a second mark of its kind on the page.
    """
    box = Box.of()
    light = (F.col("kind") == "drawing") & is_backdrop(box, F.col("fill"), F.col("page_w"), F.col("page_h"))
    rows = rows.where(~F.coalesce(light, F.lit(False)))
    turned = (F.col("kind") == "line") & (F.abs(F.coalesce("dir_y", F.lit(0.0))) >= K.ROTATED)
    rows = rows.withColumn("kind", F.when(turned, "rotated").otherwise(F.col("kind")))
    small = (box.width > 0.4) & (box.width <= 9) & (box.height > 0.4) & (box.height <= 9)
    mark = ((F.col("kind") == "drawing") & small & (F.abs(box.width - box.height) <= 2) & F.col("fill").isNotNull()) | (F.col("kind") == "glyph")
    page = ["doc_id", "page"]
    marks = rows.where(mark).select(*page, F.col("kind").alias("m_kind"), F.col("oid").alias("m_oid"), F.col("x1").alias("m_x1"), ((F.col("y0") + F.col("y1")) / 2).alias("m_y"))
    lines = rows.where("kind = 'line'").select(*page, "oid", "x0", "y0", "y1")
    near = marks.join(lines, page).where((F.col("x0") > F.col("m_x1")) & (F.col("x0") - F.col("m_x1") <= K.LABEL_REACH) & F.col("m_y").between(F.col("y0"), F.col("y1")))
    best = near.groupBy(*page, "m_kind", "m_oid").agg(F.min(F.struct("x0", "oid"))["oid"].alias("oid"))
    alone = best.groupBy(*page, "oid").agg(F.count("*").alias("n"), F.min("m_kind").alias("m_kind"), F.min("m_oid").alias("m_oid")).where("n = 1").drop("n")
    twice = alone.groupBy(*page, "m_kind").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    hit = alone.join(twice, [*page, "m_kind"])
    used = hit.select(*page, F.col("m_kind").alias("kind"), F.col("m_oid").alias("oid"))
    labelled = hit.select(*page, F.lit("line").alias("kind"), "oid", F.lit("• ").alias("bullet"))
    kept = rows.join(used, [*page, "kind", "oid"], "left_anti").where("kind != 'glyph'")
    return kept.join(labelled, [*page, "kind", "oid"], "left").withColumn("text", F.concat(F.coalesce("bullet", F.lit("")), "text")).drop("bullet").select(*[n for n, _ in _FIELDS])


def light_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, page, text, top, baseline, bottom): lines without styles, in reading order, for comparisons."""
    return rows.where("kind = 'line'").select("doc_id", "page", "oid", "text", F.col("y0").alias("top"), "baseline", F.col("y1").alias("bottom"))


def words(rows: DataFrame) -> DataFrame:
    """(doc_id, page, oid, k, word, x0, y0, x1, y1): words of lines with boxes by their share of the line's characters; a run of ideographs is split into characters."""
    pattern = "[\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]|[^\\x20\\x09-\\x0D\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]+|[\\x20\\x09-\\x0D]+"
    pieces = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    each = rows.where("kind = 'line' and text != ''").withColumn("p", pieces).withColumn("step", (F.col("x1") - F.col("x0")) / F.length("text"))
    before = lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    placed = F.transform("p", lambda x, i: F.struct(x.alias("word"), before(i).alias("at"), F.length(x).alias("n")))
    w = each.select("doc_id", "page", "oid", "x0", "y0", "y1", "step", F.posexplode(placed).alias("k", "w")).where(~F.col("w.word").rlike("^[\\x20\\x09-\\x0D]+$"))
    start = F.col("x0") + F.col("step") * F.col("w.at")
    return w.select("doc_id", "page", "oid", "k", F.col("w.word").alias("word"), start.alias("x0"), "y0", (start + F.col("step") * F.col("w.n")).alias("x1"), "y1")


def links(rows: DataFrame) -> DataFrame:
    """(doc_id, page, uri, x0, y0, x1, y1): what links cover, neighbouring lines of one target on a page as one box."""
    return rows.where("link is not null and link != ''").groupBy("doc_id", "page", F.col("link").alias("uri")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def census(rows: DataFrame) -> DataFrame:
    """(doc_id, page, n_lines, n_chars, n_drawings, n_images, n_glyphs, visual): the counts by which pages are classed; visual: an image over a quarter of it, or 30 drawings over a fifth."""
    of = lambda k: F.count_if(F.col("kind") == k)
    box = Box.of()
    counted = rows.groupBy("doc_id", "page").agg(
        of("line").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("kind") == "line", F.length("text"))), F.lit(0)).alias("n_chars"), of("drawing").alias("n_drawings"), of("image").alias("n_images"), of("glyph").alias("n_glyphs"),
        F.max(F.when(F.col("kind") == "image", box.area() / (F.col("page_w") * F.col("page_h")))).alias("i"), F.sum(F.when(F.col("kind") == "drawing", box.area() / (F.col("page_w") * F.col("page_h")))).alias("d"),
    )
    visual = F.coalesce(F.col("i") >= 0.25, F.lit(False)) | ((F.col("n_drawings") >= 30) & F.coalesce(F.col("d") >= 0.2, F.lit(False)))
    return counted.withColumn("visual", visual).drop("i", "d")
