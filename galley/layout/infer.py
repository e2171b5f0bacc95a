"""Layout of documents: objects of pages to elements in reading order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from galley import tunables as K
from galley.functions import text as T
from galley.layout.ir import normalised
from galley.layout.page import Page
from galley.operators import flow as O
from galley.operators import sequence as S
from galley.operators.tables import keep

ELEMENTS = "doc_id bigint, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, style string, text string, size double, bold boolean, n_lines int, detail string"


def margins(rows: DataFrame) -> DataFrame:
    """(doc_id, col_l, col_r): the leftmost cluster of left edges, and the rightmost of right edges, with enough lines; the default margin where there is none."""

    def edge(lines: DataFrame, value: str, name: str, last: bool) -> DataFrame:
        made = S.chained_clusters(lines, ["doc_id"], value, K.MARGIN_TOL).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
        heavy = made.where(F.col("n") >= F.greatest(F.lit(3.0), K.MARGIN_MASS * F.col("total")))
        return heavy.groupBy("doc_id").agg((F.max("mean") if last else F.min("mean")).alias(name))

    lines = rows.where("kind = 'line'")
    wide = F.col("x1") - F.col("x0") >= 0.45 * F.col("page_w")
    left = edge(lines.where(F.col("x0") < 0.35 * F.col("page_w")), "x0", "col_l", False)
    right = edge(lines.where(wide & (F.col("x1") > 0.6 * F.col("page_w"))), "x1", "col_r", True)
    width = rows.groupBy("doc_id").agg(F.max("page_w").alias("w"))
    met = width.join(left, "doc_id", "left").join(right, "doc_id", "left")
    return met.select("doc_id", F.coalesce("col_l", F.lit(K.MARGIN_DEFAULT)).alias("col_l"), F.coalesce("col_r", F.col("w") - F.coalesce("col_l", F.lit(K.MARGIN_DEFAULT))).alias("col_r"))


def heads_and_feet(rows: DataFrame) -> DataFrame:
    """Lines (doc_id, page, oid, zone) that are running heads or feet; page heights may differ."""
    lines = rows.where("kind = 'line'")
    shifted = lines.withColumns({"y0": F.col("y0") + (1000.0 - F.col("page_h")) * (F.col("y0") >= F.col("page_h") - K.BOTTOM_ZONE).cast("int"), "y": F.col("y0")})
    found = O.running_heads(shifted.select("doc_id", "page", "y0", "y1", "text"), ["doc_id"], "page", 1000.0)
    sig = F.substring(T.digits_masked(F.col("text")), 1, 40)
    return shifted.withColumns({"sig": sig, "y3": F.bround(F.col("y0") / 3, 0)}).join(found, ["doc_id", "sig", "y3"]).select("doc_id", "page", "oid", "zone")


def page_fields(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, page, zone, seq, text) of heads and feet, one row per line: numbers that equal the page's are {PAGE}, the number of pages behind a word for "of" is {NUMPAGES}."""
    lines = rows.where("kind = 'line'").join(zones, ["doc_id", "page", "oid"])
    total = rows.groupBy("doc_id").agg(F.max("page").alias("n"))
    own = F.regexp_replace("text", F.concat(F.lit("(?<!\\d)"), F.col("page").cast("string"), F.lit("(?!\\d)")), "{PAGE}")
    both = F.regexp_replace(own, F.concat(F.lit("(/|\\bof|\\bde|\\bvon|\\bsur)(\\s*)"), F.col("n").cast("string"), F.lit("(?!\\d)")), "$1$2{NUMPAGES}")
    seq = F.row_number().over(Window.partitionBy("doc_id", "page", "zone").orderBy("y0", "x0"))
    return lines.join(total, "doc_id").select("doc_id", "page", "zone", seq.alias("seq"), both.alias("text"))


def infer(rows: DataFrame) -> DataFrame:
    """Elements of the pages of a table of objects: paragraphs, headings, tables, boxes, figures, rules, images, heads and feet.

    Margins, running heads and heading levels are relations over documents; what a page's drawings and lines
    make is a fold in which elements take lines, one call per page. A page without objects has no elements.
    Tables that go on over a page are one element, at their first page. detail is JSON: rows of a table,
    alignment, indents, leading and marker of a paragraph, level of a heading.
    """
    rows = keep(normalised(rows))
    zones = keep(heads_and_feet(rows))
    flow = rows.join(zones.withColumn("kind", F.lit("line")), ["doc_id", "page", "oid", "kind"], "left_anti")

    used = ("doc_id", "page", "page_w", "page_h", "kind", "x0", "y0", "x1", "y1", "text", "size", "baseline", "bold", "mono", "shape", "fill", "stroke", "thick", "data", "col_l", "col_r")
    base = ("kind", "x0", "y0", "x1", "y1", "style", "text", "size", "bold", "n_lines")

    def assemble(objects: list[dict]) -> list[dict]:
        first = objects[0]
        made = Page(objects, first["page_w"], first["page_h"], first["col_l"], first["col_r"]).assemble()
        return [{"doc_id": first["doc_id"], "page": first["page"], "seq": i, **{k: e.get(k) for k in base}, "detail": json.dumps({k: v for k, v in sorted(e.items()) if k not in base}, ensure_ascii=False)} for i, e in enumerate(made)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for o in batch.to_pylist():
                if o["at"] == 1 and page:
                    out += assemble(page)
                    page = []
                page.append(o)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        out += assemble(page) if page else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS))
    # A window brings a page's objects together and in order; the fold then takes page after page of a task, with no call for each.
    placed = flow.join(margins(rows), "doc_id").select(*used, F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("kind", "oid")).alias("at"))
    made = keep(placed.mapInArrow(fold, ELEMENTS))
    parts = page_fields(rows, zones).select("doc_id", "page", F.col("seq").cast("int").alias("seq"), F.when(F.col("zone") == "top", "header").otherwise("footer").alias("kind"), "text")
    return continued(headings(made, flow)).unionByName(parts, allowMissingColumns=True)


def headings(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """Elements with paragraphs as headings where they are large against the body, mostly bold, and short; the level is the rank of the size in the document."""
    by_size = rows.where("kind = 'line'").groupBy("doc_id", (F.bround(F.col("size") * 2, 0) / 2).alias("s")).agg(F.sum(F.length("text")).alias("c"))
    body = by_size.groupBy("doc_id").agg(F.max_by("s", F.struct("c", -F.col("s"))).alias("body"))
    fit = (F.col("kind") == "para") & (F.col("size") >= K.HEADING_RATIO * F.col("body")) & F.col("bold") & (F.col("n_lines") <= K.HEADING_LINES) & (F.length("text") < K.HEADING_CHARS)
    marked = elements.join(body, "doc_id", "left").withColumn("h", F.coalesce(fit, F.lit(False)))
    sizes = marked.where("h").select(F.col("doc_id").alias("of"), F.round("size", 1).alias("hs")).distinct()
    level = sizes.withColumn("level", F.least(F.lit(6), F.row_number().over(Window.partitionBy("of").orderBy(F.desc("hs")))))
    met = marked.join(level, (F.col("doc_id") == F.col("of")) & F.col("h") & (F.round("size", 1) == F.col("hs")), "left")
    return met.select(*[c for c in elements.columns if c not in ("kind", "style")], F.when(F.col("h"), "heading").otherwise(F.col("kind")).alias("kind"), F.when(F.col("h"), F.concat(F.lit("level "), F.col("level").cast("string"))).otherwise(F.col("style")).alias("style")).select(*elements.columns)


def continued(elements: DataFrame) -> DataFrame:
    """Elements with striped tables that go on over pages as one: the last of its page, then the only element of the next one, with the same columns and edges; a repeated first row goes."""
    place = Window.partitionBy("doc_id").orderBy("page", "seq")
    on_page = Window.partitionBy("doc_id", "page")
    shape = F.when((F.col("kind") == "table") & (F.col("style") == "stripes"), F.size(F.from_json(F.get_json_object("detail", "$.rows[0]"), "array<string>")))
    e = elements.withColumns({"cols": shape, "alone": F.count("*").over(on_page) == 1, "last": F.row_number().over(on_page.orderBy(F.desc("seq"))) == 1})
    before = lambda c: F.lag(c).over(place)
    goes_on = F.coalesce((F.col("cols") == before("cols")) & F.col("alone") & before("last") & (F.col("page") == before("page") + 1) & (F.abs(F.col("x0") - before("x0")) <= 2) & (F.abs(F.col("x1") - before("x1")) <= 2), F.lit(False))
    e = e.withColumn("seg", F.sum((~goes_on).cast("int")).over(place))
    kind = "array<array<struct<fill:string,text:string>>>"
    rows = F.from_json(F.get_json_object("detail", "$.rows"), kind)
    joined = e.where("cols is not null").select("doc_id", "seg", "page", rows.alias("rows")).groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(F.struct("page", "rows"))).alias("p")).where("size(p) > 1")
    head = F.col("p")[0]["rows"][0]
    texts = lambda r: F.transform(r, lambda c: c["text"])
    tail = lambda r: F.when(texts(r[0]) == texts(head), F.slice(r, 2, F.greatest(F.lit(1), F.size(r)))).otherwise(r)
    all_rows = F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["rows"]).otherwise(tail(x["rows"]))))
    whole = joined.select("doc_id", "seg", F.to_json(F.struct(F.size("p").alias("pages"), all_rows.alias("rows"))).alias("merged"))
    kept = e.join(whole, ["doc_id", "seg"], "left").withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "seg").orderBy("page")) == 1).where("merged is null or first")
    return kept.withColumn("detail", F.coalesce("merged", "detail")).select(*elements.columns)
