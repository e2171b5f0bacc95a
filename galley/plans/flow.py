"""Queries of spans, runs, elements, running heads and rows of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import flow as O
from galley.operators import spatial as X
from galley.plans import views as V
from galley.plans.registry import query
from galley.plans.spatial import RECTS, rects

SPANS = f"""{V.WORDS}, spans AS (SELECT doc_id, page, line, i, slot, word || '  ' AS text, size, length(word) > 6 AS bold, word[1] BETWEEN 'A' AND 'Z' AS italic, line % 9 = 8 AS mono FROM words)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as spans: long ones bold, capitals italic, every ninth line in a fixed pitch."""
    return V.words(spark, sf_dir).select(
        "doc_id", "page", "line", "i", "slot", F.concat("word", F.lit("  ")).alias("text"), "size", (F.length("word") > 6).alias("bold"), F.substring("word", 1, 1).between("A", "Z").alias("italic"), (F.col("line") % 9 == 8).alias("mono")
    )


@query(rf"""
WITH {SPANS} SELECT doc_id, round(size, 2) AS size, bold, italic, mono, count(*) AS n FROM spans GROUP BY ALL
""")
def span_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans each style of a document has."""
    s = spans(spark, sf_dir)
    return s.groupBy("doc_id", O.style_key(s.columns).alias("k")).agg(F.count("*").alias("n")).select("doc_id", "k.size", "k.bold", "k.italic", "k.mono", "n")


@query(rf"""
WITH {SPANS}, b AS (SELECT *, coalesce((size, bold, italic, mono) IS DISTINCT FROM lag((size, bold, italic, mono)) OVER w AND lag(i) OVER w IS NOT NULL, false) AS brk FROM spans WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY i)),
r AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY doc_id, page, line ORDER BY i) AS run FROM b)
SELECT doc_id, page, line, CAST(run AS BIGINT) AS run, any_value(bold) AS bold, CASE WHEN any_value(mono) THEN string_agg(text, '' ORDER BY i) ELSE regexp_replace(string_agg(text, '' ORDER BY i), ' {{2,}}', ' ', 'g') END AS text, count(*) AS n FROM r GROUP BY doc_id, page, line, run
""")
def spans_to_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one style as runs; repeated spaces are one, except in a fixed pitch."""
    return O.runs(spans(spark, sf_dir), ["doc_id", "page", "line"], "i").select("doc_id", "page", "line", "run", "style.bold", "text", "n")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, d AS (SELECT *, line // 4 AS block, CASE WHEN (doc_id + line // 2) % 3 = 0 THEN 0.5::DOUBLE ELSE 0.05 END AS dir_y FROM lines)
SELECT doc_id, page, block, count(*) FILTER (dir_y < 0.08) AS n_flow, count(*) FILTER (dir_y >= 0.08) AS n_rotated FROM d GROUP BY ALL HAVING count(*) FILTER (dir_y < 0.08) > 0
""")
def rotated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand at an angle leave the flow; blocks without a line left go."""
    keys = ["doc_id", "page", "block"]
    turned = F.when((F.col("doc_id") + F.floor(F.col("line") / 2)) % 3 == 0, 0.5).otherwise(0.05)
    lines = V.lines(spark, sf_dir).withColumns({"block": F.floor(F.col("line") / 4).cast("int"), "dir_y": turned})
    flow, out, blocks = O.split_rotated(lines, lines.select(*keys).distinct(), keys)
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return blocks.join(counted(flow, "n_flow"), keys).join(counted(out, "n_rotated"), keys, "left").withColumn("n_rotated", F.coalesce("n_rotated", F.lit(0)))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, {RECTS}, m AS (SELECT doc_id, page, 'block' AS kind, '•' AS text, x0 - 12 AS x0, y0 + 2 AS y0 FROM lines WHERE line % 5 = 1),
l AS (SELECT doc_id, page, 'line' AS kind, CAST(NULL AS VARCHAR) AS text, x0, y0 FROM lines), r AS (SELECT d.doc_id, 1 AS page, 'rect' AS kind, CAST(NULL AS VARCHAR) AS text, x0, y0 FROM rects, (SELECT DISTINCT doc_id FROM lines) d WHERE idx % 25 = d.doc_id % 25),
u AS (SELECT * FROM m UNION ALL SELECT * FROM l UNION ALL SELECT * FROM r)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0, 1), x0, kind) AS INTEGER) AS place FROM u
""")
def element_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets, lines and boxes as one stream of elements in reading order."""
    lines = V.lines(spark, sf_dir)
    marks = lines.where("line % 5 = 1").select("doc_id", "page", (F.col("x0") - 12).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") - 6).alias("x1"), (F.col("y0") + 8).alias("y1"), "size")
    boxes = lines.select("doc_id").distinct().join(F.broadcast(rects(spark, sf_dir)), F.col("idx") == F.col("doc_id") % 25).select("doc_id", F.lit(1).alias("page"), F.lit("rect").alias("kind"), "x0", "y0")
    stream = O.element_stream(O.bullet_blocks(marks, ["doc_id", "page"]), lines.select("doc_id", "page", F.lit("line").alias("kind"), "x0", "y0"), boxes, keys=["doc_id", "page"])
    return stream.select("doc_id", "page", "kind", "text", "x0", "y0", "place")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, {RECTS}, t AS (SELECT DISTINCT doc_id, page, line FROM lines l JOIN rects r ON (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1)
SELECT l.doc_id, l.page, l.line FROM lines l LEFT JOIN t USING (doc_id, page, line) WHERE t.doc_id IS NULL
""")
def consumed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no box has taken by their centre."""
    lines = V.lines(spark, sf_dir).select("doc_id", "page", "line", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    taken = X.points_in_boxes(lines, rects(spark, sf_dir), [], "cx", "cy")
    return O.without_consumed(lines, taken, ["doc_id", "page", "line"]).select("doc_id", "page", "line")


@query(rf"""
WITH {V.WORDS}, g AS (SELECT doc_id, page, line, i AS gid, x1 AS g_x1, y0 AS g_y0, y1 AS g_y1 FROM words WHERE length(word) <= 2)
SELECT g.doc_id, g.page, g.line, gid, arg_min(w.i, (w.x0, w.i)) AS lid FROM g JOIN words w USING (doc_id, page, line) WHERE length(w.word) > 2 AND w.x0 - g_x1 > 0 AND w.x0 - g_x1 <= 46 AND (g_y0 + g_y1) / 2 BETWEEN w.y0 AND w.y1 GROUP BY ALL
""")
def glyph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words as glyphs, with the leftmost text that begins near to their right at their height."""
    w = V.words(spark, sf_dir)
    glyphs = w.where(F.length("word") <= 2).select("doc_id", "page", "line", F.col("i").alias("gid"), F.col("x1").alias("g_x1"), F.col("y0").alias("g_y0"), F.col("y1").alias("g_y1"))
    return O.labelled(glyphs, w.where(F.length("word") > 2).select("doc_id", "page", "line", F.col("i").alias("lid"), "x0", "y0", "y1"), ["doc_id", "page", "line"])


HEADS = rf"""{V.WORDS}, {V.LINES}, p AS (SELECT DISTINCT doc_id, page FROM lines),
h AS (SELECT doc_id, page, 30.0::DOUBLE + 0.25 * (page % 3) AS y0, 42.0::DOUBLE AS y1, 'Report ' || doc_id || ' page ' || page AS text FROM p WHERE page % 4 < 3
    UNION ALL SELECT doc_id, page, 760.0, 770.0, CASE WHEN page % 3 = 0 THEN 'other ' || chr(CAST(65 + page % 26 AS INTEGER)) ELSE 'page ' || page || ' of 9' END FROM p UNION ALL SELECT doc_id, page, y0, y1, 'line ' || line FROM lines)"""


def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages, with heads on three of four and feet of two kinds."""
    lines = V.lines(spark, sf_dir)
    pages, page = lines.select("doc_id", "page").distinct(), F.col("page").cast("string")
    head = pages.where("page % 4 < 3").select("doc_id", "page", (30.0 + 0.25 * (F.col("page") % 3)).alias("y0"), F.lit(42.0).alias("y1"), F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" page "), page).alias("text"))
    foot = F.when(F.col("page") % 3 == 0, F.concat(F.lit("other "), F.char(65 + F.col("page") % 26))).otherwise(F.concat(F.lit("page "), page, F.lit(" of 9")))
    feet = pages.select("doc_id", "page", F.lit(760.0).alias("y0"), F.lit(770.0).alias("y1"), foot.alias("text"))
    return head.union(feet).union(lines.select("doc_id", "page", "y0", "y1", F.concat(F.lit("line "), F.col("line").cast("string"))))


@query(rf"""
WITH {HEADS}, z AS (SELECT doc_id, page, CASE WHEN y1 <= 62 THEN 'top' WHEN y0 >= 792 - 64 THEN 'bottom' END AS zone, round_even(y0 / 3, 0) AS y3, substr(regexp_replace(trim(text), '[0-9]+', '#', 'g'), 1, 40) AS sig FROM h),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM h GROUP BY doc_id)
SELECT z.doc_id, zone, y3, sig, count(DISTINCT page) AS n_pages FROM z JOIN n USING (doc_id) WHERE zone IS NOT NULL GROUP BY z.doc_id, zone, y3, sig, n.n HAVING count(DISTINCT page) >= greatest(2, round_even(0.6::DOUBLE * n.n, 0))
""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and feet: lines of a zone that recur, digits masked, on 60 % of the pages."""
    return O.running_heads(head_lines(spark, sf_dir), ["doc_id"], "page", V.H)


@query(rf"""
WITH {V.WORDS}, c AS (SELECT doc_id, page, line // 12 AS part, baseline + CASE WHEN line >= 24 THEN 80.0::DOUBLE ELSE 0 END AS baseline, x0 FROM words WHERE (length(word) + line) % 3 <> 0 AND slot IN (0, 4, 8)),
r AS (SELECT doc_id, page, baseline, count(*) AS cells, list_distinct(list(round_even(x0 / 7, 0))) AS xs FROM c GROUP BY doc_id, page, baseline HAVING count(*) >= 2),
i AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY baseline) AS grp FROM (SELECT *, coalesce(baseline - lag(baseline) OVER (PARTITION BY doc_id, page ORDER BY baseline) > 60, false) AS brk FROM r)),
k AS (SELECT doc_id, page, grp, x, count(*) AS n FROM (SELECT doc_id, page, grp, unnest(xs) AS x FROM i) GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT doc_id, page, grp, count(*) AS n_columns FROM k GROUP BY ALL HAVING count(*) >= 2)
SELECT i.doc_id, i.page, CAST(i.grp AS BIGINT) AS grp, count(*) AS n_rows, min(baseline) AS top, max(baseline) AS bottom, n_columns FROM i JOIN n USING (doc_id, page, grp) GROUP BY ALL HAVING count(*) >= 3
""")
def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rows of several cells at small pitch, whose columns recur; words at three places stand for cells."""
    shifted = F.col("baseline") + F.when(F.col("line") >= 24, 80.0).otherwise(0.0)
    cells = V.words(spark, sf_dir).where(((F.length("word") + F.col("line")) % 3 != 0) & F.col("slot").isin(0, 4, 8)).select("doc_id", "page", shifted.alias("baseline"), "x0")
    return O.table_rows(cells, ["doc_id", "page"])


@query(rf"""
WITH {V.WORDS}, {V.LINES}, a AS (SELECT doc_id, page, line // 4 AS para, line, CASE (doc_id + line // 4) % 4 WHEN 0 THEN x0 WHEN 1 THEN 306 - (x1 - x0) / 2 WHEN 2 THEN 540 - (x1 - x0) ELSE 72 END AS x0, CASE (doc_id + line // 4) % 4 WHEN 0 THEN x1 WHEN 1 THEN 306 + (x1 - x0) / 2 ELSE 540 END AS x1 FROM lines),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, para) AS n, row_number() OVER (PARTITION BY doc_id, page, para ORDER BY line) AS k FROM a),
p AS (SELECT doc_id, page, para, max(n) AS n_lines, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS mid, max(x0) - min(x0) AS l, min(x0) AS lo, max(x1) AS hi, max(x1) FILTER (k < n OR n = 1) AS ihi, min(x1) FILTER (k < n OR n = 1) AS ilo, arg_min(x0, line) AS f FROM n GROUP BY ALL)
SELECT doc_id, page, para, n_lines, lo - 72 AS indent, f - lo AS first_indent, CASE
    WHEN n_lines = 1 THEN CASE WHEN lo - 72 > 8 AND 540 - hi > 8 AND abs((lo + hi) / 2 - 306) <= 2.5 THEN 'center' WHEN lo - 72 > 10 AND 540 - hi <= 3 THEN 'right' ELSE 'left' END
    WHEN mid <= 2.5 AND lo - 72 > 3 THEN 'center' WHEN n_lines >= 3 AND ihi - ilo <= 3 AND l <= 3 THEN 'justify' WHEN n_lines = 2 AND 540 - ihi <= 3 AND l <= 3 THEN 'justify' WHEN 540 - hi <= 3 AND lo - 72 > 3 THEN 'right' ELSE 'left' END AS align FROM p
""")
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How paragraphs of four lines are set, and their indents; they are set in four ways in turn."""
    way, wide = (F.col("doc_id") + F.floor(F.col("line") / 4)) % 4, F.col("x1") - F.col("x0")
    x0 = F.when(way == 0, F.col("x0")).when(way == 1, 306 - wide / 2).when(way == 2, 540 - wide).otherwise(72.0)
    x1 = F.when(way == 0, F.col("x1")).when(way == 1, 306 + wide / 2).otherwise(540.0)
    lines = V.lines(spark, sf_dir).select("doc_id", "page", F.floor(F.col("line") / 4).cast("int").alias("para"), F.col("line").alias("seq"), x0.alias("x0"), x1.alias("x1"))
    return O.alignment(lines, ["doc_id", "page", "para"], 72.0, 540.0)


@query(rf"""
WITH {V.WORDS}, {V.LINES}, p AS (SELECT doc_id, page, 72.0::DOUBLE + 40 * (doc_id % 3) AS margin_b, 792.0::DOUBLE AS page_h, max(y1) AS low FROM lines GROUP BY ALL)
SELECT doc_id, page, (700.0::DOUBLE + page % 5 * 20 > page_h - margin_b) AND NOT low > page_h - margin_b AS relax FROM p
""")
def bottom_margin_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which only a figure reaches into the bottom margin."""
    lines = V.lines(spark, sf_dir)
    pages = lines.select("doc_id", "page").distinct().select("doc_id", "page", (72.0 + 40 * (F.col("doc_id") % 3)).alias("margin_b"), F.lit(792.0).alias("page_h"))
    figures = pages.select("doc_id", "page", (700.0 + F.col("page") % 5 * 20).alias("y1"))
    return O.may_relax_bottom(pages, figures, lines.select("doc_id", "page", "y1"), ["doc_id", "page"]).select("doc_id", "page", "relax")


@query(r"""
WITH r AS (SELECT p_partkey AS run, p_brand AS family, 400.0::DOUBLE + p_size * 7 AS mean_width FROM part), m AS (SELECT n_name AS candidate, 380.0::DOUBLE + n_nationkey * 17 AS width FROM nation)
SELECT run, family, mean_width, candidate AS replacement, abs(width - mean_width) AS deviation FROM r, m QUALIFY row_number() OVER (PARTITION BY run ORDER BY abs(width - mean_width), candidate) = 1
""")
def font_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's family replaced by the one whose mean width is nearest; nations stand for the families at hand."""
    r = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.col("p_brand").alias("family"), (400.0 + F.col("p_size") * 7).alias("mean_width"))
    return O.font_fit(r, V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("candidate"), (380.0 + F.col("n_nationkey") * 17).alias("width")))


@query(r"""
WITH i AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, 4 + vec_id % 3 AS w, 3 + vec_id % 5 AS h FROM embeddings), c AS (SELECT *, max(w) OVER (PARTITION BY pair) AS cw, max(h) OVER (PARTITION BY pair) AS ch FROM i)
SELECT pair, side, cw AS w, ch AS h, CAST(w * h * 100 + (cw * ch - w * h) * 255 AS BIGINT) AS total FROM c
""")
def pixel_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images of each pair on their common canvas, the rest white; the sum of their grey values."""
    k = F.col("vec_id")
    i = V.table(spark, sf_dir, "embeddings").select(F.floor(k / 2).alias("pair"), (k % 2).alias("side"), (4 + k % 3).alias("w"), (3 + k % 5).alias("h"))
    i = i.withColumn("px", F.transform(F.sequence(F.lit(1), F.col("h").cast("int")), lambda r: F.array_repeat(F.lit(100), F.col("w").cast("int"))))
    i = i.withColumns({"w": F.col("w").cast("int"), "h": F.col("h").cast("int")})
    total = F.aggregate(F.flatten("px"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return O.padded(i, ["pair"]).select("pair", "side", F.col("w").cast("bigint").alias("w"), F.col("h").cast("bigint").alias("h"), total.alias("total"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, e AS (SELECT doc_id, page, line // 8 AS eid, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM lines GROUP BY ALL)
SELECT e.doc_id, e.page, eid, count(*) AS n_lines, sum(y1 - y0) AS inked, max(y1) - min(y0) AS span FROM e JOIN lines l ON l.doc_id = e.doc_id AND l.page = e.page AND (x0 + x1) / 2 BETWEEN a AND c AND (y0 + y1) / 2 BETWEEN b AND d GROUP BY ALL
""")
def billing_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What height an element is billed for: the lines whose centres it holds."""
    lines = V.lines(spark, sf_dir)
    e = lines.groupBy("doc_id", "page", F.floor(F.col("line") / 8).cast("int").alias("eid")).agg(F.min("x0").alias("e_x0"), F.min("y0").alias("e_y0"), F.max("x1").alias("e_x1"), F.max("y1").alias("e_y1"))
    return O.billing(e, lines, ["doc_id", "page"])


@query(r"""
WITH f AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 3 THEN 100.0::DOUBLE ELSE 600 END AS x1, (l_linenumber - 1) * 22.0::DOUBLE + l_orderkey % 50 AS y0, (l_linenumber - 1) * 22.0::DOUBLE + l_orderkey % 50 + 18 + l_orderkey % 4 AS y1 FROM lineitem),
w AS (SELECT * FROM f WHERE x1 >= 0.95::DOUBLE * 612 AND y0 <= 220), u AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM w),
g AS (SELECT *, sum(CASE WHEN upto IS NULL THEN CAST(y0 > 36 AS INTEGER) ELSE CAST(y0 > upto + 3 AS INTEGER) END) OVER (PARTITION BY page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS gaps FROM u)
SELECT page, max(y1) AS height, count(*) AS n FROM g WHERE gaps = 0 GROUP BY page HAVING max(y1) > 45
""")
def cover_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of wide fills, one below another, that a page begins with."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    y0 = (n - 1) * 22.0 + k % 50
    fills = V.table(spark, sf_dir, "lineitem").select(k.alias("page"), F.lit(0.0).alias("x0"), F.when(n % 4 == 3, 100.0).otherwise(600.0).alias("x1"), y0.alias("y0"), (y0 + 18 + k % 4).alias("y1"))
    return O.cover_band(fills, ["page"], V.W)


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), p AS (SELECT doc_id, unnest(list_zip(w[2:6], w[3:7])) AS z, generate_subscripts(list_zip(w[2:6], w[3:7]), 1) AS k FROM w)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, z[1] AS a, z[2] AS b FROM p WHERE z[2] IS NOT NULL
""")
def slice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pairs of a slice of a document's words."""
    from galley.functions import text as T

    w = V.table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    zipped = F.arrays_zip(F.slice("w", 2, 5).alias("a"), F.slice("w", 3, 5).alias("b"))
    return w.select("doc_id", F.posexplode(zipped).alias("k", "z")).select("doc_id", "k", F.col("z.a").alias("a"), F.col("z.b").alias("b")).where("b is not null")
