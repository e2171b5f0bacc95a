"""Queries of spatial joins, columns, gutters and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions.geometry import Box
from galley.operators import sequence as S
from galley.operators import spatial as X
from galley.operators.tables import keep
from galley import tunables as K
from galley.plans import views as V
from galley.plans.registry import query

#: Rectangles on a page, by a closed formula over the nations.
RECTS = """rects AS (SELECT n_nationkey AS idx, 72.0::DOUBLE + (n_nationkey * 37) % 400 AS x0, 72.0::DOUBLE + (n_nationkey * 53) % 500 AS y0, 192.0::DOUBLE + (n_nationkey * 37) % 400 AS x1, 112.0::DOUBLE + (n_nationkey * 53) % 500 AS y1 FROM nation)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return V.table(spark, sf_dir, "nation").select(
        k.alias("idx"), (72.0 + (k * 37) % 400).alias("x0"), (72.0 + (k * 53) % 500).alias("y0"), (192.0 + (k * 37) % 400).alias("x1"), (112.0 + (k * 53) % 500).alias("y1")
    )


@query(rf"""
WITH {V.WORDS}, {RECTS}
SELECT w.doc_id, w.i, min(r.idx) AS link FROM words w JOIN rects r ON (w.x0 + w.x1) / 2 BETWEEN r.x0 AND r.x1 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY w.doc_id, w.i
""")
def char_in_rect_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link whose rectangle holds a glyph's centre."""
    points = V.words(spark, sf_dir).select("doc_id", "i", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return X.points_in_boxes(points, rects(spark, sf_dir), [], "cx", "cy").groupBy("doc_id", "i").agg(F.min("idx").alias("link"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, {RECTS}
SELECT l.doc_id, l.page, l.line, r.idx, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS overlap FROM lines l JOIN rects r
    ON (least(l.x1, r.x1) - greatest(l.x0, r.x0)) > 0 AND (least(l.y1, r.y1) - greatest(l.y0, r.y0)) > 0
    AND (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) > 0.55 * (l.x1 - l.x0) * (l.y1 - l.y0)
""")
def lines_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a rectangle covers by more than a share of their area."""
    pre = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") if c in ("x0", "y0", "x1", "y1") else F.col(c) for c in df.columns])
    lines = pre(V.lines(spark, sf_dir).select("doc_id", "page", "line", "x0", "y0", "x1", "y1"), "l_")
    both = X.boxes_over_boxes(lines, pre(rects(spark, sf_dir), "r_"), [])
    left = Box.of("l_")
    return both.withColumn("overlap", left.overlap(Box.of("r_"))).where(F.col("overlap") > K.COVERED * left.area()).select("doc_id", "page", "line", "idx", "overlap")


@query(rf"""
WITH {V.WORDS}, {RECTS}
SELECT doc_id, w.i, bool_or(r.idx IS NOT NULL) AS underlined FROM words w LEFT JOIN rects r ON r.x0 <= w.x0 + 1 AND r.x1 >= w.x1 - 1 AND r.y1 - w.baseline BETWEEN -1 AND 5 GROUP BY doc_id, w.i
""")
def underline_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans just above a rule (the lower edge of a rectangle) that reaches over them."""
    spans = V.words(spark, sf_dir)
    rules = rects(spark, sf_dir).select("idx", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y1").alias("y"))
    rules = rules.withColumn("row", F.explode(F.sequence(F.floor((F.col("y") - 5) / 8), F.floor((F.col("y") + 1) / 8))))
    hit = spans.select("doc_id", "i", "x0", "x1", "baseline", F.floor(F.col("baseline") / 8).alias("row")).join(rules, "row")
    hit = hit.where((F.col("a") <= F.col("x0") + 1) & (F.col("b") >= F.col("x1") - 1) & (F.col("y") - F.col("baseline")).between(-1, 5)).select("doc_id", "i").distinct().withColumn("hit", F.lit(True))
    return spans.select("doc_id", "i").join(hit, ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce("hit", F.lit(False)).alias("underlined"))


@query(rf"""
WITH {V.WORDS}, m AS (SELECT * FROM words WHERE length(word) <= 2), c AS (
    SELECT m.doc_id, m.i AS marker, w.i AS item, w.x0 - m.x1 AS gap FROM m JOIN words w ON w.doc_id = m.doc_id AND w.page = m.page AND abs(w.baseline - m.baseline) < 2.5 AND w.x0 - m.x1 > -1 AND w.x0 - m.x1 < 60 AND length(w.word) > 2)
SELECT doc_id, marker, item, gap FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, marker ORDER BY gap, item) = 1
""")
def nearest_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that a list marker stands before: on its baseline, within 60 points, the nearest."""
    w = V.words(spark, sf_dir)
    m = w.where(F.length("word") <= 2).select("doc_id", "page", "line", F.col("i").alias("marker"), F.col("x1").alias("end"), F.col("baseline").alias("mb"))
    near = m.join(w.where(F.length("word") > 2), ["doc_id", "page", "line"]).withColumn("gap", F.col("x0") - F.col("end")).where((F.abs(F.col("baseline") - F.col("mb")) < 2.5) & (F.col("gap") > -1) & (F.col("gap") < 60))
    return near.groupBy("doc_id", "marker").agg(F.min(F.struct("gap", F.col("i").alias("item"))).alias("b")).select("doc_id", "marker", "b.item", "b.gap")


@query(r"""
WITH e AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS at FROM events), o AS (SELECT o_custkey AS user_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS at, min(o_orderkey) AS el FROM orders GROUP BY ALL)
SELECT e.event_id, (SELECT o.el FROM o WHERE o.user_id = e.user_id AND o.at >= e.at ORDER BY o.at LIMIT 1) AS forward, (SELECT o.el FROM o WHERE o.user_id = e.user_id AND o.at <= e.at ORDER BY o.at DESC LIMIT 1) AS backward FROM e
""")
def dest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations to elements: the first at or below the position, and the last at or above it."""
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("at"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("at"), F.col("o_orderkey").alias("el"))
    both = X.asof(X.asof(e, o, ["user_id"], "at", "el", "forward"), o, ["user_id"], "at", "el", "backward", forward=False)
    return both.select("event_id", "forward", "backward")


_BANDS = [(72.0, 208.0), (222.0, 380.0), (394.0, 540.0)]


@query(rf"""
WITH {V.WORDS}, b AS (SELECT doc_id, page, line, slot // 3 AS part, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL),
bands AS (SELECT unnest([0, 1, 2]) AS band, unnest([72.0::DOUBLE, 222, 394]) AS a, unnest([208.0::DOUBLE, 380, 540]) AS z),
j AS (SELECT b.*, band, CASE WHEN x0 >= a - 1 AND x1 <= z + 1 THEN 0 ELSE 1 END AS outside, CASE WHEN x0 >= a - 1 AND x1 <= z + 1 THEN 0 ELSE -greatest(0.0, least(x1, z) - greatest(x0, a)) END AS o,
    CASE WHEN x0 >= a - 1 AND x1 <= z + 1 THEN 0 ELSE abs((x0 + x1) / 2 - (a + z) / 2) END AS d FROM b, bands)
SELECT doc_id, page, line, CAST(part AS BIGINT) AS part, CASE WHEN x1 - x0 <= 1.5 * 158 THEN band END AS band FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page, line, part ORDER BY outside, o, d, band) = 1
""")
def band_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.words(spark, sf_dir).groupBy("doc_id", "page", "line", F.floor(F.col("slot") / 3).alias("part")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return parts.select("doc_id", "page", "line", "part", X.band_of(F.col("x0"), F.col("x1"), _BANDS).alias("band"))


@query(rf"""
WITH {V.WORDS}, c AS (SELECT doc_id, i, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM words)
SELECT doc_id, i, CASE WHEN cx BETWEEN 71 AND 201 THEN 0 WHEN cx BETWEEN 199 AND 351 THEN 1 WHEN cx BETWEEN 349 AND 501 THEN 2 END AS col, CASE WHEN cy BETWEEN 71 AND 301 THEN 0 WHEN cy BETWEEN 299 AND 601 THEN 1 END AS row FROM c
""")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cell of a lattice whose bands hold a line's centre."""
    w = V.words(spark, sf_dir)
    return w.select("doc_id", "i", X.first_band((F.col("x0") + F.col("x1")) / 2, [72.0, 200.0, 350.0, 500.0]).alias("col"), X.first_band((F.col("y0") + F.col("y1")) / 2, [72.0, 300.0, 600.0]).alias("row"))


@query(rf"""
WITH {RECTS}, cells AS (SELECT s_suppkey AS cell, 72.0::DOUBLE + (s_suppkey * 11) % 420 AS x0, 72.0::DOUBLE + (s_suppkey * 17) % 540 AS y0, 112.0::DOUBLE + (s_suppkey * 11) % 420 AS x1, 92.0::DOUBLE + (s_suppkey * 17) % 540 AS y1 FROM supplier)
SELECT cell, min(idx) AS fill FROM cells c JOIN rects r ON greatest(0, least(c.x1, r.x1) - greatest(c.x0, r.x0)) * greatest(0, least(c.y1, r.y1) - greatest(c.y0, r.y0)) > 0.6 * (c.x1 - c.x0) * (c.y1 - c.y0) GROUP BY cell
""")
def shading_first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fill that covers more than 60 % of a cell."""
    k = F.col("s_suppkey")
    cells = V.table(spark, sf_dir, "supplier").select(k.alias("cell"), (72.0 + (k * 11) % 420).alias("l_x0"), (72.0 + (k * 17) % 540).alias("l_y0"), (112.0 + (k * 11) % 420).alias("l_x1"), (92.0 + (k * 17) % 540).alias("l_y1"))
    r = rects(spark, sf_dir)
    fills = r.select("idx", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    left = Box.of("l_")
    return X.boxes_over_boxes(cells, fills, []).where(left.overlap(Box.of("r_")) > 0.6 * left.area()).groupBy("cell").agg(F.min("idx").alias("fill"))


@query(rf"""
WITH {V.WORDS}, h AS (SELECT *, x0 + CASE WHEN (doc_id + line) % 4 = 0 AND slot >= 3 THEN 232.0::DOUBLE + 46.5 * (2 - n) ELSE 0 END AS a FROM (SELECT *, max(slot) OVER (PARTITION BY doc_id, page, line) - 3 AS n FROM words WHERE slot < 5)),
r AS (SELECT doc_id, page, line, min(a) AS lx0, max(a + x1 - x0) FILTER (slot < 3) AS lx1, min(a) FILTER (slot >= 3) AS rx0, max(CASE WHEN (doc_id + line) % 4 = 0 AND slot >= 3 THEN greatest(a + x1 - x0, 540) ELSE a + x1 - x0 END) AS rx1 FROM h GROUP BY ALL),
p AS (SELECT *, coalesce(lx0 <= 72 + 12 AND rx1 >= 540 - 3.5 AND rx0 - lx1 >= 12 AND rx1 - rx0 <= 0.3 * 468 AND lx1 - lx0 >= 0.2 * 468, false) AS pair FROM r)
SELECT doc_id, page, line, pair AND sum(CAST(pair AS INTEGER)) OVER (PARTITION BY doc_id, page) <= 0.35 * count(*) OVER (PARTITION BY doc_id, page) AS pair FROM p
""")
def row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two halves, left flush and right flush; a page where more than 35 % would pair has none. In every fourth row the words behind the third are set right."""
    w = V.words(spark, sf_dir).where("slot < 5").withColumn("n", F.max("slot").over(Window.partitionBy("doc_id", "page", "line")) - 3)
    moved = ((F.col("doc_id") + F.col("line")) % 4 == 0) & (F.col("slot") >= 3)
    w = w.withColumn("a", F.col("x0") + F.when(moved, 232.0 + 46.5 * (2 - F.col("n"))).otherwise(0.0))
    end = F.col("a") + F.col("x1") - F.col("x0")
    left = F.col("slot") < 3
    r = w.groupBy("doc_id", "page", "line").agg(F.min("a").alias("lx0"), F.max(F.when(left, end)).alias("lx1"), F.min(F.when(~left, F.col("a"))).alias("rx0"), F.max(F.when(moved, F.greatest(end, F.lit(540.0))).otherwise(end)).alias("rx1"))
    return X.row_pairs(r, ["doc_id", "page"], 72.0, 540.0).select("doc_id", "page", "line", "pair")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, b AS (SELECT doc_id, page, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT))) AS bin FROM words)
SELECT doc_id, page, bin, count(*) AS n FROM b GROUP BY ALL
""")
def projection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words cover each point across a page: spans count at their ends alone, and a running sum fills the points between."""
    ends = F.inline(F.array(F.struct(F.floor("x0").alias("bin"), F.lit(1).alias("d")), F.struct(F.floor("x1").alias("bin"), F.lit(-1).alias("d"))))
    steps = V.words(spark, sf_dir).select("doc_id", "page", ends).groupBy("doc_id", "page", "bin").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("doc_id", "page").orderBy("bin")
    made = steps.select("doc_id", "page", "bin", F.sum("d").over(along).alias("n"), F.lead("bin").over(along).alias("until")).where("n > 0")
    return made.select("doc_id", "page", F.explode(F.sequence("bin", F.col("until") - 1)).alias("bin"), "n")


@query(rf"""
WITH {V.WORDS}, r AS (SELECT doc_id, page, line, slot // 4 AS part, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, line) AS arity, lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0) AS px FROM r),
v AS (SELECT doc_id, page, arity, round_even((x0 + px) / 2 / 4, 0) AS key, count(*) AS votes FROM g WHERE x0 - px >= 1 AND arity BETWEEN 2 AND 3 GROUP BY ALL), n AS (SELECT doc_id, page, arity, count(DISTINCT line) AS rows FROM g GROUP BY ALL)
SELECT v.doc_id, v.page, v.arity, v.key, v.votes, n.rows FROM v JOIN n USING (doc_id, page, arity) WHERE n.rows >= 3 AND v.votes >= greatest(3, 0.6 * n.rows)
""")
def gutter_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows vote for the gaps between their parts; a gutter needs three votes and a share of the rows of its arity."""
    r = V.words(spark, sf_dir).groupBy("doc_id", "page", "line", F.floor(F.col("slot") / 4).alias("part")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    row = Window.partitionBy("doc_id", "page", "line")
    g = r.withColumns({"arity": F.count("*").over(row), "px": F.lag("x1").over(row.orderBy("x0")), "first": F.row_number().over(row.orderBy("x0")) == 1})
    # Rows and votes come from one table: rows by their first parts, votes by key.
    key = F.when(F.col("x0") - F.col("px") >= 1, F.bround((F.col("x0") + F.col("px")) / 2 / 4, 0))
    counted = g.where(F.col("arity").between(2, 3)).groupBy("doc_id", "page", "arity", key.alias("key")).agg(F.count("*").alias("votes"), F.count_if("first").alias("firsts"))
    votes = counted.withColumn("rows", F.sum("firsts").over(Window.partitionBy("doc_id", "page", "arity"))).drop("firsts")
    return votes.where("key is not null").where((F.col("rows") >= 3) & (F.col("votes") >= F.greatest(F.lit(3.0), K.GUTTER_SHARE * F.col("rows"))))


@query(rf"""
WITH {V.WORDS}, g AS (SELECT doc_id, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY slot) AS gap, x0 FROM words), m AS (SELECT doc_id, x0 - gap / 2 AS mid FROM g WHERE gap > 11),
f AS (SELECT *, coalesce(mid - lag(mid) OVER (PARTITION BY doc_id ORDER BY mid) > 3, false) AS fresh FROM m), c AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY mid) AS cluster FROM f)
SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, round(avg(mid), 6) AS at, count(*) AS n FROM c GROUP BY doc_id, cluster HAVING count(*) >= 4
""")
def recurring_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where wide gaps recur: clusters of four or more."""
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy("doc_id", "page", "line").orderBy("slot"))
    mids = V.words(spark, sf_dir).withColumn("gap", gap).where("gap > 11").select("doc_id", (F.col("x0") - F.col("gap") / 2).alias("mid"))
    return S.chained_clusters(mids, ["doc_id"], "mid", 3.0).where("n >= 4").select("doc_id", "cluster", F.round("mean", 6).alias("at"), "n")


@query(rf"""
WITH {V.WORDS} SELECT doc_id, page, line // 8 AS block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM words GROUP BY ALL
""")
def bbox_union_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).groupBy("doc_id", "page", F.floor(F.col("line") / 8).cast("int").alias("block")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


@query(r"""
WITH d AS (SELECT l_orderkey AS page, l_suppkey % 20 AS doc, round_even((l_partkey % 700) / 3.0::DOUBLE, 0) AS ky, round_even((l_suppkey % 500) / 5.0::DOUBLE, 0) AS kx, l_returnflag AS fill FROM lineitem)
SELECT doc, ky, kx, fill, count(DISTINCT page) AS n_pages FROM d GROUP BY ALL HAVING count(DISTINCT page) >= 3
""")
def drawing_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that recur at one place on several pages."""
    d = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 20).alias("doc"), F.bround((F.col("l_partkey") % 700) / 3.0, 0).alias("ky"), F.bround((F.col("l_suppkey") % 500) / 5.0, 0).alias("kx"), F.col("l_returnflag").alias("fill"))
    return d.distinct().groupBy("doc", "ky", "kx", "fill").agg(F.count("*").alias("n_pages")).where("n_pages >= 3")


@query(rf"""
WITH RECURSIVE d AS (SELECT p_partkey AS id, p_size % 5 AS page, 10.0::DOUBLE * (p_partkey % 97) AS x0, 10.0::DOUBLE * (p_partkey % 89) AS y0 FROM part),
e AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.page = b.page AND abs(a.x0 - b.x0) <= 14 AND abs(a.y0 - b.y0) <= 14),
r AS (SELECT id, id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS component FROM r GROUP BY id
""")
def touching_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings (8 by 8) joined by chains of neighbours at most 6 points apart."""
    k = F.col("p_partkey")
    d = V.table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") % 5).alias("page"), (10.0 * (k % 97)).alias("x0"), (10.0 * (k % 89)).alias("y0"))
    d = keep(d.withColumns({"x1": F.col("x0") + 8, "y1": F.col("y0") + 8}))
    return X.touching(d, ["page"], "id", 6.0, keep)


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, six to a page, and of a rendering of the same documents that drifts by a line in six."""
    lines = V.text_lines(spark, sf_dir)
    drift = F.col("n") + F.floor(F.col("n") / 6)
    source = lines.select("doc_id", (F.floor(F.col("n") / 6) + 1).alias("page"), "n", "line")
    return source, lines.select("doc_id", (F.floor(drift / 6) + 1).alias("rendered"), drift.alias("m"), "line")


PAGES = f"""{V.TEXT_LINES}, src AS (SELECT doc_id, n // 6 + 1 AS page, n, line FROM text_lines), ren AS (SELECT doc_id, (n + n // 6) // 6 + 1 AS rendered, n + n // 6 AS m, line FROM text_lines)"""


def page_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, rendered, votes): a page's first distinctive lines vote for the pages of the rendering that have them."""
    source, rendered = _pages(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("n"))
    first = source.where(F.length("line") >= K.DISTINCTIVE_CHARS).withColumn("place", place).where(F.col("place") <= K.VOTING_LINES)
    return first.join(rendered.select("doc_id", "rendered", "line").distinct(), ["doc_id", "line"]).groupBy("doc_id", "page", "rendered").agg(F.count("*").alias("votes"))


@query(rf"""
WITH {PAGES}, f AS (SELECT * FROM src WHERE length(line) >= 12 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n) <= 5)
SELECT f.doc_id, f.page, r.rendered, count(*) AS votes FROM f JOIN (SELECT DISTINCT doc_id, rendered, line FROM ren) r ON r.doc_id = f.doc_id AND r.line = f.line GROUP BY ALL
""")
def page_vote_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctive lines (12 characters), the first five of a page, vote for the page that they are rendered on."""
    return page_votes(spark, sf_dir)


@query(rf"""
WITH {PAGES}, a AS (SELECT doc_id, page, line, min(n) AS n FROM src WHERE line <> '' GROUP BY ALL HAVING count(*) = 1), b AS (SELECT doc_id, rendered, line, min(m) AS m FROM ren WHERE line <> '' GROUP BY ALL HAVING count(*) = 1),
d AS (SELECT doc_id, page, rendered, 14.0::DOUBLE * (m - n) AS dy FROM a JOIN b USING (doc_id, line)), s AS (SELECT doc_id, page, rendered, list_sort(list(dy)) AS l, count(*) AS n FROM d GROUP BY ALL)
SELECT doc_id, page, rendered, l[n // 2 + 1] AS dy, n FROM s
""")
def unique_text_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of a page and a page of its rendering: the upper median of dy over lines that are unique on both."""
    source, rendered = _pages(spark, sf_dir)
    once = lambda df, page, at: df.where("line <> ''").groupBy("doc_id", page, "line").agg(F.min(at).alias(at), F.count("*").alias("c")).where("c = 1").drop("c")
    d = once(source, "page", "n").join(once(rendered, "rendered", "m"), ["doc_id", "line"])
    return S.upper_median(d.withColumn("dy", 14.0 * (F.col("m") - F.col("n"))), ["doc_id", "page", "rendered"], "dy", "dy")


@query(r"""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unexpected' WHEN d.doc_id IS NULL THEN 'missing' WHEN d.n_chars % 7 <> l.doc_id % 7 THEN 'identity' ELSE 'same' END AS finding
FROM documents d FULL JOIN (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def coverage_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against a manifest: missing, unexpected, not the same."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    m = V.table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("want")).distinct()
    finding = F.when(F.col("want").isNull(), "unexpected").when(F.col("doc_id").isNull(), "missing").when(F.col("n_chars") % 7 != F.col("want") % 7, "identity").otherwise("same")
    return d.join(m, d["doc_id"] == m["want"], "full_outer").select(F.coalesce("doc_id", "want").alias("doc_id"), finding.alias("finding"))
