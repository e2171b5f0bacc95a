"""Queries of windows, islands, order statistics and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley import tunables as K
from galley.functions import text as T
from galley.operators import sequence as S
from galley.plans import views as V
from galley.plans.registry import query


@query(rf"""
WITH {V.TEXT_LINES}, s AS (SELECT doc_id, n, source, substr(regexp_replace(trim(line), '\p{{Nd}}+', '#', 'g'), 1, 40) AS sig FROM text_lines),
g AS (SELECT source, sig, count(DISTINCT doc_id) AS n_pages, count(*) AS n_lines, min(doc_id) AS first_page FROM s WHERE sig <> '' GROUP BY source, sig)
SELECT * FROM g WHERE n_pages >= 2
""")
def repeated_line_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads: lines that repeat on pages. A source stands for a document, a document for its page.

    Pages are counted in two steps, so that a line that all documents have is one row per task and page.
    """
    sig = F.substring(T.digits_masked(F.col("line")), 1, 40)
    by_page = V.text_lines(spark, sf_dir).select("source", "doc_id", sig.alias("sig")).where("sig <> ''").groupBy("source", "sig", "doc_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("source", "sig").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_lines"), F.min("doc_id").alias("first_page")).where("n_pages >= 2")


@query(r"""
WITH v AS (SELECT l_suppkey, l_extendedprice AS v, coalesce(l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) > 50, false) AS fresh FROM lineitem),
c AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY l_suppkey ORDER BY v) AS cluster FROM v)
SELECT l_suppkey, CAST(cluster AS BIGINT) AS cluster, round(avg(v), 4) AS mean, count(*) AS n, min(v) AS low, max(v) AS high FROM c GROUP BY l_suppkey, cluster
""")
def chained_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.chained_clusters(V.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 50.0)
    return made.withColumn("mean", F.round("mean", 4))


@query(r"""
WITH c AS (SELECT o_custkey, round_even(o_totalprice, -4) AS v, count(*) AS n, min(o_orderkey) AS s FROM orders GROUP BY ALL)
SELECT o_custkey, v AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, s) = 1
""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_seen_mode(V.table(spark, sf_dir, "orders"), ["o_custkey"], F.bround("o_totalprice", -4), "o_orderkey")


@query(r"""
WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q, list_sort(list(l_extendedprice)) AS p, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, q[n // 2 + 1] AS upper_median, p[greatest(0, CAST(floor(0.2 * n) AS BIGINT) - 1) + 1] AS p20, p[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1] AS p90, n FROM s
""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem")
    a, b, c = S.upper_median(rows, ["l_suppkey"], "l_quantity"), S.low_fifth(rows, ["l_suppkey"], "l_extendedprice"), S.high_tenth(rows, ["l_suppkey"], "l_extendedprice")
    return a.join(b.drop("n"), "l_suppkey").join(c.drop("n"), "l_suppkey").select("l_suppkey", "upper_median", "p20", "p90", "n")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, g AS (SELECT doc_id, size, baseline - lag(baseline) OVER (PARTITION BY doc_id, page ORDER BY baseline) AS gap FROM lines),
k AS (SELECT doc_id, size, list_sort(list(gap)) AS l, count(*) AS n FROM g WHERE gap > 0 AND gap < 60 GROUP BY doc_id, size)
SELECT d.doc_id, s.size, coalesce(CASE WHEN k.n >= 3 THEN k.l[greatest(0, CAST(floor(0.2 * k.n) AS BIGINT) - 1) + 1] END, 12.0) AS pitch
FROM (SELECT DISTINCT doc_id FROM lines) d CROSS JOIN (SELECT unnest([10.0::DOUBLE, 14.0::DOUBLE]) AS size) s LEFT JOIN k ON k.doc_id = d.doc_id AND k.size = s.size
""")
def body_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch of each size: a low order statistic of baseline gaps, 12 where there are fewer than three."""
    lines = V.lines(spark, sf_dir)
    gap = F.col("baseline") - F.lag("baseline").over(Window.partitionBy("doc_id", "page").orderBy("baseline"))
    gaps = lines.select("doc_id", "size", gap.alias("gap")).where("gap > 0 AND gap < 60")
    found = S.low_fifth(gaps, ["doc_id", "size"], "gap", "pitch").where("n >= 3").drop("n")
    each = lines.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(10.0), F.lit(14.0))).alias("size"))
    return each.join(found, ["doc_id", "size"], "left").select("doc_id", "size", F.coalesce("pitch", F.lit(12.0)).alias("pitch"))


@query(rf"""
WITH {V.WORDS}, b AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS body, sum(length(word)) AS n FROM words GROUP BY ALL)
SELECT doc_id, body, CAST(n AS BIGINT) AS n_chars FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, body) = 1
""")
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_size = V.words(spark, sf_dir).groupBy("doc_id", (F.bround(F.col("size") * 2, 0) / 2).alias("body")).agg(F.sum(F.length("word")).alias("n_chars"))
    best = F.max_by(F.struct("body", "n_chars"), F.struct(F.col("n_chars"), -F.col("body")))
    return by_size.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.body", "b.n_chars")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, e AS (SELECT doc_id, round_even(x1, 0) AS x, count(*) AS n FROM lines GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM e GROUP BY doc_id)
SELECT doc_id, min(x) FILTER (n >= greatest(3, 0.02 * total)) AS low_edge, max(x) FILTER (n >= greatest(3, 0.02 * total)) AS high_edge, CAST(any_value(total) AS BIGINT) AS n_lines FROM e JOIN t USING (doc_id) GROUP BY doc_id
""")
def margin_by_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that at least three lines, and 2 % of them, share exactly."""
    edges = V.lines(spark, sf_dir).groupBy("doc_id", F.bround("x1", 0).alias("x")).agg(F.count("*").alias("n"))
    edges = edges.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    heavy = F.when(F.col("n") >= F.greatest(F.lit(3.0), 0.02 * F.col("total")), F.col("x"))
    return edges.groupBy("doc_id").agg(F.min(heavy).alias("low_edge"), F.max(heavy).alias("high_edge"), F.max("total").alias("n_lines"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, v AS (SELECT doc_id, x1, coalesce(x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1) > 2.5, false) AS fresh FROM lines WHERE x1 > 0.6 * 612),
c AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY x1) AS cluster FROM v),
m AS (SELECT doc_id, cluster, avg(x1) AS mean FROM c GROUP BY ALL),
k AS (SELECT m.doc_id, m.mean, count(*) AS mass, any_value(t.n) AS n FROM m JOIN v ON v.doc_id = m.doc_id AND abs(v.x1 - m.mean) <= 2.5 JOIN (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id) t ON t.doc_id = m.doc_id GROUP BY m.doc_id, m.cluster, m.mean)
SELECT doc_id, round(max(mean), 6) AS right_edge, max(mass) AS top_mass FROM k WHERE mass >= greatest(3, 0.08 * n) GROUP BY doc_id
""")
def margin_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rightmost cluster of right edges with a mass of three lines, and 8 % of them, within 2.5 of its mean."""
    ends = V.lines(spark, sf_dir).where(F.col("x1") > 0.6 * V.W).groupBy("doc_id", "x1").agg(F.count("*").alias("c"))
    made = S.islands(ends, ["doc_id"], ["x1"], lambda prev: F.col("x1") - prev("x1") > 2.5, "cluster")
    means = made.groupBy("doc_id", "cluster").agg((F.sum(F.col("x1") * F.col("c")) / F.sum("c")).alias("mean"))
    totals = ends.groupBy("doc_id").agg(F.sum("c").alias("n"))
    near = means.join(ends, "doc_id").where(F.abs(F.col("x1") - F.col("mean")) <= 2.5).groupBy("doc_id", "cluster", "mean").agg(F.sum("c").alias("mass"))
    heavy = near.join(totals, "doc_id").where(F.col("mass") >= F.greatest(F.lit(3.0), 0.08 * F.col("n")))
    return heavy.groupBy("doc_id").agg(F.round(F.max("mean"), 6).alias("right_edge"), F.max("mass").alias("top_mass"))


@query(rf"""
WITH {V.TEXT_LINES}, f AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM text_lines)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}')) AS n_hyphens, count(*) FILTER (regexp_matches(line, '[,;]$')) AS n_open,
    count(*) FILTER (regexp_matches(line, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}')) >= 6 AS hyphenated FROM f GROUP BY doc_id
""")
def hyphenation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = V.table(spark, sf_dir, "documents").select("doc_id", line.alias("l"))
    broken = F.size(F.filter("l", lambda x, i: x.rlike("\\p{L}-$") & F.coalesce(F.get("l", i + 1).rlike("^\\p{Ll}"), F.lit(False))))
    return docs.select("doc_id", broken.cast("bigint").alias("n_hyphens"), F.size(F.filter("l", lambda x: x.rlike("[,;]$"))).cast("bigint").alias("n_open"), (broken >= 6).alias("hyphenated"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, d AS (SELECT *, lag(baseline) OVER w AS pb, lag(size) OVER w AS ps, lag(x1) OVER w AS px FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
f AS (SELECT *, coalesce(baseline - pb > greatest(1.55 * 14, 14 + 4) OR greatest(size, ps) / least(size, ps) > 1.3 OR px < 400, false) AS brk FROM d),
p AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS para FROM f)
SELECT doc_id, page, CAST(para AS BIGINT) AS para, min(line) AS first_line, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY doc_id, page, para
""")
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs begin at wide baseline gaps, jumps of size, and behind short lines; a box per paragraph."""
    lines = V.lines(spark, sf_dir)
    lead = F.lit(14.0)
    made = S.islands(
        lines, ["doc_id", "page"], ["line"],
        lambda prev: (F.col("baseline") - prev("baseline") > F.greatest(K.LEAD_RATIO * lead, lead + K.LEAD_PLUS)) | (F.greatest("size", prev("size")) / F.least("size", prev("size")) > K.SIZE_JUMP) | (prev("x1") < 400), "para",
    )
    return made.groupBy("doc_id", "page", "para").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(r"""
WITH r AS (SELECT conv_id, turn, role, text, coalesce(role <> lag(role) OVER w, false) AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text_sha256, count(*) AS n FROM i GROUP BY conv_id, run
""")
def run_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one style become one run; the role stands for the style."""
    made = S.islands(V.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], lambda prev: F.col("role") != prev("role"), "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    return made.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.sha2(text, 256).alias("text_sha256"), F.count("*").alias("n"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}
SELECT doc_id, page, line, greatest(0.0, y0 + 2 * (line % 3) - coalesce(lag(y1) OVER (PARTITION BY doc_id, page ORDER BY line), 72.0)) AS space_before FROM lines
""")
def cursor_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space above an element: its top less the bottom of the one before, never negative."""
    bottom = F.coalesce(F.lag("y1").over(Window.partitionBy("doc_id", "page").orderBy("line")), F.lit(72.0))
    return V.lines(spark, sf_dir).select("doc_id", "page", "line", F.greatest(F.lit(0.0), F.col("y0") + 2 * (F.col("line") % 3) - bottom).alias("space_before"))


@query(r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity - greatest(2.0, 0.3 * l_quantity) AS room FROM lineitem),
s AS (SELECT *, coalesce(sum(greatest(0, room)) OVER (PARTITION BY l_orderkey ORDER BY room DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(greatest(0, room), 40 - before)), 6) AS paid FROM s
""")
def slack_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps pay for a page's overflow (40), the largest first, down to max(2, 0.3 gap)."""
    room = F.col("l_quantity") - F.greatest(F.lit(2.0), 0.3 * F.col("l_quantity"))
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", room.alias("room"))
    made = S.running(rows, ["l_orderkey"], [F.desc("room"), "l_linenumber"], F.greatest(F.lit(0.0), F.col("room")), "before", before=True)
    paid = F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), F.col("room")), 40 - F.col("before")))
    return made.select("l_orderkey", "l_linenumber", F.round(paid, 6).alias("paid"))


@query(r"""
WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS pages FROM documents),
f AS (SELECT *, pages > 40000 AS failed FROM r)
SELECT doc_id, source, CAST(pages AS BIGINT) AS pages, CASE WHEN coalesce(bool_or(failed) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'skipped' WHEN failed THEN 'failed' ELSE 'converted' END AS status FROM f
""")
def batch_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch stops at the document that crosses its page limit. Sources stand for batches, characters for pages.

    Ranges of a thousand ids are summed first, so that no task holds a whole batch.
    """
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 1000).alias("part"))
    before = S.running(rows.groupBy("source", "part").agg(F.sum("n_chars").alias("c")), ["source"], ["part"], F.col("c"), "before", before=True).drop("c")
    made = S.running(rows, ["source", "part"], ["doc_id"], F.col("n_chars"), "own").join(before, ["source", "part"])
    pages = F.col("own") + F.col("before")
    status = F.when(pages - F.col("n_chars") > 40000, "skipped").when(pages > 40000, "failed").otherwise("converted")
    return made.select("doc_id", "source", pages.alias("pages"), status.alias("status"))


@query(r"""
WITH b AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 600 SECOND, false) AS fresh FROM events),
i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM b),
r AS (SELECT user_id, run, count(*) AS len FROM i GROUP BY ALL)
SELECT user_id, max(len) AS longest, count(*) AS n_runs, count(*) FILTER (len >= 4) AS n_long FROM r GROUP BY user_id
""")
def longest_regular_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of boundaries at short intervals, the longest of them, and how many have four or more."""
    rows = V.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    made = S.islands(rows, ["user_id"], ["ts", "event_id"], lambda prev: F.col("t") - prev("t") > 600_000_000, "run")
    runs = made.groupBy("user_id", "run").agg(F.count("*").alias("len"))
    return runs.groupBy("user_id").agg(F.max("len").alias("longest"), F.count("*").alias("n_runs"), F.count_if(F.col("len") >= 4).alias("n_long"))


@query(r"""
WITH s AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY text) AS copies FROM documents) SELECT doc_id, copies FROM s WHERE r = 1
""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text. A hash of the text is what is shuffled, and a minimum what is kept of it."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(rf"""
WITH {V.WORDS}, p AS (SELECT doc_id, page, line // 3 AS para, max(size) AS size, count(DISTINCT line) AS n_lines, sum(length(word)) AS chars, sum(length(word)) FILTER (length(word) > 4) AS bold FROM words GROUP BY ALL),
h AS (SELECT doc_id, page, para, round_even(size + chars % 5, 1) AS size FROM p WHERE size >= 1.12 * 10 AND bold >= 0.6 * chars AND n_lines <= 3 AND chars < 200)
SELECT doc_id, page, para, size, CAST(least(6, dense_rank() OVER (ORDER BY size DESC)) AS INTEGER) AS level FROM h
""")
def heading_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels 1 to 6 of headings by distinct size, the largest first. Three lines stand for a paragraph, words of five letters or more for bold ones. Only distinct sizes are put in order."""
    p = V.words(spark, sf_dir).groupBy("doc_id", "page", F.floor(F.col("line") / 3).cast("int").alias("para"))
    p = p.agg(F.max("size").alias("size"), F.count_distinct("line").alias("n_lines"), F.sum(F.length("word")).alias("chars"), F.sum(F.when(F.length("word") > 4, F.length("word"))).alias("bold"))
    fit = (F.col("size") >= K.HEADING_RATIO * 10) & (F.col("bold") >= K.HEADING_BOLD * F.col("chars")) & (F.col("n_lines") <= K.HEADING_LINES) & (F.col("chars") < K.HEADING_CHARS)
    found = p.where(fit).select("doc_id", "page", "para", F.bround(F.col("size") + F.col("chars") % 5, 1).alias("size"))
    ranks = found.select("size").distinct().withColumn("level", F.least(F.lit(6), F.row_number().over(Window.orderBy(F.desc("size")))).cast("int"))
    return found.join(ranks, "size").select("doc_id", "page", "para", "size", "level")


@query(r"""
WITH r AS (SELECT source, doc_id // 1000 AS part, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY part)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY source
""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over the documents of a source in order: of ranges of a thousand ids first, then of the ranges' hashes."""
    rows = V.table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))

    def over(df: DataFrame, by: list[str], at: str, n: Column) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda x: x["h"]), "\n")
        return df.groupBy(*by).agg(F.sha2(joined, 256).alias("h"), n.alias("n"))

    ranges = over(rows.withColumn("part", F.floor(F.col("doc_id") / 1000)), ["source", "part"], "doc_id", F.count("*"))
    return over(ranges, ["source"], "part", F.sum("n")).select("source", F.col("h").alias("fingerprint"), "n")


@query(rf"""
WITH {V.WORDS}
SELECT doc_id, i, word, row_number() OVER (PARTITION BY doc_id ORDER BY page, round_even(y0, 1), x0, i) - 1 AS reading FROM words
""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page", F.bround("y0", 1), "x0", "i")
    return V.words(spark, sf_dir).select("doc_id", "i", "word", (F.row_number().over(w) - 1).cast("bigint").alias("reading"))


@query(rf"""
WITH {V.TEXT_LINES}, p AS (SELECT source, doc_id, regexp_extract_all(line, '\d+') AS v FROM text_lines WHERE n = 0), c AS (SELECT source, count(DISTINCT len(v)) AS arities, count(DISTINCT doc_id) AS n_pages FROM p GROUP BY source),
e AS (SELECT source, doc_id, v[k] AS x, k FROM (SELECT source, doc_id, v, unnest(range(1, len(v) + 1)) AS k FROM p))
SELECT e.source, CAST(k AS INTEGER) AS k, CASE WHEN any_value(arities) > 1 THEN 'LITERAL' WHEN bool_and(x = CAST(doc_id AS VARCHAR)) AND any_value(n_pages) >= 2 THEN 'PAGE' WHEN count(DISTINCT x) = 1 AND min(x) = CAST(any_value(n_pages) AS VARCHAR) THEN 'NUMPAGES' ELSE 'LITERAL' END AS role,
    count(*) AS n FROM e JOIN c USING (source) GROUP BY e.source, k
""")
def digit_role_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the k-th number of a running head is. A source stands for a document, a document's first line for the head of a page."""
    first = F.regexp_extract_all(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1), F.lit("\\d+"), F.lit(0))
    heads = V.table(spark, sf_dir, "documents").select("source", "doc_id", first.alias("v"))
    shape = heads.groupBy("source").agg(F.count_distinct(F.size("v")).alias("arities"), F.count_distinct("doc_id").alias("n_pages"))
    each = heads.select("source", "doc_id", F.posexplode("v").alias("k", "x")).groupBy("source", (F.col("k") + 1).alias("k"))
    found = each.agg(F.bool_and(F.col("x") == F.col("doc_id").cast("string")).alias("page"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).join(shape, "source")
    role = F.when(F.col("arities") > 1, "LITERAL").when(F.col("page") & (F.col("n_pages") >= 2), "PAGE").when((F.col("low") == F.col("high")) & (F.col("low") == F.col("n_pages").cast("string")), "NUMPAGES").otherwise("LITERAL")
    return found.select("source", "k", role.alias("role"), "n")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
SELECT doc_id, CAST(list_aggregate(list_transform(w, lambda x: length(x) + 1), 'sum') AS BIGINT) AS inked, len(w) AS n_words FROM w WHERE len(w) > 0
""")
def inked_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    total = F.aggregate(F.transform("w", lambda x: F.length(x) + 1), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return V.table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", total.alias("inked"), F.size("w").cast("bigint").alias("n_words"))


@query()
def greedy_wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of 468 points a text breaks into, word by word; a fold over the words of a row."""
    step = lambda s, w: F.when(
        s["at"] + F.when(s["at"] > 0, 5.0).otherwise(0.0) + w > 468.0, F.struct((s["n"] + 1).alias("n"), w.alias("at"))
    ).otherwise(F.struct(s["n"].alias("n"), (s["at"] + F.when(s["at"] > 0, 5.0).otherwise(0.0) + w).alias("at")))
    widths = F.transform(T.words(F.col("text")), lambda w: F.length(w) * 5.0)
    start = F.struct(F.lit(1).alias("n"), F.lit(0.0).alias("at"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.aggregate(widths, start, step, lambda s: s["n"]).alias("n_lines"))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, k AS (SELECT doc_id, page, sum(y1 - y0 + 4) AS used, count(*) AS n FROM lines GROUP BY ALL), u AS (SELECT doc_id, page, line, sum(y1 - y0 + 10) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS used FROM lines)
SELECT doc_id, page, count(*) FILTER (used > 648) AS stranded, max(used) - 648 AS over FROM u GROUP BY doc_id, page
""")
def page_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no longer fit a page, by the running height."""
    made = S.running(V.lines(spark, sf_dir), ["doc_id", "page"], ["line"], F.col("y1") - F.col("y0") + 10, "used")
    return made.groupBy("doc_id", "page").agg(F.count_if(F.col("used") > 648).alias("stranded"), (F.max("used") - 648).alias("over"))
