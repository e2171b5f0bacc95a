"""Queries of gates, parity, policies and document classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.operators import gate as Q
from galley.operators.tables import keep
from galley.plans import views as V
from galley.plans.registry import query

#: Metric rows by closed formulas over documents: the candidate's, and the recorded ones of documents with labels.
ROWS = """measured AS (SELECT doc_id, CAST(n_chars % 3 = 0 AS INTEGER)::DOUBLE AS page_err, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (90 + n_chars % 12) / 100.0::DOUBLE END AS live_text_cov, (92 + n_chars % 9) / 100.0::DOUBLE AS doc_recall,
    (88 + n_chars % 13) / 100.0::DOUBLE AS word_recall, (n_chars % 10) / 10.0::DOUBLE AS within2pt, (n_chars % 41) / 10.0::DOUBLE AS dy_p50, (n_chars % 5) / 100.0::DOUBLE AS raster_frac FROM documents),
base AS (SELECT DISTINCT d.doc_id, 0.0::DOUBLE AS page_err, 0.96::DOUBLE AS live_text_cov, 0.96::DOUBLE AS doc_recall, 0.93::DOUBLE AS word_recall, 0.5::DOUBLE AS within2pt, 2.0::DOUBLE AS dy_p50, 0.02::DOUBLE AS raster_frac FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT -7, 0.0, 0.96, 0.96, 0.93, 0.5, 2.0, 0.02),
spec AS (SELECT * FROM (VALUES ('page_err', 'lower', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('live_text_cov', 'higher', 0.95, 0.010, 0.0), ('doc_recall', 'higher', 0.95, 0.010, 0.0), ('word_recall', 'higher', 0.90, 0.020, 0.0), ('within2pt', 'higher', NULL, 0.050, 0.0), ('dy_p50', 'lower', NULL, 0.5, 0.1), ('raster_frac', 'lower', NULL, 0.020, 0.0)) t(metric, better, threshold, absolute, relative)),
nowl AS (SELECT doc_id, metric, value, true AS here FROM (FROM measured UNPIVOT INCLUDE NULLS (value FOR metric IN (page_err, live_text_cov, doc_recall, word_recall, within2pt, dy_p50, raster_frac)))),
thenl AS (SELECT doc_id, metric, ref, true AS there FROM (FROM base UNPIVOT INCLUDE NULLS (ref FOR metric IN (page_err, live_text_cov, doc_recall, word_recall, within2pt, dy_p50, raster_frac))))"""
_WORSE = "(CASE WHEN better = 'lower' THEN value > ref + greatest(absolute, relative * abs(ref)) ELSE value < ref - greatest(absolute, relative * abs(ref)) END)"
_BETTER = "(CASE WHEN better = 'lower' THEN value < ref - greatest(absolute, relative * abs(ref)) ELSE value > ref + greatest(absolute, relative * abs(ref)) END)"
_BELOW = "(CASE WHEN better = 'lower' THEN value > threshold ELSE value < threshold END)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, share = F.col("n_chars"), lambda base, m: (base + F.col("n_chars") % m) / 100.0
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", (n % 3 == 0).cast("int").cast("double").alias("page_err"), F.when(F.col("doc_id") % 17 != 0, share(90, 12)).alias("live_text_cov"), share(92, 9).alias("doc_recall"),
        share(88, 13).alias("word_recall"), ((n % 10) / 10.0).alias("within2pt"), ((n % 41) / 10.0).alias("dy_p50"), share(0, 5).alias("raster_frac"),
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    ids = ids.union(spark.range(1).select(F.lit(-7).cast("bigint")))
    values = {"page_err": 0.0, "live_text_cov": 0.96, "doc_recall": 0.96, "word_recall": 0.93, "within2pt": 0.5, "dy_p50": 2.0, "raster_frac": 0.02}
    return ids.select("doc_id", *[F.lit(v).alias(k) for k, v in values.items()])


@query(rf"""
WITH {ROWS}, known AS (SELECT DISTINCT doc_id, 'word_recall' AS metric, true AS known FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, metric, CASE WHEN here IS NULL THEN 'missing' WHEN there IS NULL THEN 'unrecorded' WHEN value IS NULL THEN 'no-metric' WHEN {_WORSE} THEN 'regression'
    WHEN {_BELOW} AND known IS NULL THEN 'undocumented' WHEN NOT {_BELOW} AND known THEN 'stale' ELSE 'pass' END AS finding
FROM nowl FULL JOIN thenl USING (doc_id, metric) LEFT JOIN known USING (doc_id, metric) JOIN spec USING (metric)
""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit("word_recall").alias("metric"))
    return Q.verdicts(rows(spark, sf_dir), baseline(spark, sf_dir), "doc_id", known)


@query(rf"""
WITH {ROWS} SELECT doc_id, metric, CASE WHEN value IS NULL AND ref IS NULL THEN 'unmeasured' WHEN value IS NULL THEN 'worse' WHEN ref IS NULL THEN 'better' WHEN {_WORSE} THEN 'worse' WHEN {_BETTER} THEN 'better' ELSE 'same' END AS outcome
FROM nowl FULL JOIN thenl USING (doc_id, metric) JOIN spec USING (metric)
""")
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.parity(baseline(spark, sf_dir), rows(spark, sf_dir), "doc_id")


@query(rf"""
WITH {ROWS}, o AS (SELECT doc_id, metric, value, CASE WHEN value IS NULL AND ref IS NULL THEN 'unmeasured' WHEN value IS NULL THEN 'worse' WHEN ref IS NULL THEN 'better' WHEN {_WORSE} THEN 'worse' WHEN {_BETTER} THEN 'better' ELSE 'same' END AS outcome FROM nowl FULL JOIN thenl USING (doc_id, metric) JOIN spec USING (metric)),
w AS (SELECT DISTINCT doc_id, 'within2pt' AS metric, 0.2::DOUBLE AS floor, true AS w FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT doc_id, 'word_recall', 0.89, true FROM documents WHERE doc_id % 3 = 0),
g AS (SELECT doc_id, bool_or(outcome = 'worse' AND NOT coalesce(w, false)) AS open, bool_or(coalesce(w, false) AND coalesce(value < floor, true)) AS low, bool_or(outcome = 'worse' AND coalesce(w, false)) AS covered, bool_or(coalesce(w, false)) AS has FROM o LEFT JOIN w USING (doc_id, metric) WHERE metric IN ('within2pt', 'word_recall') GROUP BY doc_id)
SELECT doc_id, CASE WHEN open THEN 'regression' WHEN has AND low THEN 'below-floor' WHEN covered THEN 'waived' WHEN has THEN 'stale' ELSE 'pass' END AS verdict FROM g
""")
def parity_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions, with floors waived for every third document."""
    pick = F.col("metric").isin("within2pt", "word_recall")
    candidate = rows(spark, sf_dir)
    outcomes = Q.parity(baseline(spark, sf_dir), candidate, "doc_id").where(pick)
    values = Q.long_form(candidate, ["doc_id"], ["within2pt", "word_recall"])
    third = V.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id").distinct()
    waivers = third.select("doc_id", F.lit("within2pt").alias("metric"), F.lit(0.2).alias("floor")).union(third.select("doc_id", F.lit("word_recall"), F.lit(0.89)))
    return Q.adjudicated(outcomes, values, waivers, "doc_id")


@query(rf"""
WITH {ROWS} SELECT doc_id, metric, value FROM (SELECT doc_id, metric, value * CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS value FROM nowl) WHERE (metric IN ('live_text_cov', 'doc_recall', 'word_recall', 'within2pt', 'raster_frac') AND value > 1) OR value < 0
""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their domain, of rows some of which are spoilt on purpose."""
    r = rows(spark, sf_dir)
    spoilt = r.select("doc_id", *[(F.col(m.name) * F.when(F.col("doc_id") % 9 == 0, 2).otherwise(1)).alias(m.name) for m in Q.METRICS])
    return Q.invalid(spoilt, ["doc_id"])


@query(rf"""
WITH {ROWS}, c AS (SELECT * FROM (VALUES ('ordinary', 'live_text_cov', 0.92::DOUBLE), ('ordinary', 'within2pt', 0.3), ('stress', 'live_text_cov', 0.90)) t(tier, metric, least)), t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'stress' ELSE 'ordinary' END AS tier FROM documents)
SELECT doc_id, tier, metric, CASE WHEN value IS NULL THEN 'unmeasured' WHEN value >= least THEN 'pass' WHEN doc_id % 10 = 1 AND value >= least - 0.1 THEN 'waived' ELSE 'fail' END AS verdict FROM t JOIN c USING (tier) JOIN nowl USING (doc_id, metric)
""")
def tier_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by tier, with a bounded waiver for some documents."""
    checks = spark.createDataFrame([("ordinary", "live_text_cov", 0.92), ("ordinary", "within2pt", 0.3), ("stress", "live_text_cov", 0.90)], "tier string, metric string, least double")
    values = Q.long_form(rows(spark, sf_dir), ["doc_id"], ["live_text_cov", "within2pt"]).withColumn("tier", F.when(F.col("doc_id") % 4 == 0, "stress").otherwise("ordinary"))
    v = F.col("value")
    verdict = F.when(v.isNull(), "unmeasured").when(v >= F.col("least"), "pass").when((F.col("doc_id") % 10 == 1) & (v >= F.col("least") - 0.1), "waived").otherwise("fail")
    return values.join(F.broadcast(checks), ["tier", "metric"]).select("doc_id", "tier", "metric", verdict.alias("verdict"))


@query(rf"""
WITH {ROWS} SELECT doc_id, metric, value, ref FROM nowl JOIN thenl USING (doc_id, metric) WHERE value IS DISTINCT FROM ref
""")
def exact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [m.name for m in Q.METRICS]
    now, then = Q.long_form(rows(spark, sf_dir), ["doc_id"], names), Q.long_form(baseline(spark, sf_dir), ["doc_id"], names, "ref")
    return now.join(then, ["doc_id", "metric"]).where(~F.col("value").eqNullSafe(F.col("ref"))).select("doc_id", "metric", "value", "ref")


@query(r"""
WITH p AS (SELECT source, doc_id % 50 AS page, sum(CASE WHEN doc_id % 50 < 3 THEN 0 ELSE length(text) END) AS chars, bool_or(doc_id % 50 < 5) AS visual, max(doc_id % 25) AS widgets FROM documents GROUP BY ALL),
g AS (SELECT source, page // 5 AS doc, sum(chars) AS chars, count(*) AS pages, max(chars) AS most, bool_and(visual OR chars = 0) AS all_visual, bool_or(visual) AS any_visual, count(*) FILTER (widgets >= 24) AS form_pages FROM p GROUP BY ALL)
SELECT source, CAST(doc AS BIGINT) AS doc, CASE WHEN chars = 0 AND NOT any_visual THEN 'blank' WHEN chars <= 32 AND most <= 16 AND all_visual THEN 'ocr_required' WHEN form_pages > 0 AND form_pages >= greatest(1, 0.1 * pages) THEN 'form' WHEN any_visual THEN 'mixed' ELSE 'digital' END AS class,
    CASE WHEN pages > 250 THEN 'too_many_pages' WHEN form_pages > 0 AND form_pages >= greatest(1, 0.1 * pages) THEN 'form_unsupported' WHEN chars <= 32 AND most <= 16 AND all_visual THEN 'ocr_required' END AS refusal FROM g
""")
def doc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and refusals; groups of pages of a source stand for documents."""
    page = F.col("doc_id") % 50
    p = V.table(spark, sf_dir, "documents").groupBy("source", page.alias("page")).agg(F.sum(F.when(page < 3, 0).otherwise(F.length("text"))).alias("chars"), F.bool_or(page < 5).alias("visual"), F.max(F.col("doc_id") % 25).alias("widgets"))
    g = p.groupBy("source", F.floor(F.col("page") / 5).alias("doc")).agg(
        F.sum("chars").alias("chars"), F.count("*").alias("pages"), F.max("chars").alias("most"), F.bool_and(F.col("visual") | (F.col("chars") == 0)).alias("all_visual"), F.bool_or("visual").alias("any_visual"), F.count_if(F.col("widgets") >= 24).alias("form_pages")
    )
    kind = Q.document_class(*map(F.col, ("chars", "pages", "most", "all_visual", "any_visual", "form_pages")))
    form = (F.col("form_pages") > 0) & (F.col("form_pages") >= F.greatest(F.lit(1.0), 0.1 * F.col("pages")))
    refusal = F.when(F.col("pages") > 250, "too_many_pages").when(form, "form_unsupported").when((F.col("chars") <= 32) & (F.col("most") <= 16) & F.col("all_visual"), "ocr_required")
    return g.select("source", "doc", kind.alias("class"), refusal.alias("refusal"))


@query(r"""
WITH s AS (SELECT unnest(['converted', 'failed', 'ocr_required', 'skipped', 'unsupported']) AS status, unnest([0, 1, 2, 3, 4]) AS place), d AS (SELECT CASE WHEN n_chars % 11 = 0 THEN 'failed' WHEN n_chars % 7 = 0 THEN 'skipped' ELSE 'converted' END AS status FROM documents)
SELECT s.status, s.place, count(d.status) AS n FROM s LEFT JOIN d USING (status) GROUP BY s.status, s.place
""")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 11 == 0, "failed").when(F.col("n_chars") % 7 == 0, "skipped").otherwise("converted").alias("status"))
    return Q.counted(d, "status", ("converted", "failed", "ocr_required", "skipped", "unsupported"))


@query(r"""
SELECT source, count(*) FILTER (n_chars % 6 = 0) AS short, count(*) FILTER (n_chars % 6 = 1) AS flow, count(*) FILTER (n_chars % 6 = 2) AS no_page_room, count(*) FILTER (n_chars % 6 = 3) AS line_locked, count(*) FILTER (n_chars % 6 > 3) AS unpredictable FROM documents GROUP BY source
""")
def ladder_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["short", "flow", "no_page_room", "line_locked", "unpredictable"]
    outcome = F.element_at(F.array(*map(F.lit, names)), (F.least(F.lit(4), F.col("n_chars") % 6) + 1).cast("int"))
    d = V.table(spark, sf_dir, "documents").select("source", outcome.alias("outcome"))
    return d.groupBy("source").pivot("outcome", names).count().na.fill(0)


@query(rf"""
WITH {ROWS}, r AS (SELECT doc_id, CASE WHEN page_err > 0 THEN 'fail' WHEN live_text_cov IS NULL THEN 'error' WHEN live_text_cov < 0.95 THEN 'warn' ELSE 'pass' END AS verdict FROM measured)
SELECT doc_id, verdict, row_number() OVER (ORDER BY list_position(['error', 'fail', 'warn', 'pass'], verdict), doc_id) AS place FROM r
""")
def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in the order of severity: a range sort, and places by the counts of what comes before."""
    verdict = F.when(F.col("page_err") > 0, "fail").when(F.col("live_text_cov").isNull(), "error").when(F.col("live_text_cov") < 0.95, "warn").otherwise("pass")
    r = rows(spark, sf_dir).select("doc_id", verdict.alias("verdict")).withColumn("rank", F.array_position(F.array(*map(F.lit, ("error", "fail", "warn", "pass"))), F.col("verdict")))
    # Ranges come from a sample and partitions are merged by size, so both readers below take the parts that were written once.
    dealt = keep(r.repartitionByRange("rank", "doc_id").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("rank", "doc_id")
    return dealt.join(before, "part").select("doc_id", "verdict", (F.row_number().over(w) + F.col("before")).alias("place"))


@query(rf"""
WITH {ROWS}, p AS (SELECT doc_id, within2pt AS observed, (doc_id % 10) / 10.0::DOUBLE AS predicted FROM measured)
SELECT doc_id, CASE WHEN abs(observed - predicted) <= 0.05 THEN 'confirmed' WHEN observed > predicted THEN 'better' ELSE 'refuted' END AS grade FROM p
""")
def prediction_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = (F.col("doc_id") % 10) / 10.0
    grade = F.when(F.abs(F.col("within2pt") - predicted) <= 0.05, "confirmed").when(F.col("within2pt") > predicted, "better").otherwise("refuted")
    return rows(spark, sf_dir).select("doc_id", grade.alias("grade"))


@query(r"""
WITH f AS (SELECT l_suppkey % 2 AS backend, l_orderkey AS doc, count(*) AS n_draws FROM lineitem GROUP BY ALL), a AS (SELECT * FROM f WHERE backend = 0), b AS (SELECT * FROM f WHERE backend = 1)
SELECT coalesce(a.doc, b.doc) AS doc, a.n_draws, b.n_draws AS other, a.n_draws / greatest(1, b.n_draws) + 0 * b.n_draws AS ratio FROM a FULL JOIN b ON a.doc = b.doc
""")
def backend_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two backends' drawings, document by document; a backend that has none of a document has a null count."""
    f = V.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("backend"), F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("n_draws"))
    a, b = f.where("backend = 0").select("doc", "n_draws"), f.where("backend = 1").select("doc", F.col("n_draws").alias("other"))
    return a.join(b, "doc", "full_outer").withColumn("ratio", F.col("n_draws") / F.when(F.col("other").isNotNull(), F.greatest(F.lit(1), F.col("other"))))


@query(rf"""
WITH {V.WORDS}, {V.LINES}, e AS (SELECT doc_id, 'x0' AS kind, x0 AS v FROM lines UNION ALL SELECT doc_id, 'size', size FROM lines), c AS (SELECT doc_id, kind, v, count(*) AS n FROM e GROUP BY ALL)
SELECT doc_id, kind, v, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, v) <= 2
""")
def geometry_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest edges and sizes of each document."""
    lines = V.lines(spark, sf_dir)
    e = lines.select("doc_id", F.explode(F.array(F.struct(F.lit("x0").alias("kind"), F.col("x0").alias("v")), F.struct(F.lit("size").alias("kind"), F.col("size").alias("v")))).alias("s"))
    c = e.groupBy("doc_id", "s.kind", "s.v").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "v"))).where("r <= 2").drop("r")
