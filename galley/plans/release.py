"""Queries of runs, gates and records of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import release as R
from galley.operators.gate import METRICS
from galley.plans import views as V
from galley.plans.registry import query

#: Results, manifest, baseline and documented exceptions, by closed formulas over documents and labels.
TABLES = """res AS (SELECT CASE WHEN doc_id % 41 = 7 THEN NULL ELSE doc_id END AS doc_id, n_chars % 13 AS sha, CASE WHEN doc_id % 17 = 3 THEN 'render' END AS error, doc_id % 5 > 0 AS qualified,
    doc_id % 3 // 2 * 1.0::DOUBLE AS page_err, CASE WHEN doc_id % 19 = 4 THEN NULL ELSE 1.0 - n_chars % 10 / 100.0 END AS live_text_cov, 1.0 - n_chars % 9 / 100.0 AS doc_recall, CASE WHEN doc_id % 23 = 5 THEN 1.5 ELSE 1.0 - n_chars % 17 / 100.0 END AS word_recall,
    n_chars % 100 / 100.0 AS within2pt, n_chars % 40 / 10.0 AS dy_p50, n_chars % 5 / 50.0 AS raster_frac FROM documents WHERE doc_id % 29 <> 11 UNION ALL SELECT doc_id, 0, 'again', true, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 37 = 9),
man AS (SELECT doc_id, (n_chars + CASE WHEN doc_id % 31 = 2 THEN 1 ELSE 0 END) % 13 AS sha FROM documents WHERE doc_id % 43 <> 6),
base AS (SELECT doc_id, 0.0::DOUBLE AS page_err, 0.95::DOUBLE AS live_text_cov, 0.96::DOUBLE AS doc_recall, 0.93::DOUBLE AS word_recall, n_chars % 100 / 100.0 + 0.02 AS within2pt, 2.0::DOUBLE AS dy_p50, 0.05::DOUBLE AS raster_frac FROM documents WHERE doc_id % 13 <> 1),
docu AS (SELECT doc_id, 'word_recall' AS metric FROM documents WHERE doc_id % 4 = 0)"""
_SPEC = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"('{m.name}', '{m.better}', {'NULL' if m.threshold is None else m.threshold}, {m.absolute}, {m.relative}, {m.low}, {'NULL' if m.high is None else m.high})" for m in METRICS) + ") t(metric, better, threshold, ab, rel, low, high))"
_NAMES = ", ".join(m.name for m in METRICS)


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    k, n = F.col("doc_id"), F.col("n_chars")
    made = {
        "doc_id": F.when(k % 41 != 7, k), "sha": n % 13, "error": F.when(k % 17 == 3, "render"), "qualified": k % 5 > 0, "page_err": F.floor(k % 3 / 2) * 1.0, "live_text_cov": F.when(k % 19 != 4, 1.0 - n % 10 / 100.0),
        "doc_recall": 1.0 - n % 9 / 100.0, "word_recall": F.when(k % 23 == 5, 1.5).otherwise(1.0 - n % 17 / 100.0), "within2pt": n % 100 / 100.0, "dy_p50": n % 40 / 10.0, "raster_frac": n % 5 / 50.0,
    }
    again = {c: F.lit(None).cast("double") for c in made} | {"doc_id": k, "sha": F.lit(0).cast("bigint"), "error": F.lit("again"), "qualified": F.lit(True)}
    rows = lambda df, m: df.select(*[c.alias(a) for a, c in m.items()])
    results = rows(d.where("doc_id % 29 <> 11"), made).union(rows(d.where("doc_id % 37 = 9"), again))
    manifest = d.where("doc_id % 43 <> 6").select("doc_id", ((n + F.when(k % 31 == 2, 1).otherwise(0)) % 13).alias("sha"))
    base = {"doc_id": k, "page_err": F.lit(0.0), "live_text_cov": F.lit(0.95), "doc_recall": F.lit(0.96), "word_recall": F.lit(0.93), "within2pt": n % 100 / 100.0 + 0.02, "dy_p50": F.lit(2.0), "raster_frac": F.lit(0.05)}
    return results, manifest, rows(d.where("doc_id % 13 <> 1"), base), d.where("doc_id % 4 = 0").select("doc_id", F.lit("word_recall").alias("metric"))


@query(rf"""
WITH {TABLES}, {_SPEC}, named AS (SELECT * FROM res WHERE doc_id IS NOT NULL), met AS (SELECT n.*, m.sha AS want FROM named n JOIN man m USING (doc_id)), fine AS (SELECT * FROM met WHERE error IS NULL),
v AS (SELECT doc_id, metric, value, s.* EXCLUDE (metric) FROM (SELECT doc_id, metric, value FROM (SELECT doc_id, {_NAMES} FROM fine) UNPIVOT INCLUDE NULLS (value FOR metric IN ({_NAMES}))) JOIN spec s USING (metric)),
b AS (SELECT doc_id, metric, ref FROM (UNPIVOT (SELECT doc_id, {_NAMES} FROM base) ON {_NAMES} INTO NAME metric VALUE ref)),
j AS (SELECT v.*, CASE WHEN better = 'lower' THEN value > threshold ELSE value < threshold END AS below, d.doc_id IS NOT NULL AS known FROM v LEFT JOIN (SELECT DISTINCT * FROM docu) d USING (doc_id, metric) WHERE value IS NOT NULL),
f AS (SELECT doc_id, NULL AS metric, 'malformed' AS kind, 0 AS place FROM res WHERE doc_id IS NULL
UNION SELECT doc_id, NULL, 'duplicate', 1 FROM named GROUP BY doc_id HAVING count(*) > 1
UNION SELECT doc_id, NULL, 'missing', 2 FROM man WHERE doc_id NOT IN (SELECT doc_id FROM named)
UNION SELECT doc_id, NULL, 'unexpected', 3 FROM named WHERE doc_id NOT IN (SELECT doc_id FROM man)
UNION SELECT doc_id, NULL, 'identity', 4 FROM met WHERE sha IS DISTINCT FROM want
UNION SELECT doc_id, NULL, 'error', 5 FROM met WHERE error IS NOT NULL
UNION SELECT doc_id, metric, 'no-metric', 6 FROM v WHERE value IS NULL
UNION SELECT doc_id, metric, 'domain', 7 FROM v WHERE value < low OR value > high
UNION SELECT doc_id, NULL, 'unrecorded', 8 FROM fine WHERE doc_id NOT IN (SELECT doc_id FROM base)
UNION SELECT doc_id, metric, 'regression', 9 FROM v JOIN b USING (doc_id, metric) WHERE CASE WHEN better = 'lower' THEN value > ref + greatest(ab, rel * abs(ref)) ELSE value < ref - greatest(ab, rel * abs(ref)) END
UNION SELECT doc_id, metric, 'threshold', 10 FROM j WHERE below AND known
UNION SELECT doc_id, metric, 'undocumented', 11 FROM j WHERE below AND NOT known
UNION SELECT doc_id, metric, 'stale', 12 FROM j WHERE NOT below AND known
UNION SELECT doc_id, NULL, 'unqualified', 13 FROM fine WHERE NOT coalesce(qualified, false))
SELECT * FROM f
""")
def gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the full gate finds, by document, metric and kind."""
    results, manifest, baseline, documented = tables(spark, sf_dir)
    return R.findings(results, manifest, baseline, documented, "doc_id", absolute=True)


@query(rf"""
WITH {TABLES}, l AS (SELECT 'raw' AS lane, * FROM res UNION ALL SELECT 'product', * REPLACE (CASE WHEN doc_id % 6 = 1 THEN 'late' ELSE error END AS error) FROM res),
g AS (SELECT doc_id FROM l WHERE error IS NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT lane) = 2)
SELECT lane, doc_id, metric, value FROM (UNPIVOT (SELECT lane, doc_id, {_NAMES} FROM l WHERE doc_id IN (SELECT doc_id FROM g)) ON {_NAMES} INTO NAME metric VALUE value)
""")
def baseline_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new baseline of two lanes; a document that either could not measure is not recorded."""
    results = tables(spark, sf_dir)[0]
    late = results.withColumn("error", F.when(F.col("doc_id") % 6 == 1, "late").otherwise(F.col("error")))
    both = results.withColumn("lane", F.lit("raw")).unionByName(late.withColumn("lane", F.lit("product")))
    return R.recorded(both, ["raw", "product"], "doc_id")


@query(rf"""
WITH {V.WORDS}, r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS chars FROM words GROUP BY doc_id), p AS (SELECT doc_id, max(page) AS pages FROM words WHERE doc_id % 3 > 0 GROUP BY doc_id), l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT d.doc_id, n_words, chars, pages, quality FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)
""")
def evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row of measures per document; what was not measured is null."""
    w = V.words(spark, sf_dir)
    text = w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("chars"))
    pages = w.where("doc_id % 3 > 0").groupBy("doc_id").agg(F.max("page").alias("pages"))
    labels = V.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return R.wide_row(V.table(spark, sf_dir, "documents"), "doc_id", text, pages, labels)


@query(rf"""
WITH {V.WORDS}, {V.LINES}, p AS (SELECT doc_id, page, avg(x1) AS ink FROM lines GROUP BY ALL), r AS (SELECT doc_id, page + doc_id % 2 AS page, ink * 0.9 AS ink2 FROM p)
SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(p.page, r.page) AS page, round(CASE WHEN p.doc_id IS NOT NULL AND r.doc_id IS NOT NULL THEN least(ink, ink2) / greatest(ink, ink2) ELSE 0 END, 6) AS score,
    CASE WHEN p.doc_id IS NULL THEN 'rendered' WHEN r.doc_id IS NULL THEN 'source' ELSE 'both' END AS "on" FROM p FULL JOIN r ON p.doc_id = r.doc_id AND p.page = r.page
""")
def page_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page by page, what source and rendering share; a page that one of them lacks scores 0."""
    p = V.lines(spark, sf_dir).groupBy("doc_id", F.col("page").cast("bigint").alias("page")).agg(F.avg("x1").alias("ink"))
    r = p.select("doc_id", (F.col("page") + F.col("doc_id") % 2).alias("page"), (F.col("ink") * 0.9).alias("ink2"))
    return R.page_scores(p, r, ["doc_id", "page"], F.round(F.least("ink", "ink2") / F.greatest("ink", "ink2"), 6), "score")


@query(r"""
WITH r AS (SELECT source, doc_id // 500 AS batch, doc_id, n_chars, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'converted' END AS status FROM documents)
SELECT source, batch, '[' || string_agg('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"status":"' || status || '"}', ',' ORDER BY doc_id) || ']' AS json FROM r GROUP BY source, batch
""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of batches as JSON with sorted keys; a batch takes 500 documents at most, as a run does."""
    rows = V.table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 500).alias("batch"), "doc_id", "n_chars", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("converted").alias("status"))
    return R.report_json(rows, ["source", "batch"], ["status", "n_chars", "doc_id"], "doc_id")


@query(r"""
WITH b AS (SELECT user_id AS doc_id, event_id AS run, CAST(floor(value) AS BIGINT) % 5 AS sha FROM events)
SELECT doc_id, max(run) AS run, arg_max(sha, (run, sha)) AS sha, count(*) AS n_bundles, count(DISTINCT sha) > 1 AS conflict FROM b GROUP BY doc_id
""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest evidence of each document, and whether bundles disagree; events stand for bundles."""
    b = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("run"), (F.floor("value").cast("bigint") % 5).alias("sha"))
    return R.merged_evidence(b, ["doc_id"], "run")


@query(r"""
WITH e AS (SELECT n_name AS name, n_regionkey AS version FROM nation WHERE n_nationkey <> 3), a AS (SELECT n_name AS name, n_regionkey + CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END AS version FROM nation WHERE n_nationkey <> 5)
SELECT coalesce(e.name, a.name) AS name, e.version AS expected, a.version AS actual FROM e FULL JOIN a USING (name) WHERE e.version IS DISTINCT FROM a.version
""")
def environment_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an environment that differ from what is expected; nations stand for dependencies."""
    n, k = V.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    expected = n.where(k != 3).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("version"))
    return R.mismatches(expected, n.where(k != 5).select(F.col("n_name").alias("name"), (F.col("n_regionkey") + F.when(k % 6 == 0, 1).otherwise(0)).alias("version")), "name", "version")


@query(r"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'x' ELSE sha256(coalesce(text, '')) END AS sha, n_chars % 40 AS pages, CASE WHEN doc_id % 11 = 2 THEN ' ' ELSE 'cc' END AS licence, CASE WHEN doc_id % 13 = 3 THEN 'ftp://a' ELSE 'https://a/' || doc_id END AS src,
    '2026-' || lpad(CAST(1 + doc_id % 14 AS VARCHAR), 2, '0') || '-05' AS retrieved FROM documents)
SELECT doc_id, 'no-hash' AS problem FROM c WHERE NOT regexp_full_match(sha, '[0-9a-f]{64}') UNION ALL SELECT doc_id, 'no-pages' FROM c WHERE pages < 1 UNION ALL SELECT doc_id, 'no-licence' FROM c WHERE trim(licence) = ''
UNION ALL SELECT doc_id, 'no-source' FROM c WHERE NOT regexp_matches(src, '^(https://|generated:)') UNION ALL SELECT doc_id, 'no-date' FROM c WHERE try_cast(retrieved AS DATE) IS NULL
""")
def corpus_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps entries of a corpus from being sealed."""
    k = F.col("doc_id")
    c = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 7 == 1, "x").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"), (F.col("n_chars") % 40).alias("pages"), F.when(k % 11 == 2, " ").otherwise("cc").alias("licence"),
        F.when(k % 13 == 3, "ftp://a").otherwise(F.concat(F.lit("https://a/"), k.cast("string"))).alias("source"), F.concat(F.lit("2026-"), F.lpad((1 + k % 14).cast("string"), 2, "0"), F.lit("-05")).alias("retrieved"),
    )
    return R.seal_problems(c, "doc_id")


@query(r"""
WITH o AS (SELECT o_custkey AS doc_id, count(*) AS tries, bool_or(o_totalprice > 300000) AS ok FROM orders GROUP BY ALL)
SELECT c_custkey AS doc_id, CASE WHEN tries IS NULL THEN 'untried' WHEN ok THEN 'qualified' WHEN tries >= 12 THEN 'failed' ELSE 'open' END AS state, coalesce(tries, 0) AS tries FROM customer LEFT JOIN o ON doc_id = c_custkey
""")
def qualification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned documents and what became of them; customers stand for documents, orders for attempts."""
    outcomes = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_totalprice") > 300000).alias("ok"))
    return R.qualification(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), outcomes, "doc_id", 12)


@query(r"""
WITH p AS (SELECT p_partkey AS document, p_size * 1.0::DOUBLE AS floor, p_size % 3 AS backend, p_size % 2 AS renderer, p_partkey % 5 = 0 AS extra FROM part) SELECT document, floor FROM p WHERE backend = 1 AND renderer = 1 AND NOT extra
""")
def policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a policy that are bound to exactly the profile of the run; parts stand for entries."""
    s = F.col("p_size")
    profile = F.create_map(F.lit("backend"), (s % 3).cast("string"), F.lit("renderer"), (s % 2).cast("string"))
    profile = F.when(F.col("p_partkey") % 5 == 0, F.map_concat(profile, F.create_map(F.lit("dpi"), F.lit("240")))).otherwise(profile)
    policy = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), (s * 1.0).alias("floor"), profile.alias("profile"))
    run = spark.createDataFrame([("1", "1")], "backend string, renderer string")
    return R.policy_entries(policy, run, ["backend", "renderer"]).select("document", "floor")


@query(rf"""
WITH {TABLES}, lanes AS (SELECT unnest(['raw', 'product']) AS lane), r AS (SELECT DISTINCT lane, doc_id, error FROM res, lanes WHERE doc_id IS NOT NULL AND coalesce(error, '') <> 'again' AND (lane = 'raw' OR doc_id % 2 = 0))
SELECT lane, d.doc_id, CASE WHEN d.n_chars < 100 THEN 'refused' WHEN r.doc_id IS NULL THEN 'not run' WHEN error IS NOT NULL THEN 'error' ELSE 'done' END AS status FROM documents d CROSS JOIN lanes LEFT JOIN r USING (lane, doc_id)
""")
def lane_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every document in every lane."""
    results = tables(spark, sf_dir)[0].where("doc_id is not null and coalesce(error, '') <> 'again'").select("doc_id", "error")
    ran = results.withColumn("lane", F.lit("raw")).unionByName(results.where("doc_id % 2 = 0").withColumn("lane", F.lit("product")))
    documents = V.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 100).alias("refused"))
    return R.lane_runs(documents, spark.createDataFrame([("raw",), ("product",)], "lane string"), ran, "doc_id")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, v AS (SELECT unnest([1, 2, 3]) AS variant), r AS (SELECT doc_id, page, variant, line AS marker, y0 AS y, y0 + CASE WHEN line >= 10 THEN 2.5::DOUBLE * variant ELSE 0 END AS ry FROM lines, v), g AS (SELECT *, ry - y AS gap FROM r)
SELECT doc_id, page, variant, marker, gap, gap - coalesce(lag(gap) OVER (PARTITION BY doc_id, page, variant ORDER BY y), 0) AS localised FROM g
""")
def importer_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far variants of a document push its markers down, and where that begins."""
    lines = V.lines(spark, sf_dir).select("doc_id", "page", F.col("line").alias("marker"), F.col("y0").alias("y"))
    pushed = F.col("y") + F.when(F.col("marker") >= 10, 2.5 * F.col("variant")).otherwise(0.0)
    rendered = lines.withColumn("variant", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("doc_id", "page", "marker", "variant", pushed.alias("ry"))
    return R.gaps_by_marker(lines, rendered, ["doc_id", "page"], "variant")


@query(rf"""
WITH {V.WORDS}, {V.LINES}, b AS (SELECT doc_id, page, line // 6 AS bid, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) + 4 AS d FROM lines GROUP BY ALL UNION ALL SELECT doc_id, page, 100, 72.0, 72.0, 540.0, 700.0 FROM lines GROUP BY ALL)
SELECT l.doc_id, l.page, l.line AS lid, arg_min(bid, ((c - a) * (d - b), bid)) AS bid FROM lines l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND (y0 + y1) / 2 BETWEEN b.b AND b.d AND (x0 + x1) / 2 BETWEEN b.a AND b.c GROUP BY ALL
""")
def grafted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one backend in the smallest block of another that holds their centre."""
    lines = V.lines(spark, sf_dir)
    page = ["doc_id", "page"]
    blocks = lines.groupBy(*page, F.floor(F.col("line") / 6).cast("int").alias("bid")).agg(F.min("x0").alias("b_x0"), F.min("y0").alias("b_y0"), F.max("x1").alias("b_x1"), (F.max("y1") + 4).alias("b_y1"))
    whole = lines.select(*page).distinct().select(*page, F.lit(100).alias("bid"), F.lit(72.0).alias("b_x0"), F.lit(72.0).alias("b_y0"), F.lit(540.0).alias("b_x1"), F.lit(700.0).alias("b_y1"))
    centred = lines.select(*page, F.col("line").alias("lid"), ((F.col("x0") + F.col("x1")) / 2).alias("x_mid"), ((F.col("y0") + F.col("y1")) / 2).alias("y_mid"))
    return R.grafted(centred, blocks.union(whole), page)


@query(r"""
WITH p AS (SELECT unnest([1.0::DOUBLE, 1.15, 1.3, 1.6]) AS ratio) SELECT l_returnflag, ratio, round(avg(CAST(l_extendedprice > ratio * l_quantity * 1400 AS INTEGER)), 9) AS score FROM lineitem, p GROUP BY ALL
""")
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a rule fires under each value of its parameter."""
    p = spark.createDataFrame([(x,) for x in (1.0, 1.15, 1.3, 1.6)], "ratio double")
    made = R.swept(V.table(spark, sf_dir, "lineitem"), p, "ratio", (F.col("l_extendedprice") > F.col("ratio") * F.col("l_quantity") * 1400).cast("int"), ["l_returnflag"])
    return made.withColumn("score", F.round("score", 9))


@query(rf"""
WITH {V.WORDS}, {V.LINES} SELECT doc_id, page, count(*) AS n_lines, round(max(y1) - min(y0), 6) AS span, min(x0) AS left_edge, max(x1) AS right_edge, count(*) < 5 AS thin FROM lines GROUP BY doc_id, page
""")
def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' line profiles and margins, and which hold hardly anything."""
    g = V.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.round(F.max("y1") - F.min("y0"), 6).alias("span"), F.min("x0").alias("left_edge"), F.max("x1").alias("right_edge"))
    return g.withColumn("thin", F.col("n_lines") < 5)
