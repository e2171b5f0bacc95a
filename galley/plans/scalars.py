"""Queries of scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import geometry as G
from galley.functions import text as T
from galley.plans import views as V
from galley.plans.registry import query


@query(r"""
SELECT page_id, length(html) AS n_before, length(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')) AS n_after,
    sha256(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')) AS safe_sha256 FROM pages
""")
def xml_safe_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = T.xml_safe(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("bigint").alias("n_before"), F.length(safe).cast("bigint").alias("n_after"), F.sha2(safe, 256).alias("safe_sha256"))


@query(r"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(url || ' é', '(?s).'), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]') THEN c
    ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS encoded FROM pages
""")
def url_percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", T.percent_encoded(F.concat("url", F.lit(" é"))).alias("encoded"))


@query(rf"""
WITH {V.TEXT_LINES}
SELECT doc_id, n, regexp_replace(trim(line), '\p{{Nd}}+', '#', 'g') AS masked, substr(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'), 1, 60) AS prefix FROM text_lines
""")
def line_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text_lines(spark, sf_dir).select("doc_id", "n", T.digits_masked(F.col("line")).alias("masked"), T.squeezed(F.col("line")).alias("prefix"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]')) AS n_cjk,
    len(regexp_extract_all(text, '[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]')) AS n_rtl,
    len(regexp_extract_all(text, '[^\x00-\x{FF}]')) AS n_wide, len(regexp_extract_all(text, '[\x{80}-\x{FF}]')) AS n_latin1 FROM documents
""")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("bigint")
    return V.table(spark, sf_dir, "documents").select("doc_id", count(T.CJK).alias("n_cjk"), count(T.RTL).alias("n_rtl"), count("[^\\x00-\\x{FF}]").alias("n_wide"), count("[\\x{80}-\\x{FF}]").alias("n_latin1"))


@query(rf"""
WITH {V.WORDS}
SELECT doc_id, count(*) AS n_words, count(*) FILTER ((length(word) = 1 AND contains('•◦▪‣·○●■–-*', word)) OR regexp_matches(word, '^(\d{{1,3}}|[A-Za-z]|[ivxlcIVXLC]{{1,5}})[.)]$')) AS n_markers
FROM words GROUP BY doc_id
""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(T.is_marker(F.col("word"))).alias("n_markers"))


@query(rf"""
WITH {V.TEXT_LINES}
SELECT doc_id, n, 600.0::DOUBLE * length(line) * 10.5::DOUBLE / 1000 AS width,
    CASE WHEN regexp_matches(line, '[^\x20-\x7E]') THEN NULL ELSE 600.0::DOUBLE * length(line) * 10.5::DOUBLE / 1000 END AS ascii_width FROM text_lines
""")
def text_width_courier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pitch of 600: once for any character, once for printable ASCII only."""
    ascii_ = {600: "".join(map(chr, range(32, 127)))}
    line, size = F.col("line"), F.lit(10.5)
    return V.text_lines(spark, sf_dir).select("doc_id", "n", T.width(line, {}, size, default=600).alias("width"), T.width(line, ascii_, size).alias("ascii_width"))


_QUOTED = {w: c.replace("'", "''") for w, c in T.HELVETICA.items()}
_COUNTS = " + ".join(f"{w} * (length(line) - length(translate(line, '{c}', '')))" for w, c in _QUOTED.items())
_KNOWN = "".join(_QUOTED.values())


@query(f"""
WITH {V.TEXT_LINES} SELECT doc_id, n, CASE WHEN translate(line, '{_KNOWN}', '') = '' THEN ({_COUNTS}) * 9.5::DOUBLE / 1000 END AS width FROM text_lines
""")
def text_width_sans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of lines in the standard sans-serif font; null where a character has no advance."""
    return V.text_lines(spark, sf_dir).select("doc_id", "n", T.width(F.col("line"), T.HELVETICA, F.lit(9.5)).alias("width"))


@query(rf"""
WITH {V.TEXT_LINES}, f AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM text_lines)
SELECT doc_id, sha256(string_agg(CASE WHEN following IS NULL THEN line WHEN regexp_matches(line, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}') THEN regexp_replace(line, '-$', '')
    WHEN regexp_matches(line, '[ -]$') THEN line ELSE line || ' ' END, '' ORDER BY n)) AS joined_sha256, count(*) AS n_lines FROM f GROUP BY doc_id
""")
def soft_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, within the row: neighbours are array entries, so nothing is shuffled."""
    line = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = V.table(spark, sf_dir, "documents").select("doc_id", line.alias("l"))
    joined = F.array_join(F.transform("l", lambda x, i: T.soft_join(x, F.get("l", i + 1))), "")
    return docs.select("doc_id", F.sha2(joined, 256).alias("joined_sha256"), F.size("l").cast("bigint").alias("n_lines"))


@query(rf"""
WITH {V.WORDS}
SELECT doc_id, i, (x1 - x0) * (y1 - y0) AS area, greatest(0, least(x1, 300.0) - greatest(x0, 100.0)) * greatest(0, least(y1, 400.0) - greatest(y0, 100.0)) AS overlap,
    x0 >= 100 AND y0 >= 100 AND x1 <= 300 AND y1 <= 400 AS inside, 2 * x0 + 0.5 * y0 + 3 AS tx, -1 * x0 + 4 * y0 - 2 AS ty FROM words
""")
def bbox_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box, frame = G.Box.of(), G.Box(*map(F.lit, (100.0, 100.0, 300.0, 400.0)))
    tx, ty = G.transformed(tuple(map(F.lit, (2.0, -1.0, 0.5, 4.0, 3.0, -2.0))), F.col("x0"), F.col("y0"))
    return V.words(spark, sf_dir).select("doc_id", "i", box.area().alias("area"), box.overlap(frame).alias("overlap"), frame.contains(box).alias("inside"), tx.alias("tx"), ty.alias("ty"))


@query(r"""
WITH p AS (SELECT p_partkey, p_size * 5 AS r, (p_partkey * 7) % 300 AS g, p_size * 3 AS b, p_size * 12.0::DOUBLE AS w, 792.0::DOUBLE AS h FROM part),
c AS (SELECT *, lower(lpad(to_hex(least(255, r)), 2, '0')) || lower(lpad(to_hex(least(255, g)), 2, '0')) || lower(lpad(to_hex(least(255, b)), 2, '0')) AS colour FROM p)
SELECT p_partkey, colour, w * h >= 0.6 * 612 * 792 AND least(least(255, r), least(255, g), least(255, b)) >= 245 AS backdrop,
    CAST(round_even(255.0::DOUBLE * (1 - (r % 101) / 100.0::DOUBLE) * (1 - (b % 51) / 100.0::DOUBLE), 0) AS INTEGER) AS red FROM c
""")
def colour_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), ((F.col("p_partkey") * 7) % 300).alias("g"), (F.col("p_size") * 3).alias("b"), (F.col("p_size") * 12.0).alias("x1"))
    colour = G.hex_colour(F.col("r"), F.col("g"), F.col("b"))
    box = G.Box(F.lit(0.0), F.lit(0.0), F.col("x1"), F.lit(792.0))
    red, _, _ = G.cmyk_to_rgb((F.col("r") % 101) / 100.0, F.lit(0.0), F.lit(0.0), (F.col("b") % 51) / 100.0)
    return p.withColumn("colour", colour).select("p_partkey", "colour", G.is_backdrop(box, F.col("colour"), F.lit(612.0), F.lit(792.0)).alias("backdrop"), red.alias("red"))


@query(r"""
WITH d AS (SELECT p_partkey, p_size % 8 AS n, p_size % 11 = 0 AS curved, (p_partkey % 40) * 0.5::DOUBLE AS w, (p_partkey % 23) * 0.5::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN curved THEN 'curve' WHEN n = 2 AND h <= 2.5 AND w > h THEN 'hline' WHEN n = 2 AND w <= 2.5 THEN 'vline' WHEN n = 2 THEN 'line'
    WHEN n IN (4, 5) AND h <= 2.5 AND w > h THEN 'hline' WHEN n IN (4, 5) AND w <= 2.5 THEN 'vline' WHEN n IN (4, 5) THEN 'rect' ELSE 'complex' END AS shape,
    w > 0.4 AND w <= 9 AND h > 0.4 AND h <= 9 AND abs(w - h) <= 2 AS marker, 600 + w < 72 - 2 OR 600 > 612 - 20.0 + 2 AS furniture FROM d
""")
def path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    box = G.Box(F.lit(600.0), F.lit(0.0), 600.0 + (k % 40) * 0.5, (k % 23) * 0.5)
    thin = G.Box(F.lit(0.0), F.lit(0.0), (k % 40) * 0.5, (k % 23) * 0.5)
    return V.table(spark, sf_dir, "part").select("p_partkey", G.shape(F.col("p_size") % 8, F.col("p_size") % 11 == 0, thin).alias("shape"), G.marker_glyph(thin).alias("marker"), G.side_furniture(box, F.lit(72.0), F.lit(20.0), F.lit(612.0)).alias("furniture"))


@query(r"""
SELECT event_id, CASE WHEN isfinite(value) THEN value END AS finite, round_even(value * 2, 0) / 2 AS half_points, greatest(0.5, 0.1 * abs(value)) AS tol,
    value > 10 + greatest(0.5, 0.1 * 10) AS worse_low, value < 10 - greatest(0.5, 0.1 * 10) AS worse_high, strftime(ts, '%Y-%m-%d') AS day,
    try_cast(strftime(ts, '%Y-%m-%d') AS DATE) IS NOT NULL AS valid_day, try_cast(strftime(ts, '%Y-99-%d') AS DATE) IS NOT NULL AS valid_bad FROM events
""")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, ten = F.col("value"), F.lit(10.0)
    tol = G.tolerance(F.lit(0.5), F.lit(0.1), ten)
    day = F.date_format("ts", "yyyy-MM-dd")
    return V.table(spark, sf_dir, "events").select(
        "event_id", G.finite(v).alias("finite"), G.half_points(v).alias("half_points"), G.tolerance(F.lit(0.5), F.lit(0.1), v).alias("tol"),
        G.worse(F.lit("lower"), v, ten, tol).alias("worse_low"), G.worse(F.lit("higher"), v, ten, tol).alias("worse_high"), day.alias("day"),
        F.try_to_date(day, "yyyy-MM-dd").isNotNull().alias("valid_day"), F.try_to_date(F.date_format("ts", "yyyy-'99'-dd"), "yyyy-MM-dd").isNotNull().alias("valid_bad"),
    )


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), '(bold|italic|oblique|regular|roman|light|medium|black|psmt|mt|ps|plated|brushed)+$', ''), '^[a-z]{6}\+', '') AS family FROM part
""")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without punctuation, and without the styles that they end in."""
    key = F.regexp_replace(F.lower("p_type"), "[^a-z0-9]", "")
    return V.table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(key, "(bold|italic|oblique|regular|roman|light|medium|black|psmt|mt|ps|plated|brushed)+$", ""), "^[a-z]{6}\\+", "").alias("family"))


@query(r"""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pdfium' WHEN 'O' THEN 'pymupdf' ELSE 'custom' END || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'standard' ELSE 'google' END || '/' || 'libreoffice/refine' || (o_orderkey % 4) || '@' || 240 || 'dpi' AS profile_id FROM orders
""")
def profile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = F.when(F.col("o_orderstatus") == "F", "pdfium").when(F.col("o_orderstatus") == "O", "pymupdf").otherwise("custom")
    target = F.when(F.col("o_orderkey") % 2 == 0, "standard").otherwise("google")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%s/%s/%s/refine%d@%ddpi", backend, target, F.lit("libreoffice"), F.col("o_orderkey") % 4, F.lit(240)).alias("profile_id"))


@query(r"""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS basename, CASE WHEN length(html) > 20000 THEN 'too_large' WHEN html = '' THEN 'empty' ELSE 'ok' END AS code, '{"page_id":' || page_id || ',"url":"' || replace(url, '/', '/') || '"}' AS canonical FROM pages
""")
def safe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes, base names only, and canonical JSON with keys in order."""
    code = F.when(F.length("html") > 20000, "too_large").when(F.col("html") == "", "empty").otherwise("ok")
    return V.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("basename"), code.alias("code"), F.to_json(F.struct("page_id", "url")).alias("canonical"))


@query(rf"""
WITH {V.WORDS}, f AS (SELECT doc_id, i, word, unnest(regexp_extract_all(word, '\d+')) AS digits, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before, page FROM words)
SELECT doc_id, i, digits, CASE WHEN digits = CAST(page AS VARCHAR) THEN 'PAGE' WHEN regexp_matches(before, '(/|(^|[^\p{{L}}])(of|de|von|sur))$') THEN 'NUMPAGES' ELSE 'LITERAL' END AS role FROM f
""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("word").over(Window.partitionBy("doc_id").orderBy("i"))
    told = V.words(spark, sf_dir).withColumn("before", before)
    found = told.where(F.col("word").rlike("\\d")).select("doc_id", "i", "page", "before", F.explode(F.regexp_extract_all("word", F.lit("\\d+"), F.lit(0))).alias("digits"))
    role = F.when(F.col("digits") == F.col("page").cast("string"), "PAGE").when(F.col("before").rlike(T.OF_WORDS), "NUMPAGES").otherwise("LITERAL")
    return found.select("doc_id", "i", "digits", role.alias("role"))
