"""Synthetic layout tables over the driver's tables, which hold no page geometry.

Words of a document are set ten to a line and forty lines to a page on a fixed grid, by closed formulas
that both engines compute exactly. These are adapters to exercise the operators, nothing that they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators.tables import slices

W, H = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """doc_id, i, word, page, line, slot, x0, y0, x1, y1, baseline, size.

    Texts are dealt out by document before they become words: what groups words by a document and more finds them together and moves none.
    Where no words meet, that can be left out.
    """
    whole = table(spark, sf_dir, "documents")
    texts = whole.select("doc_id", "text")
    docs = (texts.repartition(slices(whole), "doc_id") if dealt else texts).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("i", "word"))
    i = F.col("i")
    placed = docs.select("doc_id", "i", "word", (F.floor(i / 400) + 1).cast("int").alias("page"), (F.floor(i / 10) % 40).cast("int").alias("line"), (i % 10).alias("slot"))
    x0 = 72.0 + 46.5 * F.col("slot")
    size = F.when(F.length("word") > 12, 14.0).otherwise(10.0)
    return placed.withColumns(
        {"x0": x0, "y0": 72.0 + 14.0 * F.col("line"), "x1": x0 + F.least(F.lit(46.0), 5.0 * F.length("word")), "y1": 82.0 + 14.0 * F.col("line"), "baseline": 82.0 + 14.0 * F.col("line"), "size": size}
    )


WORDS = r"""words AS (
    SELECT doc_id, i, word, CAST(i // 400 + 1 AS INTEGER) AS page, CAST((i // 10) % 40 AS INTEGER) AS line, CAST(i % 10 AS INTEGER) AS slot,
        72.0::DOUBLE + 46.5::DOUBLE * (i % 10) AS x0, 72.0::DOUBLE + 14 * ((i // 10) % 40) AS y0,
        72.0::DOUBLE + 46.5::DOUBLE * (i % 10) + least(46.0::DOUBLE, 5.0::DOUBLE * length(word)) AS x1, 82.0::DOUBLE + 14 * ((i // 10) % 40) AS y1, 82.0::DOUBLE + 14 * ((i // 10) % 40) AS baseline,
        CASE WHEN length(word) > 12 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size
    FROM (SELECT doc_id, w[j] AS word, CAST(j - 1 AS INTEGER) AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)))
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, line, x0, y0, x1, y1, baseline, size, n_words, n_chars."""
    return words(spark, sf_dir).groupBy("doc_id", "page", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("baseline").alias("baseline"), F.max("size").alias("size"),
        F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"),
    )


LINES = r"""lines AS (
    SELECT doc_id, page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(baseline) AS baseline, max(size) AS size, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS n_chars
    FROM words GROUP BY doc_id, page, line
)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n, line: what \\n separates in a text."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))


TEXT_LINES = r"""text_lines AS (
    SELECT doc_id, source, l[j] AS line, CAST(j - 1 AS INTEGER) AS n FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
)"""
