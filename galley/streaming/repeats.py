"""Running heads of a stream of pages: an extension, as the batch operators have no streaming counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text as T


def repeated_lines(pages: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, doc, sig, n_pages) of a stream of (ts, doc, page, text): how many pages of a document have a line, by event time.

    Pages later than the watermark are left out, which bounds the state; pages are counted approximately
    (within 1 %), as a stream cannot count distinct values twice.
    """
    lines = pages.withWatermark("ts", late).select("ts", "doc", "page", F.explode(F.split("text", "\n", -1)).alias("line"))
    signed = lines.withColumn("sig", F.substring(T.digits_masked(F.col("line")), 1, 40)).where("sig <> ''")
    return signed.groupBy(F.window("ts", window).alias("window"), "doc", "sig").agg(F.approx_count_distinct("page", 0.01).alias("n_pages"))
