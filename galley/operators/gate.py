"""Gates over metric rows: validation, verdicts against a baseline, parity of two arms, policies with waivers.

Metric rows are wide; decisions are made on the long form (doc, metric, value). Null means unmeasured, never
zero, and what is not a finite number is unmeasured too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.geometry import finite, tolerance, worse


@dataclass(frozen=True)
class Metric:
    name: str
    better: str
    threshold: float | None
    absolute: float
    relative: float
    low: float
    high: float | None


# Metric, better direction, threshold, absolute and relative tolerance, domain.
METRICS = (
    Metric("page_err", "lower", 0.0, 0.0, 0.0, 0.0, None),
    Metric("live_text_cov", "higher", 0.95, 0.010, 0.0, 0.0, 1.0),
    Metric("doc_recall", "higher", 0.95, 0.010, 0.0, 0.0, 1.0),
    Metric("word_recall", "higher", 0.90, 0.020, 0.0, 0.0, 1.0),
    Metric("within2pt", "higher", None, 0.050, 0.0, 0.0, 1.0),
    Metric("dy_p50", "lower", None, 0.500, 0.10, 0.0, None),
    Metric("raster_frac", "lower", None, 0.020, 0.0, 0.0, 1.0),
)


def spec(spark: SparkSession, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """The dimension table of metrics: as many rows as there are metrics."""
    return spark.createDataFrame([(m.name, m.better, m.threshold, m.absolute, m.relative, m.low, m.high) for m in metrics], "metric string, better string, threshold double, absolute double, relative double, low double, high double")


def long_form(rows: DataFrame, keys: list[str], names: list[str], value: str = "value") -> DataFrame:
    """(keys, metric, value) of wide rows; unmeasured metrics keep their row with null."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), finite(F.col(n)).alias(value)) for n in names]))
    return rows.select(*keys, each.alias("__m")).select(*keys, "__m.metric", f"__m.{value}")


def invalid(rows: DataFrame, keys: list[str], metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """Values outside their domain: (keys, metric, value)."""
    s = F.broadcast(spec(rows.sparkSession, metrics))
    out = long_form(rows, keys, [m.name for m in metrics]).join(s, "metric")
    return out.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select(*keys, "metric", "value")


def verdicts(rows: DataFrame, baseline: DataFrame, key: str, documented: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(key, metric, finding) of every document and metric.

    missing: recorded, no row; unrecorded: a row, not recorded; no-metric: unmeasured now; regression: worse
    than the record beyond the tolerance; undocumented: below the threshold without being documented
    (key, metric); stale: documented, yet clears the threshold; pass.
    """
    names = [m.name for m in metrics]
    s = F.broadcast(spec(rows.sparkSession, metrics))
    now = long_form(rows, [key], names).withColumn("__now", F.lit(True))
    then = long_form(baseline, [key], names, "ref").withColumn("__then", F.lit(True))
    known = documented.select(key, "metric").distinct().withColumn("__known", F.lit(True))
    both = now.join(then, [key, "metric"], "full_outer").join(known, [key, "metric"], "left").join(s, "metric")
    v, ref = F.col("value"), F.col("ref")
    below = worse(F.col("better"), v, F.col("threshold"), F.lit(0.0))
    finding = (
        F.when(F.col("__now").isNull(), "missing")
        .when(F.col("__then").isNull(), "unrecorded")
        .when(v.isNull(), "no-metric")
        .when(worse(F.col("better"), v, ref, tolerance(F.col("absolute"), F.col("relative"), ref)), "regression")
        .when(below & F.col("__known").isNull(), "undocumented")
        .when(~below & F.col("__known"), "stale")
        .otherwise("pass")
    )
    return both.select(key, "metric", finding.alias("finding"))


def parity(reference: DataFrame, candidate: DataFrame, key: str, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(key, metric, outcome): worse, better or same by the margin; a dimension that the candidate lacks is worse, one that only the reference lacks is better."""
    names = [m.name for m in metrics]
    s = F.broadcast(spec(reference.sparkSession, metrics))
    both = long_form(reference, [key], names, "ref").join(long_form(candidate, [key], names), [key, "metric"], "full_outer").join(s, "metric")
    v, ref = F.col("value"), F.col("ref")
    tol = tolerance(F.col("absolute"), F.col("relative"), ref)
    opposite = F.when(F.col("better") == "lower", "higher").otherwise("lower")
    outcome = F.when(v.isNull() & ref.isNull(), "unmeasured").when(v.isNull(), "worse").when(ref.isNull(), "better").when(worse(F.col("better"), v, ref, tol), "worse").when(worse(opposite, v, ref, tol), "better").otherwise("same")
    return both.select(key, "metric", outcome.alias("outcome"))


def adjudicated(outcomes: DataFrame, values: DataFrame, waivers: DataFrame, key: str) -> DataFrame:
    """(key, verdict): regression if any dimension is worse and not waived, waived if all worse ones are above their floor, below-floor, stale if nothing is worse though waived, pass.

    values: (key, metric, value); waivers: (key, metric, floor).
    """
    joined = outcomes.join(values, [key, "metric"], "left").join(waivers.withColumn("__w", F.lit(True)), [key, "metric"], "left")
    bad, waived = F.col("outcome") == "worse", F.coalesce("__w", F.lit(False))
    low = F.coalesce(F.col("value") < F.col("floor"), F.lit(True))
    made = joined.groupBy(key).agg(F.bool_or(bad & ~waived).alias("open"), F.bool_or(waived & low).alias("low"), F.bool_or(bad & waived).alias("covered"), F.bool_or(waived).alias("has"))
    verdict = F.when(F.col("open"), "regression").when(F.col("has") & F.col("low"), "below-floor").when(F.col("covered"), "waived").when(F.col("has"), "stale").otherwise("pass")
    return made.select(key, verdict.alias("verdict"))


def document_class(chars: Column, pages: Column, most_on_page: Column, all_visual: Column, any_visual: Column, form_pages: Column) -> Column:
    """blank, ocr_required, form, mixed or digital, in this order."""
    return (
        F.when((chars == 0) & ~any_visual, "blank")
        .when((chars <= 32) & (most_on_page <= 16) & all_visual, "ocr_required")
        .when((form_pages > 0) & (form_pages >= F.greatest(F.lit(1.0), 0.1 * pages)), "form")
        .when(any_visual, "mixed")
        .otherwise("digital")
    )


def counted(rows: DataFrame, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """(status, n) of a fixed list of statuses, zeros too."""
    all_ = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(statuses)], f"{status} string, place int")
    return F.broadcast(all_).join(rows.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, "place", F.coalesce("n", F.lit(0)).alias("n"))
