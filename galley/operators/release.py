"""Runs, gates and records of a release: wide metric rows, findings, baselines, reports, evidence, corpora and plans.

Tables of documents are joined by document; specifications (metrics, policies, expected versions) are dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.geometry import tolerance, worse
from galley.operators.gate import METRICS, Metric, invalid, long_form, spec


def wide_row(documents: DataFrame, key: str, *measures: DataFrame) -> DataFrame:
    """One row per document with the columns of every measure; what was not measured is null, never zero."""
    out = documents.select(key).distinct()
    for m in measures:
        out = out.join(m, key, "left")
    return out


def page_scores(source: DataFrame, rendered: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name, on): every page of either side; a page that one side lacks scores 0."""
    both = source.withColumn("__s", F.lit(1)).join(rendered.withColumn("__r", F.lit(1)), keys, "full_outer")
    on = F.when(F.col("__s").isNull(), "rendered").when(F.col("__r").isNull(), "source").otherwise("both")
    return both.select(*keys, F.when(on == "both", F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias(name), on.alias("on"))


# The kinds of findings in the order in which they are reported.
KINDS = ("malformed", "duplicate", "missing", "unexpected", "identity", "error", "no-metric", "domain", "unrecorded", "regression", "threshold", "undocumented", "stale", "unqualified")


def findings(results: DataFrame, manifest: DataFrame, baseline: DataFrame, documented: DataFrame, key: str, absolute: bool = False, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(key, metric, kind) of everything that a gate finds; a document without a finding is not returned.

    results: key, sha, error, qualified and the metrics; manifest: key and sha; baseline: key and metrics;
    documented: (key, metric) that may be below their threshold. malformed: a result without a key;
    duplicate: a key twice; missing, unexpected: against the manifest; identity: another hash than the
    manifest's; error: the run failed; no-metric, domain: unmeasured or out of its domain; unrecorded: not in
    the baseline; regression: worse than it beyond the tolerance; threshold: below and documented (only
    where absolute), undocumented: below and not; stale: documented yet clear; unqualified: absolute alone.
    """
    names = [m.name for m in metrics]
    s = F.broadcast(spec(results.sparkSession, metrics))
    kind = lambda df, k, metric=None: df.select(key, (F.lit(None).cast("string") if metric is None else F.col(metric)).alias("metric"), F.lit(k).alias("kind"))
    named = results.where(F.col(key).isNotNull())
    out = [kind(results.where(F.col(key).isNull()), "malformed"), kind(named.groupBy(key).count().where("count > 1"), "duplicate")]
    known = manifest.select(key, F.col("sha").alias("__want"))
    out += [kind(known.join(named, key, "left_anti"), "missing"), kind(named.join(known, key, "left_anti"), "unexpected")]
    met = named.join(known, key)
    out += [kind(met.where(~F.col("sha").eqNullSafe(F.col("__want"))), "identity"), kind(met.where("error is not null"), "error")]
    fine = met.where("error is null")
    values = long_form(fine, [key], names).join(s, "metric")
    out += [kind(values.where("value is null"), "no-metric", "metric"), kind(invalid(fine, [key], metrics), "domain", "metric")]
    out += [kind(fine.join(baseline.select(key), key, "left_anti"), "unrecorded")]
    then = values.join(long_form(baseline, [key], names, "ref"), [key, "metric"])
    out += [kind(then.where(worse(F.col("better"), F.col("value"), F.col("ref"), tolerance(F.col("absolute"), F.col("relative"), F.col("ref")))), "regression", "metric")]
    below = worse(F.col("better"), F.col("value"), F.col("threshold"), F.lit(0.0))
    judged = values.withColumn("__below", below).join(documented.select(key, "metric", F.lit(True).alias("__known")).distinct(), [key, "metric"], "left").where("value is not null")
    out += [kind(judged.where("__below and __known is null"), "undocumented", "metric"), kind(judged.where("not __below and __known"), "stale", "metric")]
    if absolute:
        out += [kind(judged.where("__below and __known"), "threshold", "metric"), kind(fine.where("not coalesce(qualified, false)"), "unqualified")]
    made = out[0]
    for df in out[1:]:
        made = made.unionByName(df)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    return made.distinct().withColumn("place", place)


def recorded(results: DataFrame, lanes: list[str], key: str, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(lane, key, metric, value) of a new baseline: documents that every lane measured without error; a document that any lane lacks is refused with all its lanes."""
    good = results.where("error is null").groupBy(key).agg(F.count_distinct("lane").alias("__n")).where(F.col("__n") == len(lanes)).select(key)
    return long_form(results.where(F.col("lane").isin(lanes)).join(good, key, "left_semi"), ["lane", key], [m.name for m in metrics]).where("value is not null")


def report_json(rows: DataFrame, group: list[str], fields: list[str], order: str) -> DataFrame:
    """(group, json): the rows of a group as one JSON array, keys in alphabetical order, rows in the given one."""
    row = F.struct(*[F.col(c) for c in sorted(fields)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return rows.groupBy(*group).agg(F.to_json(listed).alias("json"))


def merged_evidence(bundles: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Bundles of evidence as one: of each key the latest, with how many there were and whether they disagree on the hash."""
    last = F.max_by(F.struct(*[c for c in bundles.columns if c not in keys]), F.struct(at, "sha"))
    made = bundles.groupBy(*keys).agg(last.alias("__l"), F.count("*").alias("n_bundles"), (F.count_distinct("sha") > 1).alias("conflict"))
    return made.select(*keys, "__l.*", "n_bundles", "conflict")


def mismatches(expected: DataFrame, actual: DataFrame, name: str, value: str) -> DataFrame:
    """(name, expected, actual): entries of an environment that are absent or differ."""
    both = expected.select(name, F.col(value).alias("expected")).join(actual.select(name, F.col(value).alias("actual")), name, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def seal_problems(corpus: DataFrame, key: str) -> DataFrame:
    """(key, problem) of corpus entries (sha, pages, licence, source, retrieved) that may not be sealed."""
    checks = {
        "no-hash": ~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "no-pages": F.coalesce(F.col("pages") < 1, F.lit(True)),
        "no-licence": F.coalesce(F.btrim("licence") == "", F.lit(True)),
        "no-source": ~F.coalesce(F.col("source").rlike("^(https://|generated:)"), F.lit(False)),
        "no-date": F.expr("try_to_date(retrieved, 'yyyy-MM-dd')").isNull(),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return corpus.select(key, F.explode(found).alias("problem"))


def qualification(plan: DataFrame, outcomes: DataFrame, key: str, attempts: int) -> DataFrame:
    """(key, state, tries): planned documents that passed, failed in all attempts, are open, or were never tried."""
    tried = outcomes.groupBy(key).agg(F.count("*").alias("tries"), F.bool_or("ok").alias("ok"))
    state = F.when(F.col("tries").isNull(), "untried").when(F.col("ok"), "qualified").when(F.col("tries") >= attempts, "failed").otherwise("open")
    return plan.select(key).distinct().join(tried, key, "left").select(key, state.alias("state"), F.coalesce("tries", F.lit(0)).alias("tries"))


def policy_entries(policy: DataFrame, profile: DataFrame, fields: list[str]) -> DataFrame:
    """Entries (profile map, document, floor) whose profile is exactly the given one: the same fields, the same values."""
    want = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    p = profile.select(want.alias("__want"))
    same = (F.size("profile") == len(fields)) & (F.array_sort(F.map_keys("profile")) == F.array(*map(F.lit, sorted(fields))))
    for f in fields:
        same = same & (F.col("profile")[f] == F.col("__want")[f])
    return policy.join(F.broadcast(p)).where(same).drop("__want")


def lane_runs(documents: DataFrame, lanes: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(lane, key, status): every document in every lane (a dimension table): done, error, refused or not run."""
    every = documents.select(key, "refused").join(F.broadcast(lanes.select("lane")))
    met = every.join(results.select("lane", key, "error", F.lit(True).alias("__ran")), ["lane", key], "left")
    status = F.when(F.col("refused"), "refused").when(F.col("__ran").isNull(), "not run").when(F.col("error").isNotNull(), "error").otherwise("done")
    return met.select("lane", key, status.alias("status"))


def gaps_by_marker(source: DataFrame, rendered: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """(keys, variant, marker, gap, localised): how much lower a marker's paragraph is in a rendering of a variant, and what of that is new since the marker before. A page has a marker once."""
    from pyspark.sql.window import Window

    both = source.select(*keys, "marker", F.lit(None).cast(rendered.schema[variant].dataType).alias(variant), "y", F.lit(None).cast("double").alias("ry"), F.lit(True).alias("__s")).union(
        rendered.select(*keys, "marker", variant, F.lit(None).cast("double"), "ry", F.lit(False))
    )
    # A marker's own place goes to all its renderings by one pass over the page, without a join that would move both tables.
    own = F.max(F.when(F.col("__s"), F.struct("y"))).over(Window.partitionBy(*keys, "marker"))
    met = both.withColumn("__y", own).where("not __s and __y is not null").withColumn("y", F.col("__y.y")).withColumn("gap", F.col("ry") - F.col("y"))
    before = F.lag("gap").over(Window.partitionBy(*keys, variant).orderBy("y"))
    return met.select(*keys, variant, "marker", "gap", (F.col("gap") - F.coalesce(before, F.lit(0.0))).alias("localised"))


def grafted(lines: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lid, bid): each line of one backend in the block of the other that holds its centre and is smallest."""
    mid = F.col("y_mid").between(F.col("b_y0"), F.col("b_y1")) & F.col("x_mid").between(F.col("b_x0"), F.col("b_x1"))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    return lines.join(blocks, keys).where(mid).groupBy(*keys, "lid").agg(F.min(F.struct(area.alias("a"), "bid"))["bid"].alias("bid"))


def swept(rows: DataFrame, parameters: DataFrame, name: str, measure: Column, keys: list[str]) -> DataFrame:
    """(keys, name, score): the mean of a measure under each value of a parameter (a dimension table)."""
    return rows.join(F.broadcast(parameters.select(name))).groupBy(*keys, name).agg(F.avg(measure).alias("score"))
