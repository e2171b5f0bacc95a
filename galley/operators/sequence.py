"""Sequence operators: islands, clusters of neighbours, order statistics, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley import tunables as K
from galley.operators.tables import slices


def islands(df: DataFrame, by: list[str], order: list[str | Column], breaks: Callable[[Callable[[str], Column]], Column], name: str = "island") -> DataFrame:
    """df with the number (from 0) of the run that a row is in; breaks(previous) says whether a row begins a new one, previous(c) being c of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(breaks(lambda c: F.lag(c).over(w)), F.lit(False)).cast("int")
    return df.withColumn(f"__{name}", flag).withColumn(name, F.sum(f"__{name}").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(f"__{name}")


def chained_clusters(df: DataFrame, by: list[str], value: str, tol: float) -> DataFrame:
    """(by, cluster, mean, n, low, high): values in order, a new cluster where one is more than tol above the one before.

    Equal values are counted before they are put in order, so a value that many rows share is one row; groups are dealt out
    in slices by the size of the input, so that what a task orders does not grow with it.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    made = islands(counted.repartition(slices(df), *by), by, [value], lambda prev: F.col(value) - prev(value) > tol, "cluster")
    return made.groupBy(*by, "cluster").agg(
        (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), F.sum("__n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def order_statistic(df: DataFrame, by: list[str], value: str, place: Callable[[Column], Column], name: str) -> DataFrame:
    """(by, name, n): the value at place(n), counted from 0, of each group's n sorted values; nulls take no part."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    upto = F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.repartition(slices(df), *by).withColumns({"__n": F.sum("__c").over(w), "__upto": upto})
    at = place(F.col("__n"))
    return ranked.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__c") <= at)).select(*by, F.col(value).alias(name), F.col("__n").alias("n"))


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "upper_median") -> DataFrame:
    return order_statistic(df, by, value, lambda n: F.floor(n / 2), name)


def low_fifth(df: DataFrame, by: list[str], value: str, name: str = "p20") -> DataFrame:
    """The element at max(0, int(0.2 n) - 1)."""
    return order_statistic(df, by, value, lambda n: F.greatest(F.lit(0), F.floor(n * 0.2) - 1), name)


def high_tenth(df: DataFrame, by: list[str], value: str, name: str = "p90") -> DataFrame:
    """The element at int(0.9 (n - 1))."""
    return order_statistic(df, by, value, lambda n: F.floor((n - 1) * 0.9), name)


def first_seen_mode(df: DataFrame, by: list[str], value: Column, seq: str, name: str = "mode") -> DataFrame:
    """(by, name, n): the most frequent value, of equally frequent ones the first by seq."""
    counted = df.withColumn("__v", value).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n"), F.min(seq).alias("__s"))
    best = F.max_by(F.struct("__v", "__n"), F.struct(F.col("__n"), -F.col("__s")))
    return counted.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.__v").alias(name), F.col("b.__n").alias("n"))


def first_of(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def running(df: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str, before: bool = False) -> DataFrame:
    """df with the sum of value up to each row (before: without the row itself)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def letter_spaced_rows(rows: DataFrame, keys: list[str], em: Column, glyphs: Column, least: int = 3) -> DataFrame:
    """As letter_spaced(), of runs that come as one row each, with the arrays of their gaps and glyphs: nothing is moved."""
    made = rows.select(*keys, F.sort_array(F.filter(em, lambda x: x.isNotNull())).alias("__g"), glyphs.alias("__u"))
    n = F.size("__g")
    middle = made.select(*keys, "__g", "__u", (0.5 * F.get("__g", F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get("__g", F.floor(n / 2).cast("int"))).alias("mid"))
    alpha = F.size(F.filter("__u", lambda u: u.rlike("^[A-Za-z]$"))) / F.size("__u")
    even = F.size(F.filter("__g", lambda x: F.abs(x - F.col("mid")) <= 0.05)) / n
    tracked = (F.col("mid") >= K.TRACK_LOW) & (F.col("mid") < K.TRACK_HIGH) & (alpha >= K.TRACK_ALPHA) & (even >= K.TRACK_UNIFORM)
    # By inline, as a filter would be moved below and sort the gaps once more.
    return middle.select(*keys, F.inline(F.when(n >= least, F.array(F.struct("mid", tracked.alias("tracked"))))))


def letter_spaced(glyphs: DataFrame, keys: list[str], em: str, glyph: str, least: int = 3) -> DataFrame:
    """(keys, mid, tracked) of runs of glyphs with at least so many gaps (em, null before the first): the median gap, and whether gaps are wide and even between letters."""
    s = glyphs.groupBy(*keys).agg(F.collect_list(em).alias("__e"), F.collect_list(F.coalesce(glyph, F.lit(""))).alias("__c"))
    return letter_spaced_rows(s, keys, F.col("__e"), F.col("__c"), least)
