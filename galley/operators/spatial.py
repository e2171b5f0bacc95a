"""Joins of points, boxes and positions, by equality on a grid or by order; none compares all with all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley import tunables as K
from galley.functions.geometry import Box
from galley.operators.graph import connected_components


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, cell: float = 64.0) -> DataFrame:
    """points with each box (x0, y0, x1, y1, inclusive) of the same keys that they lie in.

    A box goes to the cells of a grid that it covers, a point to its one cell, and cells join by equality.
    """
    laid = boxes.withColumn("__cx", _cells(F.col("x0"), F.col("x1"), cell)).withColumn("__cy", _cells(F.col("y0"), F.col("y1"), cell))
    placed = points.withColumns({"__cx": F.floor(F.col(x) / cell), "__cy": F.floor(F.col(y) / cell)})
    return placed.join(laid, [*keys, "__cx", "__cy"]).where(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))).drop("__cx", "__cy")


def boxes_over_boxes(left: DataFrame, right: DataFrame, keys: list[str], within: float = 0.0, cell: float = 64.0) -> DataFrame:
    """Pairs of left boxes (l_x0 ...) and right boxes (r_x0 ...) of the same keys that meet or are at most `within` apart.

    A pair is found in the cell that holds the upper left corner of what both cover, so only once.
    """

    def laid(df: DataFrame, p: str, grow: float) -> DataFrame:
        return df.withColumn("__cx", _cells(F.col(f"{p}x0") - grow, F.col(f"{p}x1") + grow, cell)).withColumn("__cy", _cells(F.col(f"{p}y0") - grow, F.col(f"{p}y1") + grow, cell))

    both = laid(left, "l_", within).join(laid(right, "r_", 0.0), [*keys, "__cx", "__cy"])
    meet = Box.of("l_").grown(within).touches(Box.of("r_"))
    corner = (F.floor(F.greatest(F.col("l_x0") - within, F.col("r_x0")) / cell) == F.col("__cx")) & (F.floor(F.greatest(F.col("l_y0") - within, F.col("r_y0")) / cell) == F.col("__cy"))
    return both.where(meet & corner).drop("__cx", "__cy")


def touching(boxes: DataFrame, keys: list[str], ident: str, within: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ident, component): boxes joined by chains of neighbours at most `within` apart on both axes; single boxes are components of their own.

    Boxes at one place are neighbours of each other and have the same neighbours, so the smallest stands for
    all of them: pairs grow with the places of boxes, not with the square of how many lie at one.
    """
    place = [*keys, "x0", "y0", "x1", "y1"]
    whole = F.lit(True)
    for c in place:
        whole = whole & F.col(c).isNotNull()
    at = cut(boxes.where(whole).groupBy(*place).agg(F.min(ident).alias("__first")))
    side = lambda p: at.select(*keys, F.col("__first").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = boxes_over_boxes(side("l_"), side("r_"), keys, within).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    found = connected_components(pairs, cut).withColumnRenamed("node", "__first")
    of = at.join(found, "__first", "left").select(*place, F.coalesce("component", "__first").alias("component"))
    return boxes.select(ident, *place).join(of, place, "left").select(ident, F.coalesce("component", F.col(ident)).alias("component"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str, forward: bool = True) -> DataFrame:
    """left with the value of the nearest right row at or after (forward) or at or before its position, of the same keys.

    Both sides are put in one order and the nearest value is carried along; of right rows at one position the
    smallest value counts.
    """
    r = right.groupBy(*keys, at).agg(F.min(value).alias("__v")).withColumn("__right", F.lit(True))
    both = left.withColumn("__right", F.lit(False)).unionByName(r, allowMissingColumns=True)
    tie = F.when(F.col("__right"), 0).otherwise(1)
    order = [F.col(at).desc(), tie] if forward else [F.col(at), tie]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).where("not __right").drop("__v", "__right")


def band_of(x0: Column, x1: Column, bands: list[tuple[float, float]]) -> Column:
    """The column of a page that a box belongs to: the band that contains it, else the one it overlaps most, else the nearest; null if wider than one and a half."""
    mid = (x0 + x1) / 2
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(bands)])
    inside = F.filter(arr, lambda s: (x0 >= s["a"] - 1) & (x1 <= s["b"] + 1))
    ranked = F.array_sort(F.transform(arr, lambda s: F.struct((-F.greatest(F.lit(0.0), F.least(x1, s["b"]) - F.greatest(x0, s["a"]))).alias("o"), F.abs(mid - (s["a"] + s["b"]) / 2).alias("d"), s["i"].alias("i"))))
    widest = max(b - a for a, b in bands)
    return F.when(x1 - x0 <= 1.5 * widest, F.when(F.size(inside) > 0, inside[0]["i"]).otherwise(ranked[0]["i"]))


def first_band(x: Column, edges: list[float], within: float = 1.0) -> Column:
    """The first interval between neighbouring edges that x lies in, up to `within` outside; null if none."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(pairs))):
        out = F.when(x.between(a - within, b + within), F.lit(i)).otherwise(out)
    return out


def merged_boxes(boxes: DataFrame, keys: list[str], ident: str, within: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Boxes united with those at most `within` apart until no two are: (keys, ident, x0, y0, x1, y1, n), ident being the smallest of a union."""
    now = cut(boxes.select(*keys, ident, "x0", "y0", "x1", "y1", F.lit(1).cast("bigint").alias("n")))
    while True:
        of = touching(now, keys, ident, within, cut)
        nxt = cut(
            now.join(of, ident).groupBy(*keys, F.col("component").alias(ident)).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
        )
        if nxt.count() == now.count():
            return nxt
        now = nxt


def row_pairs(rows: DataFrame, keys: list[str], col_l: float, col_r: float) -> DataFrame:
    """rows (lx0, lx1, rx0, rx1 of two halves) with pair: left half flush left, right half flush right, and far enough apart; none where too large a share of the keys' rows would pair."""
    width = col_r - col_l
    fits = (F.col("lx0") <= col_l + K.PAIR_LEFT) & (F.col("rx1") >= col_r - K.PAIR_RIGHT) & (F.col("rx0") - F.col("lx1") >= K.PAIR_GAP)
    sized = (F.col("rx1") - F.col("rx0") <= K.PAIR_RIGHT_SHARE * width) & (F.col("lx1") - F.col("lx0") >= K.PAIR_LEFT_SHARE * width)
    one = rows.withColumn("__p", F.coalesce(fits & sized, F.lit(False)))
    page = Window.partitionBy(*keys)
    return one.withColumn("pair", F.col("__p") & (F.sum(F.col("__p").cast("int")).over(page) <= K.PAIR_MOST * F.count("*").over(page))).drop("__p")
