"""Column functions on boxes, colours and numbers. A box is four columns x0, y0, x1, y1, top-left origin, in points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    def overlap(self, other: Box) -> Column:
        """The area of the intersection."""
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)

    def holds(self, x: Column, y: Column, within: float = 0.0) -> Column:
        return x.between(self.x0 - within, self.x1 + within) & y.between(self.y0 - within, self.y1 + within)

    def contains(self, other: Box, within: float = 0.0) -> Column:
        return (other.x0 >= self.x0 - within) & (other.y0 >= self.y0 - within) & (other.x1 <= self.x1 + within) & (other.y1 <= self.y1 + within)

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def touches(self, other: Box, within: float = 0.0) -> Column:
        return (self.x0 <= other.x1 + within) & (other.x0 <= self.x1 + within) & (self.y0 <= other.y1 + within) & (other.y0 <= self.y1 + within)

    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


def transformed(m: tuple[Column, Column, Column, Column, Column, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The point under the affine matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def vertical_scale(c: Column, d: Column) -> Column:
    return F.sqrt(c * c + d * d)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """Channels of 0 to 255 as rrggbb."""
    return F.concat(*(F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("bigint")), 2, "0")) for c in (r, g, b)))


def channel(colour: Column, i: int) -> Column:
    """The i-th channel of rrggbb."""
    return F.conv(F.substring(colour, 2 * i + 1, 2), 16, 10).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    """Shares of 0 to 1 as channels of 0 to 255, rounded half to even."""
    return tuple(F.bround(255.0 * (1.0 - x) * (1.0 - k), 0).cast("int") for x in (c, m, y))


def is_backdrop(box: Box, colour: Column, page_w: Column, page_h: Column) -> Column:
    """A filled box over 60 % of the page or more whose darkest channel is 245 or more."""
    light = F.least(channel(colour, 0), channel(colour, 1), channel(colour, 2)) >= 245
    return F.coalesce(colour.isNotNull() & (box.area() >= 0.6 * page_w * page_h) & light, F.lit(False))


def marker_glyph(box: Box) -> Column:
    return (box.width > 0.4) & (box.width <= 9) & (box.height > 0.4) & (box.height <= 9) & (F.abs(box.width - box.height) <= 2)


def side_furniture(box: Box, margin_l: Column, margin_r: Column, page_w: Column) -> Column:
    """Wholly outside the side margins."""
    return (box.x1 < margin_l - 2) | (box.x0 > page_w - margin_r + 2)


def shape(n_points: Column, curved: Column, box: Box) -> Column:
    """rect, hline, vline, line, curve or complex, by the points of a path and its box."""
    return (
        F.when(curved, "curve")
        .when((n_points == 2) & (box.height <= 2.5) & (box.width > box.height), "hline")
        .when((n_points == 2) & (box.width <= 2.5), "vline")
        .when(n_points == 2, "line")
        .when((n_points.isin(4, 5)) & (box.height <= 2.5) & (box.width > box.height), "hline")
        .when((n_points.isin(4, 5)) & (box.width <= 2.5), "vline")
        .when(n_points.isin(4, 5), "rect")
        .otherwise("complex")
    )


def finite(x: Column) -> Column:
    """x, or null where it is no finite number."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def tolerance(absolute: Column, relative: Column, ref: Column) -> Column:
    return F.greatest(absolute, F.coalesce(relative, F.lit(0.0)) * F.abs(ref))


def worse(better: Column, value: Column, ref: Column, tol: Column) -> Column:
    """Whether value is worse than ref by more than tol; better is lower or higher. Null where either is unmeasured."""
    return F.when(better == "lower", value > ref + tol).otherwise(value < ref - tol)


def half_points(size: Column) -> Column:
    return F.bround(size * 2, 0) / 2
