"""Integer geometry in hundredths of a point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest magnitude of a coordinate.
MOST = (1 << 53) - 1


def quantize(points: Column) -> Column:
    """Points as whole hundredths, ties away from zero; null where not finite or out of range."""
    v = F.round(points * 100)
    fine = ~F.isnan(points) & (F.abs(v) <= MOST)
    return F.when(fine, v.cast("bigint"))


def is_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Positive area, and all four in range."""
    return F.coalesce((x1 > x0) & (y1 > y0) & (F.greatest(*(F.abs(c) for c in (x0, y0, x1, y1))) <= MOST), F.lit(False))


def top_left(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A box with its origin at the foot, as one from the top of the page that is turned by ``rotation`` degrees."""
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    r = F.pmod(rotation, F.lit(360))
    return (
        F.when(r == 90, box(y0, x0, y1, x1))
        .when(r == 180, box(width - x1, y0, width - x0, y1))
        .when(r == 270, box(height - y1, width - x1, height - y0, width - x0))
        .otherwise(box(x0, height - y1, x1, height - y0))
    )


def union() -> Column:
    """The box around all boxes of a group, over columns x0, y0, x1, y1."""
    return F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def compose(m: list[Column], n: list[Column]) -> list[Column]:
    """The affine map m followed by n; each (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l]


def apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f
