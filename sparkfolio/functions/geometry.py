"""Boxes as column expressions. Halves round to even and int() truncates, as the data's producers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 999  # layout output has coordinates from 0 to 999


def norm_to_px(x: Column, size: Column) -> Column:
    return F.rint(x / GRID * size).cast("int")


def px_to_norm(x: Column, size: Column) -> Column:
    return F.rint(x / size * GRID).cast("int")


def expand(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float) -> list[Column]:
    """The box with margins: a ratio of its size, a quarter more to the right, three times as much below; within the page."""
    mx, my = (F.abs(x2 - x1) * ratio).cast("int"), (F.abs(y2 - y1) * ratio).cast("int")
    return [F.greatest(F.lit(0), x1 - mx), F.greatest(F.lit(0), y1 - my), F.least(width, x2 + (mx * 1.25).cast("int")), F.least(height, y2 + (my * 3.0).cast("int"))]


def clip_to_column(x1: Column, x2: Column, col: Column, divider: Column, width: Column, margin: int = 5) -> tuple[Column, Column, Column]:
    """x1, x2 within a column (0 left, 1 right), and whether at least 2 pixels are left."""
    left = F.greatest(F.lit(0), F.when(col == 0, x1).otherwise(F.greatest(x1, (divider + margin).cast("int"))))
    right = F.least(width, F.when(col == 0, F.least(x2, (divider - margin).cast("int"))).otherwise(x2))
    return left, right, right - left >= 2


def enforce_column(x1: Column, x2: Column, col: Column, divider: Column, width: Column, margin: int = 5, least: int = 24) -> tuple[Column, Column]:
    """x1, x2 within a column and at least `least` wide."""
    near, far = (divider - margin).cast("int"), (divider + margin).cast("int")
    lx2 = F.least(x2, near)
    lx1 = F.greatest(F.lit(0), x1)
    lx1 = F.when(lx2 - lx1 < least, F.greatest(F.lit(0), lx2 - least)).otherwise(lx1)
    rx1 = F.greatest(x1, far)
    rx2 = F.least(width, x2)
    rx2 = F.when(rx2 - rx1 < least, F.least(width, rx1 + least)).otherwise(rx2)
    a, b = F.when(col == 0, lx1).otherwise(rx1), F.when(col == 0, lx2).otherwise(rx2)
    fall = F.greatest(F.lit(0), F.least((divider - margin - least).cast("int"), width - least))
    return F.when(b <= a, fall).otherwise(a), F.when(b <= a, F.least(width, fall + least)).otherwise(b)


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """The part of box a (its area, at least 1) that box b covers."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return (w * h) / F.greatest(F.lit(1), (a[2] - a[0]) * (a[3] - a[1]))
