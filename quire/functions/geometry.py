"""Pixel-inclusive boxes (x1, y1, x2, y2) as column expressions: a box from 0 to 2 is three pixels wide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.interval import overlap_length


@dataclass(frozen=True)
class Box:
    """Four columns. box("a_") names a_x1 to a_y2."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1 + 1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1 + 1

    @property
    def area(self) -> Column:
        return F.greatest((self.width * self.height).cast("long"), F.lit(0).cast("long"))

    @property
    def center_x(self) -> Column:
        return (self.x1 + self.width / 2).cast("int")

    @property
    def center_y(self) -> Column:
        return (self.y1 + self.height / 2).cast("int")

    def overlap_area(self, other: Box) -> Column:
        return overlap_length(self.x1, self.x2, other.x1, other.x2).cast("long") * overlap_length(self.y1, self.y2, other.y1, other.y2)

    def overlaps(self, other: Box) -> Column:
        return self.overlap_area(other) > 0

    def inside(self, other: Box) -> Column:
        return (self.x1 >= other.x1) & (self.y1 >= other.y1) & (self.x2 <= other.x2) & (self.y2 <= other.y2)

    def mostly_inside(self, other: Box, share: float) -> Column:
        """More than the share of this box's area lies in the other (strictly)."""
        return self.overlap_area(other) > share * self.area

    def union_area(self, other: Box) -> Column:
        return self.area + other.area - self.overlap_area(other)

    def iou(self, other: Box) -> Column:
        return F.try_divide(self.overlap_area(other).cast("double"), self.union_area(other))

    def iou_at_least(self, other: Box, share: float) -> Column:
        """The share itself counts."""
        return self.overlap_area(other) >= share * self.union_area(other)

    def holds_point(self, x: Column, y: Column) -> Column:
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    def scaled(self, page_width: Column, page_height: Column, to: int = 1000) -> Box:
        """Coordinates on a 0..to grid, truncated."""
        return Box(*[(F.lit(to) * v / s).cast("int") for v, s in ((self.x1, page_width), (self.y1, page_height), (self.x2, page_width), (self.y2, page_height))])

    def widened(self, share: float) -> Box:
        pad = (self.width * share).cast("int")
        return Box(self.x1 - pad, self.y1, self.x2 + pad, self.y2)


def box(prefix: str = "") -> Box:
    return Box(*[F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    """Right and lower edges at x + w and y + h, so that a round trip through xywh grows a box by one pixel."""
    return Box(x, y, x + w, y + h)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    x1, y1 = (cx - w / 2).cast("int"), (cy - h / 2).cast("int")
    return Box(x1, y1, x1 + w.cast("int"), y1 + h.cast("int"))


def from_points(points: Column) -> Box:
    """Of an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bounding(prefix: str = "") -> list[Column]:
    """Aggregates: the box around all boxes of a group."""
    return [F.min(prefix + "x1").alias("x1"), F.min(prefix + "y1").alias("y1"), F.max(prefix + "x2").alias("x2"), F.max(prefix + "y2").alias("y2")]
