"""Boxes as struct<xmin,ymin,xmax,ymax> columns: constructors, predicates and envelope algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
#: Radius of the sphere of web Mercator, in metres, and its latitude limit.
EARTH_RADIUS = 6378137.0
MERCATOR_LIMIT = 85.06


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box; null if a side is null."""
    sides = [xmin, ymin, xmax, ymax]
    whole = F.struct(*[x.cast("double").alias(n) for x, n in zip(sides, ("xmin", "ymin", "xmax", "ymax"))])
    return F.when(xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull(), whole)


def literal_box(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return box(*[F.lit(float(v)) for v in (xmin, ymin, xmax, ymax)])


def centre(b: Column) -> tuple[Column, Column]:
    return (b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2


def touches(a: Column, b: Column) -> Column:
    """Overlap or contact."""
    return (a.xmin <= b.xmax) & (a.xmax >= b.xmin) & (a.ymin <= b.ymax) & (a.ymax >= b.ymin)


def overlaps(a: Column, b: Column) -> Column:
    """Overlap of interiors (P2): contact is none, and a point on an edge misses."""
    return ~((a.xmax <= b.xmin) | (b.xmax <= a.xmin) | (a.ymax <= b.ymin) | (b.ymax <= a.ymin))


def contains(outer: Column, inner: Column, epsilon: float = EPSILON) -> Column:
    """Every side of inner lies within outer, up to epsilon."""
    return (inner.xmin >= outer.xmin - epsilon) & (inner.xmax <= outer.xmax + epsilon) & (inner.ymin >= outer.ymin - epsilon) & (inner.ymax <= outer.ymax + epsilon)


def holds_point(b: Column, x: Column, y: Column) -> Column:
    """Half-open: lower sides belong to the box, upper ones do not."""
    return (x >= b.xmin) & (x < b.xmax) & (y >= b.ymin) & (y < b.ymax)


def point_strictly_within(b: Column, x: Column, y: Column) -> Column:
    """A point inside a rectangle, its boundary excluded (G13 for rectangles)."""
    return (x > b.xmin) & (x < b.xmax) & (y > b.ymin) & (y < b.ymax)


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def area(b: Column) -> Column:
    return (b.xmax - b.xmin) * (b.ymax - b.ymin)


def margin(b: Column) -> Column:
    """Sum of the sides' lengths, one of each axis."""
    return (b.xmax - b.xmin) + (b.ymax - b.ymin)


def merge(a: Column, b: Column) -> Column:
    return box(F.least(a.xmin, b.xmin), F.least(a.ymin, b.ymin), F.greatest(a.xmax, b.xmax), F.greatest(a.ymax, b.ymax))


def overlap_area(a: Column, b: Column) -> Column:
    width = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin)
    height = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin)
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def expansion(tile: Column, b: Column, extent: Column) -> Column:
    """Growth of a tile's area, clipped to the extent, when it takes in a box."""
    grown = merge(tile, b)
    side = lambda e, lo, hi: F.greatest(F.lit(0.0), F.least(getattr(extent, hi), getattr(e, hi)) - F.greatest(getattr(extent, lo), getattr(e, lo)))
    size = lambda e: side(e, "xmin", "xmax") * side(e, "ymin", "ymax")
    return size(grown) - size(tile)


def swap_axes(b: Column) -> Column:
    """The same box with x and y exchanged (coordinate order yx)."""
    return box(b.ymin, b.xmin, b.ymax, b.xmax)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857; latitudes beyond the projection's limit give null."""
    x = F.radians(lon) * EARTH_RADIUS
    y = F.when(F.abs(lat) <= MERCATOR_LIMIT, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS)
    return x, y


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return F.degrees(x / EARTH_RADIUS), F.degrees(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - F.lit(math.pi / 2))


def polygon_wkt(b: Column) -> Column:
    """A box as a counter-clockwise WKT polygon."""
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    ring = [corner(b.xmin, b.ymin), corner(b.xmax, b.ymin), corner(b.xmax, b.ymax), corner(b.xmin, b.ymax), corner(b.xmin, b.ymin)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))


def human_size(size: Column, decimals: int = 2) -> Column:
    """Bytes with a unit of base 1024, as text."""
    amount, out = size.cast("double"), None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        text = F.concat(F.format_string(f"%.{decimals}f", amount / float(1024**power)), F.lit(f" {unit}"))
        out = F.when(amount >= float(1024**power), text) if out is None else out.when(amount >= float(1024**power) if power else amount.isNotNull(), text)
    return out
