"""The geometry kernel as Arrow-batched columns over WKB.

Null, empty and unreadable geometries give null measures and false predicates; a bounding
box is computed once on load, and later steps use native columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.geometry import wkb
from quadrille.geometry.batch import Batch, parsed, point_values, rectangle_values

# types as objects: workers import this module without a session that could parse text
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")])


def _each(values: pd.Series, measure: Callable[[wkb.Geometry], Any], missing: Any = None) -> list:
    return [missing if (g := parsed(v)) is None else measure(g) for v in values]


def _struct(rows: list, names: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame([r or [None] * len(names) for r in rows], columns=list(names), dtype="float64")


@F.pandas_udf(BOX)
def _bounds(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(Batch(values.to_list()).bounds(), columns=["xmin", "ymin", "xmax", "ymax"])


def bounds(geometry: Column) -> Column:
    """Bounding box (G4), null where there is none."""
    found = _bounds(geometry)
    return F.when(found.xmin.isNotNull() & ~F.isnan(found.xmin), found)


@F.pandas_udf(POINT)
def centroid(values: pd.Series) -> pd.DataFrame:
    """Planar centroid."""
    return pd.DataFrame(Batch(values.to_list()).centroids(), columns=["x", "y"])


@F.pandas_udf(POINT)
def projected_centroid(values: pd.Series) -> pd.DataFrame:
    """Centroid in web Mercator of geometries in degrees, in degrees."""
    return _struct(_each(values, wkb.projected_centroid), ("x", "y"))


@F.pandas_udf(POINT)
def representative_point(values: pd.Series) -> pd.DataFrame:
    """A position on the geometry."""
    return _struct(_each(values, wkb.point_inside), ("x", "y"))


@F.pandas_udf(T.BooleanType())
def is_empty(values: pd.Series) -> pd.Series:
    """Null, unreadable or without a position."""
    return pd.Series(Batch(values.to_list()).is_empty())


@F.pandas_udf(T.StringType())
def type_name(values: pd.Series) -> pd.Series:
    return pd.Series(Batch(values.to_list()).type_names(), dtype=object)


@F.pandas_udf(T.BooleanType())
def well_oriented(values: pd.Series) -> pd.Series:
    return pd.Series(Batch(values.to_list()).well_oriented())


@F.pandas_udf(T.BinaryType())
def from_wkt(values: pd.Series) -> pd.Series:
    """WKB of WKT (G2), null where it is none."""

    def convert(v: str | None) -> bytes | None:
        try:
            return None if v is None else wkb.to_wkb(wkb.from_wkt(v))
        except wkb.GeometryError:
            return None

    return pd.Series([convert(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def to_wkt(values: pd.Series) -> pd.Series:
    return pd.Series(_each(values, wkb.to_wkt), dtype=object)


@F.pandas_udf(T.BinaryType())
def from_geojson(values: pd.Series) -> pd.Series:
    """WKB of a GeoJSON geometry (G3), null where it is none."""

    def convert(v: str | None) -> bytes | None:
        try:
            return None if v is None else wkb.to_wkb(wkb.from_geojson(v))
        except wkb.GeometryError:
            return None

    return pd.Series([convert(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def to_geojson(values: pd.Series) -> pd.Series:
    import json

    return pd.Series(_each(values, lambda g: json.dumps(wkb.to_geojson(g))), dtype=object)


def is_point_type(geometry: Column) -> Column:
    """A point by the header's type number (G10), without parsing."""
    little = F.substring(geometry, 1, 1) == F.unhex(F.lit("01"))
    low = F.hex(F.when(little, F.substring(geometry, 2, 2)).otherwise(F.concat(F.substring(geometry, 5, 1), F.substring(geometry, 4, 1))))
    # 1, 1001, 2001 and 3001 in little-endian order of their two low bytes
    return F.coalesce(low.isin("0100", "E903", "D107", "B90B"), F.lit(False))


def point_wkb(x: Column, y: Column) -> Column:
    """WKB of points from two columns."""

    @F.pandas_udf(T.BinaryType())
    def build(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(point_values(xs.to_numpy(float), ys.to_numpy(float)), dtype=object)

    return build(x, y)


def rectangle_wkb(b: Column) -> Column:
    """WKB of boxes."""

    @F.pandas_udf(T.BinaryType())
    def build(boxes: pd.DataFrame) -> pd.Series:
        return pd.Series(rectangle_values(*boxes.to_numpy(float).T), dtype=object)

    return build(b)


def within_region(geometry: Column, region: bytes) -> Column:
    """Points strictly within a region of polygons (G13); other geometries are not."""

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(Batch(values.to_list()).within(wkb.from_wkb(region)))

    return test(geometry)


def intersects_region(geometry: Column, region: bytes) -> Column:
    """Geometries that share a position with a region."""

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(Batch(values.to_list()).intersects(wkb.from_wkb(region)))

    return test(geometry)


@F.pandas_udf(T.StructType([*BOX.fields, T.StructField("cx", T.DoubleType()), T.StructField("cy", T.DoubleType())]))
def _box_and_centroid(values: pd.Series) -> pd.DataFrame:
    batch = Batch(values.to_list())
    return pd.DataFrame(np.concatenate([batch.bounds(), batch.centroids()], axis=1), columns=["xmin", "ymin", "xmax", "ymax", "cx", "cy"])


def with_boxes(df: DataFrame, geometry: str = "geometry", bbox: str = "bbox", x: str = "cx", y: str = "cy") -> DataFrame:
    """Adds the covering box and the centroid, computed once from one parse."""
    m = F.col("_m")
    box = F.struct(*[m[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    held = df.withColumn("_m", _box_and_centroid(F.col(geometry)))
    return held.withColumns({bbox: F.when(m.xmin.isNotNull() & ~F.isnan(m.xmin), box), x: m.cx, y: m.cy}).drop("_m")
