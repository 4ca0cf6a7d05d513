"""Extents, counts and file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which coordinates and geometries are looked for, in this order.
X_NAMES, Y_NAMES = ("x", "lon", "longitude"), ("y", "lat", "latitude")
GEOMETRY_NAMES = ("geometry", "geom", "wkb", "wkt")


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate among the columns, exactly or else in any case."""
    folded = {c.lower(): c for c in reversed(columns)}
    for name in candidates:
        if name in columns:
            return name
        if name.lower() in folded:
            return folded[name.lower()]
    return None


def extent_columns(bbox: Column) -> list[Column]:
    return [F.min(bbox.xmin).alias("xmin"), F.min(bbox.ymin).alias("ymin"), F.max(bbox.xmax).alias("xmax"), F.max(bbox.ymax).alias("ymax")]


def extent(df: DataFrame, by: list[str] | None = None, bbox: str = "bbox") -> DataFrame:
    """Rows and bounds of the boxes, over all rows or for each group; null boxes count as rows only (A1, A2, A10)."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *extent_columns(F.col(bbox)))


def summary(df: DataFrame, by: list[str], x: str | None = None, y: str | None = None, geometry: str | None = None, size: Column | None = None) -> DataFrame:
    """Catalog statistics (A4): records, rows with a geometry, points with both coordinates and their sums, bytes.

    Columns are looked for by their usual names where none is given. Without coordinates
    the points are the rows with a geometry, or all rows where there is none.
    """
    x, y, geometry = x or find_column(df.columns, X_NAMES), y or find_column(df.columns, Y_NAMES), geometry or find_column(df.columns, GEOMETRY_NAMES)
    records = F.count("*")
    nonempty = F.count(F.col(geometry)) if geometry else records
    if x and y:
        cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
        both = cx.isNotNull() & cy.isNotNull() & ~F.isnan(cx) & ~F.isnan(cy)
        points, sums = F.count_if(both), [F.coalesce(F.sum(F.when(both, c)), F.lit(0.0)) for c in (cx, cy)]
    else:
        points, sums = F.when(nonempty > 0, nonempty).otherwise(records), [F.lit(0.0), F.lit(0.0)]
    return df.groupBy(*by).agg(
        records.alias("record_count"), nonempty.alias("nonempty_count"), points.alias("num_points"), (F.max(size) if size is not None else F.lit(0)).cast("long").alias("data_size"), sums[0].alias("sum_x"), sums[1].alias("sum_y")
    )


def bin_weights(df: DataFrame, bin_id: Column, bin_value: Column) -> DataFrame:
    """Adds _bin and weight: the bin's value shared evenly by its points, floored, never negative."""
    marked = df.withColumns({"_bin": bin_id, "_value": bin_value})
    sizes = marked.groupBy("_bin").agg(F.count("*").alias("_n"))
    share = F.greatest(F.lit(0).cast("long"), F.floor(F.col("_value") / F.col("_n")))
    return marked.join(sizes, "_bin").withColumn("weight", share).drop("_value", "_n")


def property_keys(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(key, n): keys of a JSON object column over all rows, in order of first appearance by `order`."""
    keys = df.select(*order, F.posexplode(F.json_object_keys(column)).alias("_at", "key"))
    return keys.groupBy("key").agg(F.min(F.struct(*order, "_at")).alias("_first"), F.count("*").alias("n")).orderBy("_first").select("key", "n")


def keep_ratio(df: DataFrame, condition: Column) -> DataFrame:
    """Rows seen, kept, and their ratio."""
    return df.agg(F.count("*").alias("seen"), F.count_if(condition).alias("kept")).withColumn("ratio", F.try_divide(F.col("kept").cast("double"), F.col("seen")))
