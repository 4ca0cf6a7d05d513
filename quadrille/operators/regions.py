"""Region queries: tile lookup, bounding-box filter and exact refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.geometry import wkb
from quadrille.geometry.columns import intersects_region, is_point_type, within_region
from quadrille.sources import files, geojson

#: Tile ids that are turned into a literal list, which prunes partitions; beyond, they are joined.
LITERAL_TILES = 5000


def parse_box(text: str) -> tuple[float, float, float, float]:
    """`minx,miny,maxx,maxy` with ordered sides."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"a box has 4 numbers, not {len(parts)}")
    xmin, ymin, xmax, ymax = (float(p) for p in parts)
    if xmax < xmin or ymax < ymin:
        raise ValueError("a box's maximum lies below its minimum")
    return xmin, ymin, xmax, ymax


def region_geometry(region: str | tuple[float, float, float, float] | wkb.Geometry) -> wkb.Geometry:
    """A region given as a geometry, a box, as `minx,miny,maxx,maxy` or as WKT."""
    if isinstance(region, wkb.Geometry):
        return region
    if isinstance(region, tuple):
        return wkb.rectangle(*region)
    return wkb.from_wkt(region) if "(" in region else wkb.rectangle(*parse_box(region))


def region_from_file(spark: SparkSession, path: str, field: str | None = None, value: str | None = None, geometry: str = "geometry", mercator: bool = False) -> wkb.Geometry:
    """The region that the features of a GeoJSON or GeoParquet file make up together.

    With a field, only features whose value equals `value` as text count; none at all is an
    error. Positions in web Mercator are turned into degrees. A region is one geometry, which reaches the
    driver and every task, as its file does.
    """
    df = geojson.flatten(geojson.read(spark, [path])) if files.format_of(path) == "geojson" else spark.read.parquet(path)
    if field is not None:
        df = df.where(F.col(f"`{field}`").cast("string") == str(value))
    shapes = [wkb.from_wkb(bytes(r[0])) for r in df.select(geometry).where(F.col(geometry).isNotNull()).collect()]
    parts = [p for g in shapes for p in wkb.flat(g)]
    if not parts:
        raise ValueError(f"{path} holds no region" + (f" with {field} = {value}" if field is not None else ""))
    whole = wkb.Geometry("MultiPolygon" if all(p.kind == "Polygon" for p in parts) else "GeometryCollection", parts)
    return wkb.mapped(whole, wkb.degrees_of) if mercator else whole


def region_tiles(tiles: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Tiles whose interior meets the region's bounds."""
    return tiles.where(boxes.overlaps(F.col("box"), boxes.literal_box(*region)))


def bbox_filter(df: DataFrame, region: tuple[float, float, float, float], bbox: str = "bbox") -> DataFrame:
    """Rows whose box touches the region (S4): four comparisons on nested fields, which reach the Parquet scan."""
    xmin, ymin, xmax, ymax = region
    return df.where((F.col(f"{bbox}.xmin") <= xmax) & (F.col(f"{bbox}.xmax") >= xmin) & (F.col(f"{bbox}.ymin") <= ymax) & (F.col(f"{bbox}.ymax") >= ymin))


def query_region(df: DataFrame, region: str | tuple[float, float, float, float] | wkb.Geometry, tiles: DataFrame | None = None, geometry: str = "geometry", bbox: str | None = "bbox", points_only: bool = True, columns: list[str] | None = None, tile_column: str = "tile_id") -> DataFrame:
    """Features within a region (J5, J7): tiles are pruned, boxes are compared in the scan, what is left is tested exactly.

    By default only points strictly within count; with points_only=False every geometry
    that intersects the region does. The geometry is always among the columns.
    """
    shape = region_geometry(region)
    bounds = wkb.bounds(shape)
    if tiles is not None:
        ids = [r[0] for r in region_tiles(tiles, bounds).select("tile_id").limit(LITERAL_TILES + 1).collect()]
        if len(ids) <= LITERAL_TILES:
            df = df.where(F.col(tile_column).isin(ids)) if ids else df.where(F.lit(False))
        else:
            df = df.join(region_tiles(tiles, bounds).select(F.col("tile_id").alias("_t")), F.col(tile_column) == F.col("_t"), "left_semi")
    if bbox and bbox in df.columns:
        df = bbox_filter(df, bounds, bbox)
    shape_bytes = wkb.to_wkb(shape)
    good: Column = is_point_type(F.col(geometry)) & within_region(F.col(geometry), shape_bytes) if points_only else intersects_region(F.col(geometry), shape_bytes)
    out = df.where(good)
    return out.select(*dict.fromkeys([*columns, geometry])) if columns else out
