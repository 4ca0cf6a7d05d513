"""Tile catalogs as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes

# Column names of the two forms of tile files.
LEGACY = ("id", "minx", "miny", "maxx", "maxy")
CATALOG = ("ID", "File Name", "Record Count", "NonEmpty Count", "NumPoints", "Data Size", "Sum_x", "Sum_y", "Geometry", "xmin", "ymin", "xmax", "ymax")
REQUIRED = ("ID", "File Name", "xmin", "ymin", "xmax", "ymax")


def _need(df: DataFrame, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _tiles(df: DataFrame, identity: str, sides: tuple[str, ...]) -> DataFrame:
    """Tiles in the file's order; the ordinal follows from Spark's increasing row numbers."""
    rows = df.withColumn("ordinal", F.monotonically_increasing_id())
    return rows.select(F.col(identity).cast("string").alias("tile_id"), "ordinal", boxes.box(*[F.col(f"`{s}`").cast("double") for s in sides]).alias("box"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, ordinal, box) of a file with id, minx, miny, maxx, maxy (S10); of equal ids the last is kept."""
    df = spark.read.option("header", True).csv(path)
    _need(df, LEGACY)
    tiles = _tiles(df, "id", LEGACY[1:])
    last = tiles.groupBy("tile_id").agg(F.max_by("box", "ordinal").alias("box"), F.min("ordinal").alias("ordinal"))
    return last.select("tile_id", "ordinal", "box")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, ordinal, box) of a catalog (S11), the id from the file's name without its suffix."""
    df = spark.read.option("header", True).csv(path)
    _need(df, REQUIRED)
    named = df.withColumn("_name", F.coalesce(F.regexp_replace("`File Name`", r"\.[^.]*$", ""), F.format_string("part-%05d", F.col("ID").cast("int"))))
    return _tiles(named, "_name", REQUIRED[2:])


def catalog(tiles: DataFrame, stats: DataFrame | None = None, suffix: str = ".parquet") -> DataFrame:
    """The catalog of tiles with their statistics (K7, K8), zeros where there are none; see operators.stats.summary."""
    b = F.col("box")
    if stats is not None:
        tiles = tiles.join(stats, "tile_id", "left")
    value = lambda c, t: (F.coalesce(F.col(c), F.lit(0)) if stats is not None else F.lit(0)).cast(t)
    columns = [F.col("ordinal").cast("int"), F.concat("tile_id", F.lit(suffix)), *[value(c, "long") for c in ("record_count", "nonempty_count", "num_points", "data_size")], *[value(c, "double") for c in ("sum_x", "sum_y")], boxes.polygon_wkt(b), b.xmin, b.ymin, b.xmax, b.ymax]
    return tiles.select(*[c.alias(n) for c, n in zip(columns, CATALOG)])


def write_catalog(df: DataFrame, folder: str) -> None:
    """One CSV file with a header, in the order of ids: a catalog has a row for each tile."""
    df.orderBy(F.col(df.columns[0])).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def missing_statistics(df: DataFrame) -> DataFrame:
    """Rows of a catalog without records, which a strict update reports (K8)."""
    return df.where(F.col("`Record Count`").cast("long") == 0)
