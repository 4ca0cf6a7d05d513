"""Features and tiles derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.operators.tiles import grid

EXTENT = (-125.0, 24.0, -65.0, 50.0)
# Named regions as (xmin, ymin, xmax, ymax).
REGIONS_4 = {"ucr": (-117.35, 33.95, -117.30, 34.00), "riverside": (-117.55, 33.85, -117.25, 34.05), "county": (-118.00, 33.40, -116.40, 34.20), "southern_ca": (-119.00, 32.50, -115.50, 34.50)}
REGIONS_12 = {
    "ucr_core": (-117.35, 33.95, -117.30, 34.00),
    "riverside_city": (-117.50, 33.85, -117.25, 34.05),
    "riverside_county": (-117.80, 33.35, -114.40, 34.90),
    "inland_empire": (-117.90, 33.50, -116.40, 34.40),
    "socal_core": (-119.20, 32.40, -116.00, 34.60),
    "socal_wide": (-121.00, 32.20, -114.00, 35.00),
    "california": (-124.50, 32.50, -114.10, 42.05),
    "west_coast": (-125.00, 32.00, -116.00, 49.50),
    "far_west": (-125.00, 31.00, -108.00, 49.50),
    "western_us": (-125.00, 31.00, -102.00, 49.50),
    "lower48": (-125.00, 24.00, -66.50, 49.50),
    "usa_all_bbox": (-179.50, 17.50, -65.00, 71.80),
}
REGIONS_6 = {k: REGIONS_12[k] for k in ("ucr_core", "riverside_city", "riverside_county", "socal_core", "california", "lower48")}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, bbox, cx, cy): a box for each order, a point where the key is a multiple of 35."""
    k = F.col("o_orderkey")
    xmin = F.lit(-125.0) + (k * 7919 % 58500).cast("double") / 1000.0
    ymin = F.lit(24.0) + (k * 104729 % 25500).cast("double") / 1000.0
    sided = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("feature_id"), xmin.alias("xmin"), ymin.alias("ymin"))
    key = F.col("feature_id")
    b = boxes.box(F.col("xmin"), F.col("ymin"), F.col("xmin") + (key % 7).cast("double") / 10.0, F.col("ymin") + (key % 5).cast("double") / 10.0)
    x, y = boxes.centre(F.col("bbox"))
    return sided.select("feature_id", b.alias("bbox")).withColumns({"cx": x, "cy": y})


def tiles(spark: SparkSession) -> DataFrame:
    """A grid of 6 by 4 tiles of 10.0 by 6.5 degrees."""
    return grid(spark, -125.0, 24.0, 6, 4, 10.0, 6.5)


SQL = """
f0 as (select o_orderkey as feature_id, -125.0e0 + ((o_orderkey * 7919) % 58500) / 1000.0e0 as xmin, 24.0e0 + ((o_orderkey * 104729) % 25500) / 1000.0e0 as ymin from orders),
f1 as (select *, xmin + (feature_id % 7) / 10.0e0 as xmax, ymin + (feature_id % 5) / 10.0e0 as ymax from f0),
features as (select *, (xmin + xmax) / 2 as cx, (ymin + ymax) / 2 as cy from f1),
t0 as (select i as ordinal, 'tile_' || lpad(i::varchar, 6, '0') as tile_id, -125.0e0 + (i % 6) * 10.0e0 as txmin, 24.0e0 + (i // 6) * 6.5e0 as tymin from range(24) r(i)),
tiles as (select *, txmin + 10.0e0 as txmax, tymin + 6.5e0 as tymax, 10.0e0 * 6.5e0 as tarea from t0)"""
