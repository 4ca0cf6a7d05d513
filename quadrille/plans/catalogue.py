"""Queries of the spatial operators on the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille import validate
from quadrille.functions import boxes, curves
from quadrille.geometry import columns as geometry
from quadrille.operators import assign, ordering, regions, stats
from quadrille.operators import tiles as tilesets
from quadrille.plans.features import EXTENT, REGIONS_4, REGIONS_6, REGIONS_12, SQL, features, tiles
from quadrille.session import shared_folder
from quadrille.sources import catalog as tile_listing
from quadrille.sources import files, geojson, geoparquet

REGION = REGIONS_12["california"]
WITH = f"with {SQL}"
CONTAINS = "xmin >= txmin - 1e-9 and xmax <= txmax + 1e-9 and ymin >= tymin - 1e-9 and ymax <= tymax + 1e-9"
TOUCHES = "xmax >= txmin and xmin <= txmax and ymax >= tymin and ymin <= tymax"
OVERLAPS = "not (xmax <= txmin or txmax <= xmin or ymax <= tymin or tymax <= ymin)"
HALF_OPEN = "cx >= txmin and cx < txmax and cy >= tymin and cy < tymax"


def _first(predicate: str, order: str) -> str:
    return f"(select feature_id, xmin, ymin, xmax, ymax, cx, cy, tile_id, row_number() over (partition by feature_id order by {order}) as n from features join tiles on {predicate}) where n = 1"


#: A reproducible number in [0, 1) for a feature, as operators.ordering.uniform.
_UNIFORM = "((((feature_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296) * 69069 + 1) % 4294967296 / 4294967296.0e0"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.assign_contains(features(spark, sf_dir), tiles(spark))


def _sides(b: Column) -> list[Column]:
    return [b[s].alias(s) for s in ("xmin", "ymin", "xmax", "ymax")]


@query(f"{WITH} select tile_id, count(*) as n, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from {_first(CONTAINS, 'tarea, ordinal')} group by tile_id")
def tile_extent(spark, sf_dir):
    return stats.extent(_assigned(spark, sf_dir).where(F.col("tile_id").isNotNull()), ["tile_id"])


@query(f"{WITH} select tile_id, count(*) as n from features join tiles on {OVERLAPS} group by tile_id")
def tile_counts(spark, sf_dir):
    return assign.assign_covering(features(spark, sf_dir), tiles(spark)).groupBy("tile_id").agg(F.count("*").alias("n"))


@query(f"{WITH} select feature_id, tile_id from {_first(CONTAINS, 'tarea, ordinal')}")
def assign_contains(spark, sf_dir):
    return _assigned(spark, sf_dir).where(F.col("tile_id").isNotNull()).select("feature_id", "tile_id")


@query(f"{WITH} select feature_id, tile_id from {_first(TOUCHES, 'tarea, ordinal')}")
def assign_smallest_intersecting(spark, sf_dir):
    return assign.assign_smallest_intersecting(features(spark, sf_dir), tiles(spark), "feature_id").select("feature_id", "tile_id")


@query(f"{WITH} select feature_id, tile_id from {_first(HALF_OPEN, 'ordinal')}")
def assign_disjoint(spark, sf_dir):
    return assign.assign_disjoint(features(spark, sf_dir), tiles(spark)).where(F.col("tile_id").isNotNull()).select("feature_id", "tile_id")


@query(f"{WITH} select feature_id, tile_id from features join tiles on {OVERLAPS}")
def assign_covering(spark, sf_dir):
    return assign.assign_covering(features(spark, sf_dir), tiles(spark)).select("feature_id", "tile_id")


_SIDE = "greatest(0.0e0, least({hi}, {b}) - greatest({lo}, {a}))"
_GROWN = " * ".join(_SIDE.format(lo=lo, hi=hi, a=f"least(t{n}min, {n}min)", b=f"greatest(t{n}max, {n}max)") for n, lo, hi in (("x", "-125.0e0", "-65.0e0"), ("y", "24.0e0", "50.0e0")))
_PLAIN = " * ".join(_SIDE.format(lo=lo, hi=hi, a=f"t{n}min", b=f"t{n}max") for n, lo, hi in (("x", "-125.0e0", "-65.0e0"), ("y", "24.0e0", "50.0e0")))


@query(
    f"{WITH}, best as (select feature_id, tile_id from {_first(OVERLAPS, f'({_GROWN}) - ({_PLAIN}), tarea, ordinal')}), lone as (select feature_id, floor({_UNIFORM} * 24)::bigint as place from features where feature_id not in (select feature_id from best)) "
    "select feature_id, tile_id from best union all select feature_id, tile_id from lone join tiles on ordinal = place"
)
def assign_min_expansion(spark, sf_dir):
    """Features that overlap no tile get one by a reproducible number of their key."""
    return assign.assign_min_expansion(features(spark, sf_dir), tiles(spark), "feature_id", EXTENT).select("feature_id", "tile_id")


@query(f"{WITH} select feature_id from features where not exists (select 1 from tiles where {CONTAINS})")
def assign_skipped(spark, sf_dir):
    f = features(spark, sf_dir)
    return assign.skipped(f, assign.assign_contains(f, tiles(spark)), "feature_id").select("feature_id")


@query(f"{WITH}, a as (select count(*) as assigned from {_first(CONTAINS, 'ordinal')}), s as (select count(*) as seen from features) select seen, assigned, seen - assigned as skipped from s, a")
def assign_counts(spark, sf_dir):
    f = features(spark, sf_dir)
    return assign.counts(f, assign.assign_contains(f, tiles(spark)))


@query(f"{WITH} select count(*) as n, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from features")
def global_extent(spark, sf_dir):
    return stats.extent(features(spark, sf_dir))


@query(
    f"{WITH}, p as (select feature_id, tile_id, case when feature_id % 4 <> 0 then cx end as x, case when feature_id % 3 <> 0 then cy end as y, case when feature_id % 5 <> 0 then 'g' end as geom from {_first(HALF_OPEN, 'ordinal')}) "
    "select tile_id, count(*) as record_count, count(geom) as nonempty_count, count(*) filter (x is not null and y is not null) as num_points, 0::bigint as data_size, "
    "round(coalesce(sum(x) filter (y is not null), 0), 6) as sum_x, round(coalesce(sum(y) filter (x is not null), 0), 6) as sum_y from p group by tile_id"
)
def tile_catalog_stats(spark, sf_dir):
    a = assign.assign_disjoint(features(spark, sf_dir), tiles(spark)).where(F.col("tile_id").isNotNull())
    k = F.col("feature_id")
    p = a.select("tile_id", F.when(k % 4 != 0, F.col("cx")).alias("x"), F.when(k % 3 != 0, F.col("cy")).alias("y"), F.when(k % 5 != 0, F.lit("g")).alias("geom"))
    return stats.summary(p, ["tile_id"]).withColumns({c: F.round(c, 6) for c in ("sum_x", "sum_y")})


def _region_sql(r) -> dict[str, str]:
    return dict(zip(("a", "b", "c", "d"), (f"{v!r}::double" for v in r)))


_R = _region_sql(REGION)


@query(f"{WITH} select tile_id, ordinal from tiles where not (txmax <= {_R['a']} or {_R['c']} <= txmin or tymax <= {_R['b']} or {_R['d']} <= tymin)")
def region_tiles(spark, sf_dir):
    return regions.region_tiles(tiles(spark), REGION).select("tile_id", "ordinal")


@query(f"{WITH} select feature_id, xmin, ymin, xmax, ymax from features where xmin <= {_R['c']} and xmax >= {_R['a']} and ymin <= {_R['d']} and ymax >= {_R['b']}")
def region_bbox_filter(spark, sf_dir):
    return regions.bbox_filter(features(spark, sf_dir), REGION).select("feature_id", *_sides(F.col("bbox")))


@query(f"{WITH} select feature_id, tile_id from {_first(HALF_OPEN, 'ordinal')} and feature_id % 35 = 0 and xmin > {_R['a']} and xmin < {_R['c']} and ymin > {_R['b']} and ymin < {_R['d']}")
def region_points_within(spark, sf_dir):
    """Tile pruning, box filter and the exact test on points; other features are rectangles."""
    f = assign.assign_disjoint(features(spark, sf_dir), tiles(spark)).where(F.col("tile_id").isNotNull())
    b = F.col("bbox")
    shaped = f.withColumn("geometry", F.when(F.col("feature_id") % 35 == 0, geometry.point_wkb(b.xmin, b.ymin)).otherwise(geometry.rectangle_wkb(b)))
    return regions.query_region(shaped, REGION, tiles(spark)).select("feature_id", "tile_id")


@query(f"{WITH} select feature_id from features where xmin <= {_R['c']} and xmax >= {_R['a']} and ymin <= {_R['d']} and ymax >= {_R['b']}")
def region_intersects(spark, sf_dir):
    """Exact intersection of rectangles with a region, the region given as text."""
    return _region_intersects(features(spark, sf_dir))


def _region_intersects(f: DataFrame) -> DataFrame:
    f = f.withColumn("geometry", geometry.rectangle_wkb(F.col("bbox")))
    return regions.query_region(f, ",".join(map(str, REGION)), points_only=False).select("feature_id")


def _region_counts(named: dict):
    def run(spark, sf_dir):
        listed = F.array(*[F.struct(F.lit(k).alias("region"), boxes.literal_box(*r).alias("box")) for k, r in named.items()])
        b = F.col("bbox")
        met = features(spark, sf_dir).select("bbox", F.explode(F.filter(listed, lambda r: boxes.touches(b, r.box))).alias("r"))
        return met.groupBy(F.col("r.region").alias("region")).agg(F.count("*").alias("n"))

    return run


def _region_counts_sql(named: dict) -> str:
    values = ", ".join(f"('{k}', {', '.join(_region_sql(r).values())})" for k, r in named.items())
    return f"{WITH}, regions(region, a, b, c, d) as (values {values}) select region, count(*) as n from features join regions on xmin <= c and xmax >= a and ymin <= d and ymax >= b group by region"


for _name, _set in (("region_4_counts", REGIONS_4), ("region_6_counts", REGIONS_6), ("region_12_counts", REGIONS_12)):
    QUERIES[_name], ORACLES[_name] = _region_counts(_set), _region_counts_sql(_set)


def _spread_sql(v: str) -> str:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = f"list_transform([{v}], lambda w: (w | (w << {shift})) & {mask}::bigint)[1]"
    return v


_MORTON = f"(({_spread_sql('gy')} << 1) | {_spread_sql('gx')})"
_EXTENT_GRID = "g as (select *, trunc(greatest(0.0e0, least(1.0e0, (cx + 125.0e0) / 60.0e0)) * {t}::double)::bigint as gx, trunc(greatest(0.0e0, least(1.0e0, (cy - 24.0e0) / 26.0e0)) * {t}::double)::bigint as gy from features)"
_WORLD_GRID = "g as (select *, round_even(greatest(0.0e0, least({t}::double, (cx + 180.0e0) / 360.0e0 * {t}::double)), 0)::bigint as gx, round_even(greatest(0.0e0, least({t}::double, (cy + 90.0e0) / 180.0e0 * {t}::double)), 0)::bigint as gy from features)"


def _extent_columns() -> tuple[Column, ...]:
    return tuple(F.lit(v) for v in EXTENT)


@query(f"{WITH}, {_EXTENT_GRID.format(t=2**16 - 1)} select feature_id, {_MORTON} as zkey16 from g")
def morton_extent(spark, sf_dir):
    return curves.curve_key(features(spark, sf_dir), F.col("cx"), F.col("cy"), "zorder", 16, _extent_columns()).select("feature_id", "zkey16")


@query(f"{WITH}, {_WORLD_GRID.format(t=2**24 - 1)} select feature_id, {_MORTON} as zkey24 from g")
def morton_world(spark, sf_dir):
    return curves.curve_key(features(spark, sf_dir), F.col("cx"), F.col("cy"), "zorder", 24).select("feature_id", "zkey24")


def _hilbert_sql(bits: int) -> str:
    """The usual iteration from the highest bit, a subquery for each."""
    inner = "select feature_id, gx as x, gy as y, 0::bigint as d from g"
    for i in range(bits - 1, -1, -1):
        low = 2**i - 1
        inner = f"select feature_id, x & {low} as xl, y & {low} as yl, (x >> {i}) & 1 as rx, (y >> {i}) & 1 as ry, d from ({inner})"
        flip = lambda v: f"case when ry = 0 and rx = 1 then {low} - {v} else {v} end"  # noqa: B023, E731
        inner = f"select feature_id, case when ry = 0 then {flip('yl')} else xl end as x, case when ry = 0 then {flip('xl')} else yl end as y, d + (xor(3 * rx, ry) << {2 * i}) as d from ({inner})"
    return inner


@query(f"{WITH}, {_EXTENT_GRID.format(t=2**8 - 1)} select feature_id, d as hkey8 from ({_hilbert_sql(8)})")
def hilbert_8(spark, sf_dir):
    return curves.curve_key(features(spark, sf_dir), F.col("cx"), F.col("cy"), "hilbert", 8, _extent_columns()).select("feature_id", "hkey8")


@query(f"{WITH}, {_WORLD_GRID.format(t=2**24 - 1)} select feature_id, d as hkey24 from ({_hilbert_sql(24)})")
def hilbert_world(spark, sf_dir):
    return curves.curve_key(features(spark, sf_dir), F.col("cx"), F.col("cy"), "hilbert", 24).select("feature_id", "hkey24")


@query(f"{WITH}, a as (select * from {_first(CONTAINS, 'ordinal')}), {_EXTENT_GRID.format(t=2**16 - 1).replace('from features', 'from a')} select feature_id, tile_id, row_number() over (partition by tile_id order by {_MORTON}, feature_id)::int as place from g")
def tile_zorder_rank(spark, sf_dir):
    keyed = curves.curve_key(_assigned(spark, sf_dir).where(F.col("tile_id").isNotNull()), F.col("cx"), F.col("cy"), "zorder", 16, _extent_columns())
    order = Window.partitionBy("tile_id").orderBy("zkey16", "feature_id")
    return keyed.select("feature_id", "tile_id", F.row_number().over(order).alias("place"))


@query(f"{WITH} select feature_id, round(radians(cx) * 6378137.0e0, 3) as mx, round(ln(tan(pi() / 4 + radians(cy) / 2)) * 6378137.0e0, 3) as my from features")
def mercator_forward(spark, sf_dir):
    x, y = boxes.to_mercator(F.col("cx"), F.col("cy"))
    return features(spark, sf_dir).select("feature_id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query(f"{WITH} select feature_id, round(cx, 6) as lon, round(cy, 6) as lat from features")
def mercator_round_trip(spark, sf_dir):
    x, y = boxes.from_mercator(*boxes.to_mercator(F.col("cx"), F.col("cy")))
    return features(spark, sf_dir).select("feature_id", F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))



@query(f"{WITH} select feature_id from features where {_UNIFORM} < 0.1e0")
def sample_hash(spark, sf_dir):
    return ordering.sample_fraction(features(spark, sf_dir), "feature_id", 0.1).select("feature_id")


@query(f"{WITH} select feature_id from features order by {_UNIFORM}, feature_id limit 100")
def sample_top_k(spark, sf_dir):
    return ordering.sample_rows(features(spark, sf_dir), "feature_id", 100).select("feature_id")


@query(f"{WITH}, b as (select feature_id, (floor((cx + 125.0e0) / 5.0e0) * 100 + floor((cy - 24.0e0) / 5.0e0))::bigint as bin from features), n as (select bin, count(*) as c from b group by bin) select feature_id, b.bin, greatest(0, (b.bin * 7) // c)::bigint as weight from b join n on b.bin = n.bin")
def bin_weights(spark, sf_dir):
    place = (F.floor((F.col("cx") + 125.0) / 5.0) * 100 + F.floor((F.col("cy") - 24.0) / 5.0)).cast("long")
    return stats.bin_weights(features(spark, sf_dir), place, place * 7).select("feature_id", F.col("_bin").alias("bin"), "weight")


@query(f"{WITH}, {_WORLD_GRID.format(t=2**16 - 1)}, k as (select feature_id, case when feature_id % 9 = 0 then null else {_MORTON} end as zkey16 from g) select feature_id, row_number() over (order by zkey16 nulls last, feature_id) as place from k")
def null_geometry_last(spark, sf_dir):
    x, y = (F.when(F.col("feature_id") % 9 != 0, F.col(c)) for c in ("cx", "cy"))
    keyed = curves.curve_key(features(spark, sf_dir), x, y, "zorder", 16).select("feature_id", "zkey16")
    return ordering.places(keyed, [F.col("zkey16").asc_nulls_last(), F.col("feature_id")]).select("feature_id", "place")


@query(f"{WITH} select feature_id, case when feature_id % 2 = 0 then cx end as cx, case when feature_id % 2 = 1 then cy end as cy from features")
def union_promote(spark, sf_dir):
    f = features(spark, sf_dir)
    return ordering.union_promote([f.where("feature_id % 2 = 0").select("feature_id", "cx"), f.where("feature_id % 2 = 1").select("feature_id", "cy")])


@query("select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def property_keys(spark, sf_dir):
    return stats.property_keys(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props", ["event_id"])


def _size_sql() -> str:
    cases = " ".join(f"when v >= {1024**p}::double then printf('%.2f {u}', v / {1024**p}::double)" for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    return f"select doc_id, case {cases} else printf('%.2f B', v) end as size from (select doc_id, (n_chars * n_chars)::double as v from documents)"


@query(_size_sql())
def human_size(spark, sf_dir):
    n = F.col("n_chars")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", boxes.human_size(n * n).alias("size"))


@query(f"{WITH} select count(*) as seen, count(*) filter (xmin <= {_R['c']} and xmax >= {_R['a']} and ymin <= {_R['d']} and ymax >= {_R['b']}) as kept, kept::double / seen as ratio from features")
def keep_ratio(spark, sf_dir):
    return stats.keep_ratio(features(spark, sf_dir), boxes.touches(F.col("bbox"), boxes.literal_box(*REGION)))


@query(
    f"{WITH} select feature_id, tile_id, round((xmax - xmin) * (ymax - ymin), 9) as area, round((xmax - xmin) + (ymax - ymin), 9) as margin, "
    "round(greatest(least(xmax, txmax) - greatest(xmin, txmin), 0) * greatest(least(ymax, tymax) - greatest(ymin, tymin), 0), 9) as shared, "
    f"round((greatest(xmax, txmax) - least(xmin, txmin)) * (greatest(ymax, tymax) - least(ymin, tymin)), 9) as merged from features join tiles on {OVERLAPS}"
)
def envelope_algebra(spark, sf_dir):
    met = assign._pairs(features(spark, sf_dir), assign.TileIndex(tiles(spark)), "bbox", boxes.overlaps)
    b, t = F.col("bbox"), F.col("_tile").box
    measures = {"area": boxes.area(b), "margin": boxes.margin(b), "shared": boxes.overlap_area(b, t), "merged": boxes.area(boxes.merge(b, t))}
    return met.select("feature_id", F.col("_tile").tile_id.alias("tile_id"), *[F.round(v, 9).alias(k) for k, v in measures.items()])


@query(f"{WITH} select tile_id, ordinal, txmin as xmin, tymin as ymin, txmax as xmax, tymax as ymax from tiles")
def tile_grid(spark, sf_dir):
    return tiles(spark).select("tile_id", "ordinal", *_sides(F.col("box")))


@query(f"{WITH} select feature_id, 'Polygon' as kind, xmin, ymin, xmax, ymax, round(cx, 6) as x, round(cy, 6) as y, false as is_empty, true as is_oriented from features")
def wkb_measures(spark, sf_dir):
    """Rectangles as WKB, measured by the geometry kernel."""
    return _wkb_measures(features(spark, sf_dir))


def _wkb_measures(f: DataFrame) -> DataFrame:
    f = f.select("feature_id", geometry.rectangle_wkb(F.col("bbox")).alias("g"))
    g = F.col("g")
    m = f.select("feature_id", geometry.type_name(g).alias("kind"), geometry.bounds(g).alias("b"), geometry.centroid(g).alias("c"), geometry.is_empty(g).alias("is_empty"), geometry.well_oriented(g).alias("is_oriented"))
    return m.select("feature_id", "kind", *_sides(F.col("b")), F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), "is_empty", "is_oriented")


@query(f"{WITH} select feature_id, cx as x, cy as y, true as is_same, true as is_point from features")
def text_round_trip(spark, sf_dir):
    """Points to WKT and GeoJSON and back."""
    return _text_round_trip(features(spark, sf_dir))


def _text_round_trip(f: DataFrame) -> DataFrame:
    f = f.withColumn("g", geometry.point_wkb(F.col("cx"), F.col("cy")))
    back = f.select("feature_id", "g", geometry.from_wkt(geometry.to_wkt(F.col("g"))).alias("w"), geometry.from_geojson(geometry.to_geojson(F.col("g"))).alias("j"))
    c = geometry.centroid(F.col("w"))
    return back.select("feature_id", c.x.alias("x"), c.y.alias("y"), ((F.col("g") == F.col("w")) & (F.col("g") == F.col("j"))).alias("is_same"), geometry.is_point_type(F.col("g")).alias("is_point"))


@query(f"{WITH} select feature_id, row_number() over (order by floor(cx) desc, cy, feature_id)::bigint as place from features")
def sort_columns(spark, sf_dir):
    f = features(spark, sf_dir).select("feature_id", "cy", F.floor("cx").alias("column"))
    return ordering.places(f, ordering.order_by(ordering.sort_keys("column:desc,cy:asc,feature_id"))).select("feature_id", "place")


@query()
def partition_tiles(spark, sf_dir):
    """Boxes of the splitter over a sample of centroids."""
    return tilesets.partition(features(spark, sf_dir), 24, "feature_id").select("tile_id", "ordinal", *_sides(F.col("box")))


@query()
def partition_histogram(spark, sf_dir):
    """Boxes of the weighted splitter over a grid histogram of all centroids; they fill the plane."""
    return tilesets.partition_by_histogram(features(spark, sf_dir), 24, cells=True).select("tile_id", "ordinal", *_sides(F.col("box")))


@query(f"{WITH} select count(*) as points, ceil(count(*) / 24.0e0)::bigint as capacity, true as is_within, true as is_tight, 0::bigint as overlaps from features")
def partition_tiles_checked(spark, sf_dir):
    """What the splitter's tiles promise: no part beyond its capacity, tight boxes that together hold every point and do not overlap.

    Tiles are made of all points and every point is looked up in them; features without a point are counted, but lie in no tile.
    """
    f = tilesets.computed(features(spark, sf_dir), F.col("cx"), F.col("cy"))
    has_point = boxes.is_finite(F.col("cx")) & boxes.is_finite(F.col("cy"))
    held = tilesets.partition_whole(f, 24)
    spots = f.where(has_point).withColumn("bbox", boxes.box(F.col("cx"), F.col("cy"), F.col("cx"), F.col("cy")))
    met = assign._pairs(spots, assign.TileIndex(held), "bbox", boxes.touches)
    by_tile = met.groupBy(F.col("_tile").tile_id.alias("tile_id"), F.col("_tile").box.alias("box")).agg(F.count("*").alias("n"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    b, o = F.col("box"), F.col("other.box")
    shared = held.alias("t").join(held.alias("other"), F.expr("t.tile_id < other.tile_id")).where(boxes.overlaps(F.col("t.box"), o)).agg(F.count("*").alias("overlaps"))
    tight = (F.col("x0") == b.xmin) & (F.col("x1") == b.xmax) & (F.col("y0") == b.ymin) & (F.col("y1") == b.ymax)
    pointless = f.where(~has_point).agg(F.count("*").alias("pointless"))
    total = by_tile.agg(F.sum("n").alias("held"), F.max("n").alias("most"), F.bool_and(tight).alias("is_tight"))
    for other in (shared, pointless):
        total = total.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one").drop("_one")
    points = F.col("held") + F.col("pointless")
    capacity = F.ceil(points / F.lit(24.0))
    return total.select(points.alias("points"), capacity.alias("capacity"), (F.col("most") <= capacity).alias("is_within"), "is_tight", "overlaps")


@query(f"{WITH} select feature_id, 1::bigint as tiles from features")
def partition_cells_hold_all(spark, sf_dir):
    """Tiles of the histogram splitter fill the plane: each centroid lies in one, half-open."""
    held = tilesets.partition_by_histogram(features(spark, sf_dir), 24, cells=True)
    f = features(spark, sf_dir)
    x, y = F.col("cx"), F.col("cy")
    spot = f.select("feature_id", "cx", "cy", boxes.box(x, y, x, y).alias("bbox"))
    met = assign._pairs(spot, assign.TileIndex(held), "bbox", boxes.touches).where(boxes.holds_point(F.col("_tile").box, x, y))
    return met.groupBy("feature_id").agg(F.count("*").alias("tiles"))


def _corner_sql(x: str, y: str) -> str:
    return f"{x}::varchar || ' ' || {y}::varchar"


_RING = " || ', ' || ".join(_corner_sql(f"tx{a}", f"ty{b}") for a, b in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min")))


@query(
    f"{WITH}, s as (select tile_id, count(*) as n, sum(cx) as sx, sum(cy) as sy from {_first(HALF_OPEN, 'ordinal')} group by tile_id) "
    "select ordinal::int as \"ID\", tile_id || '.parquet' as \"File Name\", coalesce(n, 0)::bigint as \"Record Count\", coalesce(n, 0)::bigint as \"NonEmpty Count\", coalesce(n, 0)::bigint as \"NumPoints\", 0::bigint as \"Data Size\", "
    "round(coalesce(sx, 0), 6) as \"Sum_x\", round(coalesce(sy, 0), 6) as \"Sum_y\", "
    f"'POLYGON ((' || {_RING} || '))' as \"Geometry\", txmin as xmin, tymin as ymin, txmax as xmax, tymax as ymax from tiles left join s using (tile_id)"
)
def tile_catalog(spark, sf_dir):
    a = assign.assign_disjoint(features(spark, sf_dir), tiles(spark)).where(F.col("tile_id").isNotNull()).withColumnsRenamed({"cx": "x", "cy": "y"})
    listed = tile_listing.catalog(tiles(spark), stats.summary(a, ["tile_id"]))
    return listed.withColumns({c: F.round(c, 6) for c in ("Sum_x", "Sum_y")})


@query(f"{WITH} select tile_id, count(*) as rows, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from {_first(HALF_OPEN, 'ordinal')} group by tile_id")
def tiles_written(spark, sf_dir):
    """One GeoParquet file for each tile, along a Hilbert curve; rows and bounds as the writer gathered them."""
    f = features(spark, sf_dir).withColumn("geometry", geometry.rectangle_wkb(F.col("bbox")))
    written = geoparquet.write_tiles(assign.assign_disjoint(f, tiles(spark)), shared_folder(spark, "tiles"), bbox="bbox")
    return written.select("tile_id", "rows", "xmin", "ymin", "xmax", "ymax")


def _written_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Curve-sorted files with covering boxes; a path for each, as many as partitions."""
    f = features(spark, sf_dir).withColumn("geometry", geometry.rectangle_wkb(F.col("bbox")))
    return [r.path for r in geoparquet.write_clustered(f, shared_folder(spark, "sorted"), partitions=4, row_group_rows=2000).collect()]


@query(f"{WITH} select feature_id, xmin, ymin, xmax, ymax from features where xmin <= {_R['c']} and xmax >= {_R['a']} and ymin <= {_R['d']} and ymax >= {_R['b']}")
def geoparquet_pushdown(spark, sf_dir):
    """Written with covering boxes and read with a region, which prunes row groups."""
    return geoparquet.read(spark, _written_files(spark, sf_dir), ["feature_id", "bbox"], REGION).select("feature_id", *_sides(F.col("bbox")))


@query(f"{WITH} select count(*)::bigint as rows, 0::bigint as findings from features")
def footers_and_findings(spark, sf_dir):
    """Rows by footers alone, and findings of the validator with data checks on files just written."""
    paths = _written_files(spark, sf_dir)
    rows = files.footers(spark, paths).agg(F.sum("rows").alias("rows")).withColumn("_one", F.lit(1))
    found = validate.validate(spark, paths, check_data=True).agg(F.count("*").alias("findings")).withColumn("_one", F.lit(1))
    return rows.join(found, "_one").select("rows", "findings")


def _own(**more) -> dict:
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"]} | more}}


#: Footers with a fault each, and the checks that find it; None has no geo key, text is no JSON.
FAULTS = {
    "no_key": (None, ["V2"]),
    "no_json": ("{", ["V3"]),
    "no_object": ([], ["V3"]),
    "no_version": (_own() | {"version": 1}, ["V4"]),
    "no_columns": ({"version": "1.1.0", "primary_column": "geometry"}, ["V6"]),
    "encoding": (_own(encoding="WKT"), ["V5"]),
    "absent_column": (_own() | {"primary_column": "other", "columns": {"other": _own()["columns"]["geometry"]}}, ["V7"]),
    "system": (_own(crs={"type": "ProjectedCRS", "name": "x"}), ["V8"]),
    "bounds": (_own(bbox=[0, 5, 1, 4]), ["V9"]),
    "repeated_type": (_own(geometry_types=["Point", "Point"]), ["V10"]),
    "nesting": (_own(encoding="polygon", geometry_types=["Polygon"]), ["V12"]),
    "schema": (_own() | {"odd": 1}, ["V5"]),
    "sound": (_own(), []),
}
GEO_SCHEMA = {"type": "object", "properties": {"version": {"type": ["string", "integer"]}, "primary_column": {"type": "string"}, "columns": {"type": "object", "minProperties": 1}}, "additionalProperties": False}


@query(
    f"{WITH}, faults(file, \"check\", findings) as (values " + ", ".join(f"('{k}', '{c}', 1::bigint)" for k, (_, checks) in FAULTS.items() for c in checks) + ", ('no_object', 'V5', 1::bigint)) "
    "select * from faults union all select 'undeclared', 'V11', count(*) from features where feature_id % 35 <> 0"
)
def validator_findings(spark, sf_dir):
    """Findings on files with one fault each, and on files of all features that declare points alone."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark import TaskContext

    folder = shared_folder(spark, "faults")

    def write(name: str, geo, values: list) -> None:
        table = pa.table({"geometry": pa.array(values, pa.binary())})
        if geo is not None:
            table = table.replace_schema_metadata({"geo": geo if isinstance(geo, str) else json.dumps(geo)})
        where, base = files.open_fs(folder)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{name}.parquet") as out:
            pq.write_table(table, out)

    def run(batches):
        for i, batch in enumerate(batches):
            name = f"undeclared-{TaskContext.get().partitionId()}-{i}"
            write(name, _own(), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"name": [name]})

    for name, (geo, _) in FAULTS.items():
        write(name, geo, [])
    b = F.col("bbox")
    shaped = features(spark, sf_dir).select(F.when(F.col("feature_id") % 35 == 0, geometry.point_wkb(b.xmin, b.ymin)).otherwise(geometry.rectangle_wkb(b)).alias("geometry"))
    shaped.mapInArrow(run, "name string").count()
    found = validate.validate(spark, files.find_files(spark, [folder]), check_data=True, schema=GEO_SCHEMA)
    name = F.regexp_extract("path", r"/([a-z_]+)[-0-9]*\.parquet$", 1)
    return found.groupBy(name.alias("file"), "check").agg(F.count("*").alias("findings"))


@query(f"{WITH} select feature_id, cx as x, cy as y, cx as xmin, cy as ymin, cx as xmax, cy as ymax from features")
def geojson_round_trip(spark, sf_dir):
    """Points written as GeoJSON lines and read back by the incremental reader."""
    return _geojson_round_trip(spark, features(spark, sf_dir))


def _geojson_round_trip(spark: SparkSession, f: DataFrame) -> DataFrame:
    f = f.withColumn("g", geometry.to_geojson(geometry.point_wkb(F.col("cx"), F.col("cy"))))
    folder = shared_folder(spark, "lines")
    geojson.write_lines(geojson.feature_json(["feature_id"], F.col("g")), f, folder, "gzip")
    flat = geojson.flatten(geojson.read(spark, files.find_files(spark, [folder], ".gz")), "feature_id long")
    c = geometry.centroid(F.col("geometry"))
    return flat.select("feature_id", c.x.alias("x"), c.y.alias("y"), *_sides(F.col("bbox")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
