import gzip
import io
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille import validate
from quadrille.functions import boxes
from quadrille.geometry import columns as geometry
from quadrille.geometry import wkb
from quadrille.operators import assign, regions, stats
from quadrille.operators.tiles import tile_frame
from quadrille.sources import catalog, files, geojson, geoparquet
from quadrille.streaming.tiles import assign_stream


def feature(i, geometry, **more):
    return {"type": "Feature", "properties": {"id": i, "name": f"n{i}", **({"extra": i / 2} if i % 2 else {})}, "geometry": geometry, **more}


FEATURES = [feature(i, {"type": "Point", "coordinates": [i, i / 2]}) for i in range(10)]
FEATURES += [feature(10, None), feature(11, {"type": "Circle"}), feature(12, {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}, bbox=[0, 0, -9, 4, 4, 9]), feature(13, {"type": "Point", "coordinates": []})]
COLLECTION = {"type": "FeatureCollection", "name": "ünï", "crs": {"features": "no"}, "features": FEATURES, "after": [1, {"features": []}]}


def collection_bytes(**options):
    return json.dumps(COLLECTION, ensure_ascii=False, **options).encode()


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
@pytest.mark.parametrize("raw", [collection_bytes(), b"\xef\xbb\xbf" + collection_bytes(indent=2), b"\n".join(json.dumps(f).encode() for f in FEATURES)])
def test_features_are_read_incrementally(monkeypatch, piece, raw):
    monkeypatch.setattr(geojson, "PIECE", piece)
    assert list(geojson.features_of(io.BytesIO(raw))) == FEATURES


@pytest.mark.parametrize("raw", [collection_bytes()[:-40], b"[1]", b'{"type": "FeatureCollection", "features": [{"type"'])
def test_broken_collections_are_errors(raw):
    with pytest.raises(ValueError):
        list(geojson.features_of(io.BytesIO(raw)))


def test_geojson_round_trip(spark, tmp_path):
    plain, packed = tmp_path / "a.geojson", tmp_path / "b.JSON.gz"
    plain.write_bytes(collection_bytes())
    packed.write_bytes(gzip.compress(collection_bytes(indent=1)))
    assert files.format_of(str(plain)) == files.format_of(str(packed)) == "geojson" and files.format_of("x.parquet") == "geoparquet"
    rows = geojson.read(spark, [str(plain), str(packed)])
    assert rows.count() == 2 * len(FEATURES)
    assert rows.where(F.col("geometry").isNull()).count() == 4
    flat = geojson.flatten(rows.where(F.col("path") == str(plain)), keep=["ordinal"]).orderBy("ordinal")
    assert flat.columns == ["ordinal", "extra", "id", "name", "geometry", "bbox"]
    assert flat.collect()[12].bbox.asDict() == {"xmin": 0, "ymin": 0, "xmax": 4, "ymax": 4}
    keys = stats.property_keys(rows, "properties", ["path", "ordinal"]).collect()
    assert [r.key for r in keys] == ["id", "name", "extra"]
    kept = geojson.slice_box(rows.where(F.col("path") == str(plain)), (2, 0, 3.5, 9))
    assert kept.count() == 3
    folder, out = str(tmp_path / "lines"), tmp_path / "out.geojson"
    geojson.write_lines("feature", kept, folder, "gzip")
    assert geojson.collect_collection(spark, folder, str(out), indent=2, name="ünï") == 3
    assert len(list(geojson.features_of(io.BytesIO(out.read_bytes())))) == 3 and "ünï" in out.read_text()
    lines = geojson.read_lines(spark, folder)
    assert lines.count() == 3
    text = flat.select(geojson.feature_json(["id", "name"], geometry.to_geojson(F.col("geometry"))).alias("f")).first().f
    assert json.loads(text)["geometry"] == {"type": "Point", "coordinates": [0.0, 0.0]}


@pytest.fixture
def points(spark):
    f = spark.range(2000).select("id", (F.sin("id") * 100).alias("x"), (F.cos(F.col("id") * 7) * 50).alias("y"), F.concat(F.lit("n"), "id").alias("name"))
    boxed = geometry.with_boxes(f.withColumn("geometry", geometry.point_wkb(F.col("x"), F.col("y"))))
    return boxed.cache()


def test_tiles_are_written_and_queried(spark, points, tmp_path):
    sides = np.array([(x, y, x + 50, y + 50) for y in (-50, 0) for x in (-100, -50, 0, 50)], float)
    tiles = tile_frame(spark, sides)
    assigned = assign.assign_disjoint(points, tiles)
    folder = str(tmp_path / "tiles")
    written = geoparquet.write_tiles(assigned, folder, bbox="bbox", row_group_rows=100).collect()
    assert len(written) == 8 and sum(r.rows for r in written) == assigned.where(F.col("tile_id").isNotNull()).count()
    found = files.find_files(spark, [folder])
    assert len(found) == 8
    assert validate.validate(spark, found, check_data=True).collect() == []
    one = written[0]
    geo = files.read_geo(one.path)
    assert geo["columns"]["geometry"]["geometry_types"] == ["Point"] and geo["columns"]["geometry"]["bbox"] == [one.xmin, one.ymin, one.xmax, one.ymax]
    table = pq.read_table(one.path)
    assert pq.ParquetFile(one.path).metadata.num_row_groups == -(-one.rows // 100)
    real = [wkb.bounds(wkb.from_wkb(g)) for g in table["geometry"].to_pylist()]
    assert min(b[0] for b in real) == one.xmin
    feet = files.footers(spark, found)
    assert feet.agg(F.sum("rows")).first()[0] == sum(r.rows for r in written)
    data = geoparquet.read(spark, found).withColumn("path", F.col("_metadata.file_path"))
    compared = validate.compare_bounds(feet, data).collect()
    assert len(compared) == 8 and all(r.largest == 0 for r in compared)
    assert files.column_sizes(spark, found).first().percent > 0
    region = (-20.0, -20.0, 30.0, 30.0)
    exact = regions.query_region(assigned, region, tiles)
    assert {r.id for r in exact.collect()} == {r.id for r in points.where("x > -20 and x < 30 and y > -20 and y < 30").collect()}
    plan = geoparquet.read(spark, found, ["id"], region)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan
    pruned = regions.query_region(assigned, "POLYGON ((0 0, 60 0, 60 30, 0 0))", tiles, columns=["id"])
    assert pruned.columns == ["id", "geometry"]


def test_clustered_files_and_catalog(spark, points, tmp_path):
    folder = str(tmp_path / "sorted")
    written = geoparquet.write_clustered(points, folder, partitions=3, row_group_rows=200).collect()
    assert sum(r.rows for r in written) == 2000 and len(written) == 3
    keys = [pq.read_table(r.path)["hkey24"].to_pylist() for r in sorted(written, key=lambda r: r.path)]
    assert all(k == sorted(k) for k in keys)
    assert files.read_geo(written[0].path)["columns"]["geometry"]["covering"]["bbox"]["xmax"] == ["bbox", "xmax"]
    tiles = tile_frame(spark, np.array([(-100, -50, 0, 50), (0, -50, 100, 50)], float))
    summary = stats.summary(assign.assign_disjoint(points, tiles), ["tile_id"], "x", "y", "geometry")
    table = catalog.catalog(tiles, summary)
    catalog.write_catalog(table, str(tmp_path / "catalog"))
    again = catalog.read_catalog(spark, str(tmp_path / "catalog"))
    assert [tuple(r.box) for r in again.orderBy("tile_id").collect()] == [(-100, -50, 0, 50), (0, -50, 100, 50)]
    assert catalog.missing_statistics(table).count() == 0 and catalog.missing_statistics(catalog.catalog(tiles)).count() == 2
    (tmp_path / "legacy.csv").write_text("id,minx,miny,maxx,maxy\n7,0,0,1,1\n8,1,1,2,2\n7,0,0,3,3\n")
    old = {r.tile_id: tuple(r.box) for r in catalog.read_legacy(spark, str(tmp_path / "legacy.csv")).collect()}
    assert old == {"7": (0, 0, 3, 3), "8": (1, 1, 2, 2)}
    with pytest.raises(ValueError, match="missing"):
        catalog.read_catalog(spark, str(tmp_path / "legacy.csv"))


def test_validator_findings(tmp_path):
    def found(geo, values=(b"",), data=False, name="geometry"):
        table = pa.table({name: pa.array(list(values), pa.binary())})
        if geo is not None:
            table = table.replace_schema_metadata({"geo": geo if isinstance(geo, str) else json.dumps(geo)})
        pq.write_table(table, tmp_path / "f.parquet")
        return [c for c, _ in validate.check_file(str(tmp_path / "f.parquet"), data)]

    own = lambda **k: {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"]} | k}}
    (tmp_path / "text.parquet").write_text("no")
    assert [c for c, _ in validate.check_file(str(tmp_path / "text.parquet"))] == ["V1"]
    assert found(None) == ["V2"] and found("{") == ["V3"] and found("[]") == ["V3"]
    assert found(own()) == []
    assert found({"version": 1}) == ["V4", "V6"]
    assert found(own(encoding="WKT")) == ["V5"] and found(own(geometry_types=["Point", "Point"])) == ["V10"]
    assert found(own(), name="other") == ["V7"] and found(own(crs=5)) == ["V8"]
    assert found(own(bbox=[1, 2, 3])) == ["V9"] and found(own(bbox=[0, 5, 1, 4])) == ["V9"] and found(own(bbox=[170, 0, -170, 1])) == []
    assert found(own(bbox=[-200, 0, 1, 1])) == ["V9"]
    assert found(own(encoding="polygon", geometry_types=["Polygon"])) == ["V12"]
    wrong = wkb.to_wkb(wkb.from_wkt("POLYGON ((0 0, 0 1, 1 1, 0 0))"))
    assert found(own(geometry_types=["Polygon"], orientation="counterclockwise"), [wrong, None], True) == ["V11"]
    assert found(own(), [wrong, b"x"], True) == ["V11", "V11"]


def test_column_discovery():
    assert stats.find_column(["Lon", "x2"], stats.X_NAMES) == "Lon" and stats.find_column(["X", "lon"], stats.X_NAMES) == "X"
    assert stats.find_column(["a"], stats.X_NAMES) is None
    assert files.geometry_column(["geom", "a"], {"primary_column": "a"}) == "a" and files.geometry_column(["geom"]) == "geom"
    with pytest.raises(ValueError):
        files.geometry_column(["a"])
    for text in ("1,2,3", "3,0,1,1", "a,b,c,d"):
        with pytest.raises(ValueError):
            regions.parse_box(text)


def test_stream_against_tiles(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 10).cast("double").alias("cx"), F.lit(0.5).alias("cy")).write.parquet(str(tmp_path / "in"))
    tiles = tile_frame(spark, np.array([(0, 0, 5, 1), (5, 0, 9, 1)], float))
    stream = spark.readStream.schema("id long, cx double, cy double").parquet(str(tmp_path / "in"))
    q = assign_stream(stream, tiles).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    got = {r.tile_id: r.n for r in spark.sql("select tile_id, count(*) n from assigned group by 1").collect()}
    assert got == {"tile_000000": 50, "tile_000001": 40, None: 10}


def test_region_from_files(spark, points, tmp_path):
    square = lambda x: {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]}
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in (("a", square(0)), ("b", square(5)), ("b", square(7)), ("c", None))]}))
    whole = regions.region_from_file(spark, str(tmp_path / "r.geojson"))
    assert whole.kind == "MultiPolygon" and wkb.bounds(whole) == (0, 0, 8, 1)
    part = regions.region_from_file(spark, str(tmp_path / "r.geojson"), "name", "b")
    assert wkb.bounds(part) == (5, 0, 8, 1) and len(part.data) == 2
    for value in ("c", "z"):
        with pytest.raises(ValueError, match="no region"):
            regions.region_from_file(spark, str(tmp_path / "r.geojson"), "name", value)
    metres = wkb.mapped(wkb.rectangle(1, 2, 3, 4), wkb.metres_of)
    spark.createDataFrame([(bytearray(wkb.to_wkb(metres)),)], "geometry binary").write.parquet(str(tmp_path / "m.parquet"))
    back = regions.region_from_file(spark, str(tmp_path / "m.parquet"), mercator=True)
    assert wkb.bounds(back) == pytest.approx((1, 2, 3, 4))
    spots = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0.5, 3, 5.5, 7.5, 8))], "id long, x double").withColumn("geometry", geometry.point_wkb(F.col("x"), F.lit(0.5)))
    assert [r.id for r in regions.query_region(spots, part, bbox=None).orderBy("id").collect()] == [2, 3]


def test_data_source_takes_box_filters_over(spark, tmp_path):
    from quadrille.sources import datasource

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_bytes(collection_bytes())
    (tmp_path / "in" / "b.geojson").write_bytes(collection_bytes(indent=1))
    plain = geojson.read(spark, files.find_files(spark, [str(tmp_path / "in")], ".geojson"))
    key = lambda df: sorted((r.path.removeprefix("file:"), r.ordinal, r.feature, r.geometry, r.bbox) for r in df.collect())
    assert key(datasource.load(spark, [str(tmp_path / "in")])) == key(plain)
    inside = (F.col("bbox.xmin") >= 2) & (F.col("bbox.xmax") < 6.5) & (F.col("ordinal") != 3)
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        got = datasource.load(spark, [str(tmp_path / "in")]).where(inside)
        assert key(got) == key(plain.where(inside)) and got.count() == 8
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = datasource.FilteringReader([], "xy")
    rest = list(reader.pushFilters([datasource.GreaterThan(("bbox", "xmin"), 2), datasource.LessThan(("ordinal",), 2), datasource.GreaterThan(("bbox", "name"), 2)]))
    assert len(rest) == 2 and reader.tests == [(0, datasource.GreaterThan, 2.0)]
    with pytest.raises(ValueError, match="no files"):
        datasource.load(spark, [str(tmp_path / "none")])


def test_footer_crs_and_axes(spark, tmp_path):
    for name, crs in (("a", None), ("b", {"id": {"authority": "EPSG", "code": 3857}})):
        own = {"encoding": "WKB", "geometry_types": []} | ({"crs": crs} if crs else {})
        table = pa.table({"geometry": pa.array([], pa.binary())}).replace_schema_metadata({"geo": json.dumps({"primary_column": "geometry", "columns": {"geometry": own}})})
        pq.write_table(table, tmp_path / f"{name}.parquet")
    assert geoparquet.footer_crs(str(tmp_path / "a.parquet")) == "EPSG:4326"
    assert geoparquet.footer_crs(str(tmp_path / "b.parquet"))["id"]["code"] == 3857
    assert tuple(spark.range(1).select(boxes.swap_axes(boxes.literal_box(1, 2, 3, 4)).alias("b")).first().b) == (2, 1, 4, 3)


def test_reference_systems():
    base = {"type": "GeographicCRS", "name": "WGS 84", "datum": {}}
    for good in (None, "EPSG:4326", "OGC:CRS84", 'GEOGCS["WGS 84"]', base, base | {"type": "GeodeticCRS"}, {"id": {"authority": "EPSG", "code": 4326}}, {"type": "ProjectedCRS", "name": "x", "base_crs": base, "conversion": {}}, {"type": "GeographicCRS", "name": "x", "datum_ensemble": {}}):
        assert validate.crs_problem(good) is None, good
    for bad in (5, "", "WGS 84", 'GEOGCS["x"', {}, {"type": "Planet"}, {"type": "GeographicCRS"}, {"id": {"code": 1}}, {"type": "ProjectedCRS", "name": "x", "base_crs": {"type": "no"}, "conversion": {}}):
        assert validate.crs_problem(bad), bad


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": "integer", "minimum": 1, "exclusiveMaximum": 4}, [1, 3, 2.0], [0, 4, 1.5, "1", True, None]),
        ({"type": ["string", "null"], "pattern": "^a", "minLength": 2}, ["ab", None], ["b", "a", 1]),
        ({"enum": [1, "x"]}, [1, "x"], [2]),
        ({"const": {"a": 1}}, [{"a": 1}], [{}]),
        ({"type": "array", "items": {"type": "number"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, 2]], [[], [1, 2, 3], ["a"], [1, 1]]),
        ({"items": [{"type": "string"}, {"type": "number"}]}, [["a", 1], []], [[1]]),
        ({"required": ["a"], "properties": {"a": {"type": "string"}}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": False, "minProperties": 1}, [{"a": "b", "x1": 2}], [{}, {"a": 1}, {"a": "b", "c": 1}, {"a": "b", "x": "y"}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [4]),
        ({"oneOf": [{"minimum": 5}, {"maximum": 7}]}, [4, 8], [6]),
        ({"allOf": [{"minimum": 5}], "not": {"const": 6}}, [5, 7], [4, 6]),
        ({"$ref": "#/definitions/n", "definitions": {"n": {"type": "number"}}}, [1], ["a"]),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 3}}, ["ab", 3], ["a", 2]),
        (False, [], [1]),
        (True, [1], []),
    ],
)
def test_json_schemas(schema, good, bad):
    for value in good:
        assert validate.check_schema(value, schema) == [], value
    for value in bad:
        assert validate.check_schema(value, schema), value


def test_findings_are_not_cut_off(spark, tmp_path):
    geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon"]}}}
    table = pa.table({"geometry": pa.array([wkb.to_wkb(wkb.point(1, 2))] * 2500, pa.binary())}).replace_schema_metadata({"geo": json.dumps(geo)})
    pq.write_table(table, tmp_path / "f.parquet")
    found = validate.validate(spark, [str(tmp_path / "f.parquet")], True, {"required": ["odd"]})
    assert {r.check: r.n for r in found.groupBy("check").agg(F.count("*").alias("n")).collect()} == {"V11": 2500, "V5": 1}


def test_large_tiles_are_dealt_to_several_files(spark, points, tmp_path):
    tiles = tile_frame(spark, np.array([(-100, -50, 90, 50), (90, -50, 100, 50)], float))
    assigned = assign.assign_disjoint(points, tiles)
    written = geoparquet.write_tiles(assigned, str(tmp_path / "t"), most_rows=300).collect()
    want = {r.tile_id: r.n for r in assigned.where("tile_id is not null").groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in written:
        assert r.rows <= 450 and r.path.split("/")[-1].startswith(r.tile_id)
        got[r.tile_id] = got.get(r.tile_id, 0) + r.rows
    assert got == want and len(written) == sum(-(-n // 300) for n in want.values())
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == sum(want.values()) and sorted(back.columns) == sorted(c for c in assigned.columns if c != "tile_id")
