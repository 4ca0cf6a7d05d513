import json

from quadrille.__main__ import parser, run


def test_commands_from_geojson_to_query(spark, tmp_path, capsys):
    rows = [{"type": "Feature", "properties": {"id": i}, "geometry": {"type": "Point", "coordinates": [i % 20, i // 20]}} for i in range(400)]
    source = tmp_path / "in.geojson"
    source.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    go = lambda *a: run(spark, parser().parse_args([str(x) for x in a]))
    assert go("convert", source, tmp_path / "sorted", "--order", "z") == 0
    assert go("validate", tmp_path / "sorted", "--check-data") == 0
    assert go("count", tmp_path / "sorted") == 0
    assert capsys.readouterr().out.split()[-1] == "400"
    assert go("partition", tmp_path / "sorted", tmp_path / "index", "--num-partitions", 6, "--coverage", "tight") == 0
    assert go("tile", tmp_path / "sorted", tmp_path / "tiles", "--index", tmp_path / "index") == 0
    assert "400 rows written" in capsys.readouterr().out
    assert go("catalog", tmp_path / "index", tmp_path / "tiles", tmp_path / "filled", "--strict") == 0
    assert go("query", tmp_path / "tiles", tmp_path / "found", "--region", "4.5,4.5,9.5,9.5", "--index", tmp_path / "filled", "--columns", "id") == 0
    assert "25 rows" in capsys.readouterr().out
    assert go("slice", source, tmp_path / "cut.geojson", "--bbox", "0,0,1,1", "--indent", 1) == 0
    assert len(json.loads((tmp_path / "cut.geojson").read_text())["features"]) == 4
    assert go("convert", tmp_path / "sorted", tmp_path / "lines", "--to", "geojson", "--keep", "id") == 0
    assert spark.read.text(str(tmp_path / "lines")).count() == 400
