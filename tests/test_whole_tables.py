"""Queries run their operators on every feature and give what their SQL gives."""

import duckdb
import pytest

from quadrille.operators.tiles import SAMPLE_ROWS
from quadrille.plans.catalogue import oracle_sql, queries

ROWS = 2000
NAMES = ("region_intersects", "null_geometry_last", "wkb_measures", "text_round_trip", "sort_columns", "geojson_round_trip")


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    spark.range(1, ROWS + 1).withColumnRenamed("id", "o_orderkey").write.parquet(str(folder / "orders.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_every_feature_is_run_and_equals_sql(spark, orders, name):
    got = queries()[name](spark, orders)
    with duckdb.connect() as db:
        db.execute(f"create view orders as select * from '{orders}/orders.parquet/*.parquet'")
        found = db.execute(oracle_sql()[name])
        assert [c[0] for c in found.description] == got.columns
        want = sorted(found.fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) == ROWS or name == "region_intersects"
    assert any(r[0] % 10 for r in want)


def test_tiles_are_checked_on_more_points_than_a_sample_holds(spark, tmp_path):
    """Among the rows two without a key, and places that many share."""
    keys = spark.range(SAMPLE_ROWS + 30_000).selectExpr("case when id > 1 then (id % 120000) * 117000 + id % 5000 end as o_orderkey")
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    got = queries()["partition_tiles_checked"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        found = db.execute(oracle_sql()["partition_tiles_checked"])
        assert [c[0] for c in found.description] == got.columns
        assert list(map(tuple, got.collect())) == found.fetchall() == [(130_000, 5417, True, True, 0)]
