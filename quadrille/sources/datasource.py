"""GeoJSON as a data source of the session: spark.read.format("quadrille_geojson").load(path).

Every file is one partition, streamed in batches. Comparisons of the box's sides with
numbers are taken over from the plan where the session allows it
(spark.sql.python.filterPushdown.enabled), so that features outside are dropped before
their geometry is built.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from quadrille.geometry import wkb
from quadrille.sources import geojson
from quadrille.sources.files import find_files, open_fs

NAME = "quadrille_geojson"
SIDES = ("xmin", "ymin", "xmax", "ymax")
COMPARISONS = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GeoJsonReader(DataSourceReader):
    def __init__(self, paths: list[str], order: str):
        self.paths, self.order = paths, order
        self.tests: list[tuple[int, type, float]] = []

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        where, name = open_fs(partition.path)
        rows: list[dict] = []
        with where.open_input_stream(name, compression="detect") as stream:
            for i, f in enumerate(geojson.features_of(stream)):
                if self.tests:
                    box = wkb.json_bounds(f, self.order)
                    if box is None or not all(COMPARISONS[kind](box[side], value) for side, kind, value in self.tests):
                        continue
                rows.append(geojson.feature_row(partition.path, i, f, self.order))
                if len(rows) >= geojson.BATCH:
                    yield pa.RecordBatch.from_pylist(rows, geojson.KINDS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, geojson.KINDS)


class FilteringReader(GeoJsonReader):
    """A reader of its own, as sessions without filter pushdown refuse one that offers it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes over comparisons of a side with a number; the others go back to Spark."""
        for f in filters:
            place = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if type(f) in COMPARISONS and len(place) == 2 and place[0] == "bbox" and place[1] in SIDES and isinstance(value, (int, float)) and not isinstance(value, bool):
                self.tests.append((SIDES.index(place[1]), type(f), float(value)))
            else:
                yield f


class GeoJsonSource(DataSource):
    """Options: paths, one on a line; order of axes (xy or yx); pushdown, as the session has it."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return geojson.FEATURES

    def reader(self, schema) -> GeoJsonReader:
        if not self.options.get("paths"):
            raise ValueError("use datasource.load(), which lists the files")
        kind = FilteringReader if self.options.get("pushdown") == "true" else GeoJsonReader
        return kind(self.options["paths"].split("\n"), self.options.get("order", "xy"))


def load(spark: SparkSession, paths: list[str], suffix: str = ".geojson", order: str = "xy"):
    """Registers the source and reads files, folders or patterns; the driver's file system lists them."""
    spark.dataSource.register(GeoJsonSource)
    found = find_files(spark, paths, suffix)
    if not found:
        raise ValueError(f"no files at {paths}")
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("paths", "\n".join(found)).option("order", order).option("pushdown", pushdown).load()
