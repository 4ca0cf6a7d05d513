"""Files: discovery, formats, footers and the `geo` key of GeoParquet."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which a geometry column is looked for after the footer's.
GEOMETRY_COLUMNS = ("geometry", "wkb_geometry", "geom", "GEOMETRY")
FOOTERS = "path string, rows long, row_groups int, bytes long, geo string, columns array<string>"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def format_of(path: str) -> str:
    """`geojson` for .geojson and .json in any case, also gzipped, else `geoparquet`."""
    name = path.lower().removesuffix(".gz")
    return "geojson" if name.endswith((".geojson", ".json")) else "geoparquet"


def find_files(spark: SparkSession, paths: list[str], suffix: str = ".parquet") -> list[str]:
    """Files of folders, patterns and names, sorted, without repetition."""
    found: set[str] = set()
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(conf)
        for status in system.globStatus(place) or []:
            if status.isDirectory():
                walk = system.listFiles(status.getPath(), True)
                while walk.hasNext():
                    name = walk.next().getPath()
                    if name.getName().endswith(suffix) and not name.getName().startswith(("_", ".")):
                        found.add(name.toString())
            else:
                found.add(status.getPath().toString())
    return sorted(found)


def footers(spark: SparkSession, files: list[str], parallel: int | None = None) -> DataFrame:
    """FOOTERS of Parquet files, read by the executors without their data (S16, A5); unreadable files have null rows."""
    schema = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("row_groups", pa.int32()), ("bytes", pa.int64()), ("geo", pa.string()), ("columns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                where, name = open_fs(path)
                try:
                    with where.open_input_file(name) as source:
                        meta = pq.ParquetFile(source).metadata
                        geo = (meta.metadata or {}).get(b"geo")
                        rows.append({"path": path, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "bytes": source.size(), "geo": geo.decode("utf-8", "replace") if geo else None, "columns": meta.schema.to_arrow_schema().names})
                except (OSError, pa.ArrowInvalid):
                    rows.append({"path": path})
            yield pa.RecordBatch.from_pylist(rows, schema)

    count = max(1, parallel or min(len(files), 1000))
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(count).mapInArrow(run, FOOTERS)


def column_sizes(spark: SparkSession, files: list[str], top: int = 12) -> DataFrame:
    """(column, bytes, percent): compressed bytes of the largest columns over all files."""
    schema = pa.schema([("column", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = open_fs(path)
                with where.open_input_file(name) as source:
                    meta = pq.ParquetFile(source).metadata
                    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                    rows = [{"column": g.column(c).path_in_schema.split(".")[0], "bytes": g.column(c).total_compressed_size} for g in groups for c in range(g.num_columns)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    sizes = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 1000))).mapInArrow(run, "column string, bytes long").groupBy("column").agg(F.sum("bytes").alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("_all")).withColumn("_one", F.lit(1))
    joined = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.select("column", "bytes", F.try_divide(F.col("bytes") * 100.0, F.col("_all")).alias("percent")).orderBy(F.desc("bytes"), "column").limit(top)


def read_geo(path: str) -> dict[str, Any] | None:
    """The `geo` key of one file, null without."""
    where, name = open_fs(path)
    with where.open_input_file(name) as source:
        raw = (pq.ParquetFile(source).metadata.metadata or {}).get(b"geo")
    return json.loads(raw) if raw else None


def geometry_column(columns: list[str], geo: dict[str, Any] | None = None, wanted: str | None = None) -> str:
    """The geometry column: as asked for, as the footer says, or by its usual names."""
    for name in [wanted, (geo or {}).get("primary_column"), *GEOMETRY_COLUMNS]:
        if name and name in columns:
            return name
    raise ValueError(f"no geometry column among {columns}")


def geo_metadata(column: str, kinds: list[str], bbox: list[float] | None, covering: str | None = None, crs: Any = None, base: dict[str, Any] | None = None) -> dict[str, Any]:
    """The `geo` key of a file: what the input's key held, with this file's own types and bounds.

    Bounds are left out where there are none, since they would not be JSON.
    """
    out = json.loads(json.dumps(base or {}))
    out["version"], out["primary_column"] = "1.1.0", column
    own = out.setdefault("columns", {}).setdefault(column, {})
    own |= {"encoding": "WKB", "geometry_types": sorted(set(kinds))}
    own.pop("bbox", None)
    if bbox:
        own["bbox"] = [float(v) for v in bbox]
    if crs is not None:
        own["crs"] = crs
    if covering:
        own["covering"] = {"bbox": {k: [covering, k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    out.pop("bbox", None)
    return out
