"""GeoParquet: reading with column and box pushdown, and writing with the `geo` footer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.curves import hilbert, morton, to_extent_grid
from quadrille.geometry.batch import Batch
from quadrille.geometry.columns import with_boxes
from quadrille.operators.ordering import cluster, order_by, sort_keys, sort_mode
from quadrille.operators.regions import bbox_filter
from quadrille.sources.files import geo_metadata, open_fs, read_geo

#: Tiles whose sizes are broadcast (some 50 bytes each), and rows of a tile that one task writes.
BROADCAST_TILES, MOST_TILE_ROWS = 50_000, 5_000_000
WRITTEN = "path string, tile_id string, rows long, bytes long, xmin double, ymin double, xmax double, ymax double"


def read(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, region: tuple[float, float, float, float] | None = None, bbox: str = "bbox", geometry: str = "geometry") -> DataFrame:
    """Features of files or folders (S1 to S5); a region is compared with the covering boxes in the scan.

    The region's answer is by boxes alone. The geometry is always among the columns.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if region is not None:
        df = bbox_filter(df, region, bbox)
    return df.select(*dict.fromkeys([*columns, geometry])) if columns else df


def write_files(df: DataFrame, folder: str, geometry: str = "geometry", tile: str | None = None, bbox: str | None = None, row_group_rows: int = 100_000, compression: str = "zstd", base: dict[str, Any] | None = None, crs: Any = None, names: str = "{tile}.parquet") -> DataFrame:
    """Writes a GeoParquet file for each run of one tile in a partition; returns WRITTEN, evaluated when it is used.

    df is expected to hold each tile in one partition, in order. Files are written under
    the attempt's name and renamed when complete; errors fail the job. Rows are held for
    one row group only; bounds and types are gathered while writing.
    """
    fields = [c for c in df.columns if c != tile]
    source = df.select(*([tile] if tile else []), *fields)
    at = fields.index(geometry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base_path = open_fs(folder)
        where.create_dir(base_path, recursive=True)
        task = TaskContext.get()
        done: list[dict] = []
        state: dict[str, Any] = {}

        def start(name: str, schema: pa.Schema) -> None:
            own = f"{base_path}/.{uuid.uuid4().hex}"
            out = where.open_output_stream(own)
            state.update(name=name, own=own, out=out, writer=pq.ParquetWriter(out, schema, compression=compression, version="2.6"), held=[], count=0, rows=0, kinds=set(), box=None)

        def flush(all_rows: bool) -> None:
            while state["count"] >= (1 if all_rows else row_group_rows):
                table = pa.Table.from_batches(state["held"])
                state["writer"].write_table(table.slice(0, row_group_rows), row_group_size=row_group_rows)
                rest = table.slice(row_group_rows)
                state["held"], state["count"] = rest.to_batches(), rest.num_rows

        def finish() -> None:
            flush(True)
            box = state["box"]
            geo = geo_metadata(geometry, list(state["kinds"]), box, bbox, crs, base)
            state["writer"].add_key_value_metadata({"geo": json.dumps(geo)})
            state["writer"].close()
            size = state["out"].tell() if not state["out"].closed else where.get_file_info(state["own"]).size
            state["out"].close()
            final = f"{base_path}/{state['file']}"
            if where.get_file_info(final).is_file:
                where.delete_file(final)
            where.move(state["own"], final)
            sides = box or [None] * 4
            done.append({"path": final, "tile_id": state["name"] if tile else None, "rows": state["rows"], "bytes": size} | dict(zip(("xmin", "ymin", "xmax", "ymax"), sides)))
            state.clear()

        for batch in batches:
            payload = pa.RecordBatch.from_arrays(batch.columns[1:] if tile else batch.columns, names=fields)
            keys = batch.column(0).dictionary_encode() if tile else None
            codes = keys.indices.fill_null(-1).to_numpy() if tile else np.zeros(batch.num_rows, np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)).tolist() if len(codes) else []
            for first, last in zip(cuts, cuts[1:]):
                key = "" if not tile else keys.dictionary[int(codes[first])].as_py() if codes[first] >= 0 else None
                if state and state["name"] != str(key):
                    finish()
                if not state:
                    start(str(key), payload.schema)
                    state["file"] = names.format(tile=key, part=f"{task.partitionId():05d}")
                part = payload.slice(first, last - first)
                shapes = Batch(part.column(at).to_pylist(), strict=True)
                state["kinds"].update(x for x in set(shapes.type_names().tolist()) if x is not None)
                sides = shapes.bounds()
                sides = sides[~np.isnan(sides[:, 0])]
                if len(sides):
                    own = [*sides[:, :2].min(axis=0).tolist(), *sides[:, 2:].max(axis=0).tolist()]
                    old = state["box"] or own
                    state["box"] = [min(old[0], own[0]), min(old[1], own[1]), max(old[2], own[2]), max(old[3], own[3])]
                state["held"].append(part)
                state["count"] += part.num_rows
                state["rows"] += part.num_rows
                flush(False)
        if state:
            finish()
        kinds = [("path", pa.string()), ("tile_id", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())] + [(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")]
        yield pa.RecordBatch.from_pylist(done, pa.schema(kinds))

    return source.mapInArrow(run, WRITTEN)


def tile_sizes(rows: DataFrame, tile: str, x: str, y: str) -> DataFrame:
    """(tile, _rows, _x0, _y0, _x1, _y1): one aggregation; as a broadcast table if there are few tiles."""
    own = rows.groupBy(tile).agg(F.count("*").alias("_rows"), F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.max(x).alias("_x1"), F.max(y).alias("_y1"))
    found = own.limit(BROADCAST_TILES + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(found, own.schema)) if len(found) <= BROADCAST_TILES else own


def write_tiles(
    df: DataFrame, folder: str, tile: str = "tile_id", geometry: str = "geometry", mode: str = "hilbert", keys: str | None = None, bits: int = 16, x: str = "cx", y: str = "cy", most_rows: int = MOST_TILE_ROWS, **options
) -> DataFrame:
    """One file for each tile, sorted within (K1, K3, O1, O2): a single shuffle by tile, one open file for each task.

    A tile of more than `most_rows` rows is dealt to several tasks, which write `<tile>.parquet`,
    `<tile>-part1.parquet` and so on. Rows without a tile are left out; count them with
    operators.assign.skipped. The curve key is computed on the tile's own extent.
    """
    rows = df.where(F.col(tile).isNotNull())
    mode = sort_mode(mode)
    rows = rows.join(tile_sizes(rows, tile, x, y), tile)
    if mode in ("zorder", "hilbert"):
        cx, cy = to_extent_grid(F.col(x), F.col("_x0"), F.col("_x1"), bits), to_extent_grid(F.col(y), F.col("_y0"), F.col("_y1"), bits)
        rows = rows.withColumns({"_cx": cx, "_cy": cy}).withColumn("_key", hilbert(F.col("_cx"), F.col("_cy"), bits) if mode == "hilbert" else morton(F.col("_cx"), F.col("_cy")))
        order = [F.col("_key").asc_nulls_last(), F.col(x), F.col(y)]
    else:
        order = order_by(sort_keys(keys)) if mode == "columns" else []
    part = F.pmod(F.xxhash64(x, y, geometry), F.ceil(F.col("_rows") / F.lit(most_rows)))
    rows = rows.withColumn("_file", F.concat(F.col(tile).cast("string"), F.when(part > 0, F.concat(F.lit("-part"), part.cast("string"))).otherwise("")))
    dealt = rows.repartition("_file").sortWithinPartitions("_file", *order).select("_file", *[c for c in df.columns if c != tile])
    return write_files(dealt, folder, geometry, "_file", **options).withColumn("tile_id", F.regexp_replace("tile_id", r"-part\d+$", ""))


def write_clustered(df: DataFrame, folder: str, geometry: str = "geometry", curve: str = "hilbert", bits: int = 24, partitions: int | None = None, row_group_rows: int = 100_000, **options) -> DataFrame:
    """Features with a covering box, ranged and sorted by a world curve key, in row groups of a given size."""
    boxed = df if {"bbox", "cx", "cy"} <= set(df.columns) else with_boxes(df, geometry)
    ranged = cluster(boxed, "cx", "cy", curve, bits, partitions=partitions)
    return write_files(ranged.drop("cx", "cy"), folder, geometry, bbox="bbox", row_group_rows=row_group_rows, names="part-{part}.parquet", **options)


def footer_crs(path: str) -> Any:
    """The reference system that a file's footer names, `EPSG:4326` by default."""
    geo = read_geo(path) or {}
    return geo.get("columns", {}).get(geo.get("primary_column"), {}).get("crs") or "EPSG:4326"
