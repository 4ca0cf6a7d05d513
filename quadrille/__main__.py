"""Commands: python -m quadrille tile | partition | split | catalog | query | convert | slice | validate | count."""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import validate as checks
from quadrille.geometry.columns import to_geojson, with_boxes
from quadrille.operators import assign, regions, stats
from quadrille.operators.tiles import partition
from quadrille.sources import catalog, files, geojson, geoparquet


def load(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Features of either format, with box and centroid."""
    if files.format_of(path) == "geojson":
        df = geojson.flatten(geojson.read(spark, [path])).drop("bbox")
    else:
        df = spark.read.parquet(path)
    return with_boxes(df.withColumn("_key", F.monotonically_increasing_id()), geometry)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadrille")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for n in names:
            own.add_argument(n)
        own.add_argument("--geometry", default="geometry")
        return own

    own = command("tile", "input", "outdir")
    own.add_argument("--index"), own.add_argument("--num-tiles", type=int), own.add_argument("--mode", choices=("contains", "intersects", "disjoint", "covering"), default="contains")
    own.add_argument("--compression", default="zstd"), own.add_argument("--sort-mode", default="zorder"), own.add_argument("--sort-keys"), own.add_argument("--sfc-bits", type=int, default=16)
    own.add_argument("--seed", type=int, default=42), own.add_argument("--sample-ratio", type=float, default=1.0), own.add_argument("--sample-cap", type=int, default=100_000), own.add_argument("--row-group-rows", type=int, default=100_000)
    own = command("partition", "input", "out")
    own.add_argument("--num-partitions", type=int, default=40), own.add_argument("--sample-pct", type=float, default=100.0), own.add_argument("--coverage", choices=("tight", "filling"), default="tight")
    own = command("catalog", "index", "tiles", "out")
    own.add_argument("--strict", action="store_true")
    own = command("query", "input", "out")
    own.add_argument("--region"), own.add_argument("--region-file"), own.add_argument("--field"), own.add_argument("--value"), own.add_argument("--columns"), own.add_argument("--any-geometry", action="store_true"), own.add_argument("--index")
    own = command("convert", "input", "out")
    own.add_argument("--order", choices=("z", "hilbert"), default="hilbert"), own.add_argument("--bits", type=int, default=24), own.add_argument("--row-group-size", type=int, default=100_000), own.add_argument("--keep"), own.add_argument("--to", choices=("geoparquet", "geojson"), default="geoparquet")
    own = command("slice", "input", "out")
    own.add_argument("--bbox", required=True), own.add_argument("--indent", type=int), own.add_argument("--coord-order", choices=("xy", "yx"), default="xy"), own.add_argument("--name")
    own = command("validate", "input")
    own.add_argument("--check-data", action="store_true"), own.add_argument("--schema")
    command("count", "input")
    return top


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    try:
        return catalog.read_catalog(spark, path)
    except ValueError:
        return catalog.read_legacy(spark, path)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "tile":
        df = load(spark, args.input, args.geometry)
        tiles = read_tiles(spark, args.index) if args.index else partition(df, args.num_tiles or 40, "_key", rows=args.sample_cap, fraction=args.sample_ratio, seed=args.seed)
        modes = {"contains": assign.assign_contains, "disjoint": assign.assign_disjoint, "covering": assign.assign_covering}
        assigned = assign.assign_smallest_intersecting(df, tiles, "_key") if args.mode == "intersects" else modes[args.mode](df, tiles)
        written = geoparquet.write_tiles(assigned.drop("_key"), args.outdir, mode=args.sort_mode, keys=args.sort_keys, bits=args.sfc_bits, geometry=args.geometry, compression=args.compression, bbox="bbox", row_group_rows=args.row_group_rows)
        rows = written.agg(F.count("*"), F.sum("rows")).first()
        print(f"{rows[0]} tiles, {rows[1] or 0} rows written, {df.count()} read")
    elif args.command == "partition":
        df = load(spark, args.input, args.geometry)
        catalog.write_catalog(catalog.catalog(partition(df, args.num_partitions, "_key", fraction=args.sample_pct / 100, cells=args.coverage == "filling")), args.out)
    elif args.command == "catalog":
        found = spark.read.parquet(args.tiles).withColumn("tile_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:-part\d+)?\.", 1)).withColumn("_size", F.col("_metadata.file_size"))
        table = catalog.catalog(read_tiles(spark, args.index), stats.summary(found, ["tile_id"], geometry=args.geometry, size=F.col("_size")))
        catalog.write_catalog(table, args.out)
        if args.strict and catalog.missing_statistics(table).limit(1).count():
            return 3
    elif args.command == "query":
        df = load(spark, args.input, args.geometry) if files.format_of(args.input) == "geojson" else spark.read.parquet(args.input)
        tiles = read_tiles(spark, args.index) if args.index else None
        if tiles is not None and "tile_id" not in df.columns:
            df = df.withColumn("tile_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:-part\d+)?\.", 1))
        if not args.region and not args.region_file:
            raise ValueError("a region or a region file is needed")
        region = args.region or regions.region_from_file(spark, args.region_file, args.field, args.value)
        out = regions.query_region(df, region, tiles, args.geometry, points_only=not args.any_geometry, columns=args.columns.split(",") if args.columns else None)
        print(f"{geoparquet.write_files(out, args.out, args.geometry, names='part-{part}.parquet').agg(F.sum('rows')).first()[0] or 0} rows")
    elif args.command == "convert":
        df = load(spark, args.input, args.geometry).drop("_key")
        if args.keep:
            df = df.select(*dict.fromkeys([*args.keep.split(","), args.geometry, "bbox", "cx", "cy"]))
        if args.to == "geojson":
            names = [c for c in df.columns if c not in (args.geometry, "bbox", "cx", "cy")]
            geojson.write_lines(geojson.feature_json(names, to_geojson(F.col(args.geometry))), df, args.out)
        else:
            geoparquet.write_clustered(df, args.out, args.geometry, args.order, args.bits, row_group_rows=args.row_group_size).count()
    elif args.command == "slice":
        kept = geojson.slice_box(geojson.read(spark, [args.input], args.coord_order), regions.parse_box(args.bbox))
        geojson.write_lines("feature", kept, f"{args.out}.lines")
        print(f"{geojson.collect_collection(spark, f'{args.out}.lines', args.out, args.indent, args.name)} features")
    elif args.command == "validate":
        schema = json.loads(pathlib.Path(args.schema).read_text()) if args.schema else None
        count = 0
        for row in checks.validate(spark, files.find_files(spark, [args.input]), args.check_data, schema).toLocalIterator():
            print(f"{row.path}: {row.check}: {row.message}")
            count += 1
        return int(bool(count))
    elif args.command == "count":
        print(files.footers(spark, files.find_files(spark, [args.input])).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
