"""Checks of GeoParquet files, as a DataFrame of findings."""

from __future__ import annotations

import itertools
import json
import operator
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.geometry import wkb
from quadrille.sources.files import open_fs

FINDINGS = "path string, check string, message string"
# Kinds of PROJJSON objects with the parts they need, first words of well-known text, JSON types and bounds.
CRS_KINDS = ("GeodeticCRS", "GeographicCRS", "ProjectedCRS", "BoundCRS", "CompoundCRS", "DerivedGeodeticCRS", "DerivedGeographicCRS", "DerivedProjectedCRS", "EngineeringCRS", "VerticalCRS", "TemporalCRS", "ParametricCRS")
CRS_PARTS = {"GeographicCRS": ("datum",), "GeodeticCRS": ("datum",), "ProjectedCRS": ("base_crs", "conversion"), "CompoundCRS": ("components",)}
CRS_WORDS = ("GEOGCS", "PROJCS", "GEOGCRS", "PROJCRS", "GEODCRS", "COMPOUNDCRS", "COMPD_CS", "BOUNDCRS", "VERTCRS", "LOCAL_CS", "ENGCRS")
JSON_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}
JSON_BOUNDS = {"minimum": operator.ge, "maximum": operator.le, "exclusiveMinimum": operator.gt, "exclusiveMaximum": operator.lt}
# Encodings of the format, and the nesting of lists that each native one has.
NATIVE = {"point": 0, "linestring": 1, "multipoint": 1, "polygon": 2, "multilinestring": 2, "multipolygon": 3}


def check_metadata(geo: Any, schema: pa.Schema) -> list[tuple[str, str]]:
    """Findings on a parsed `geo` key, given the file's schema."""
    if not isinstance(geo, dict):
        return [("V3", "the geo key is not an object")]
    out: list[tuple[str, str]] = []
    if not isinstance(geo.get("version"), str):
        out.append(("V4", "version is missing or not text"))
    columns, primary = geo.get("columns"), geo.get("primary_column")
    if not isinstance(primary, str) or not isinstance(columns, dict) or not columns:
        return [*out, ("V6", "primary_column or columns is missing")]
    if primary not in columns:
        out.append(("V6", f"primary_column {primary!r} is not among columns"))
    for name, own in columns.items():
        if name not in schema.names:
            out.append(("V7", f"column {name!r} is not in the file"))
        if not isinstance(own, dict):
            out.append(("V5", f"column {name!r} is not an object"))
            continue
        encoding, kinds = own.get("encoding"), own.get("geometry_types")
        if encoding != "WKB" and encoding not in NATIVE:
            out.append(("V5", f"column {name!r}: unknown encoding {encoding!r}"))
        if not isinstance(kinds, list) or not all(isinstance(k, str) for k in kinds):
            out.append(("V5", f"column {name!r}: geometry_types is missing or not a list of text"))
        elif len(set(kinds)) != len(kinds):
            out.append(("V10", f"column {name!r}: geometry_types repeats a type"))
        elif any(k.split(" ")[0] not in wkb.NUMBERS for k in kinds):
            out.append(("V5", f"column {name!r}: unknown geometry type"))
        if own.get("orientation", "counterclockwise") != "counterclockwise":
            out.append(("V5", f"column {name!r}: unknown orientation"))
        if own.get("edges", "planar") not in ("planar", "spherical"):
            out.append(("V5", f"column {name!r}: unknown edges"))
        crs = own.get("crs")
        if problem := crs_problem(crs):
            out.append(("V8", f"column {name!r}: {problem}"))
        out += [("V9", f"column {name!r}: {m}") for m in check_bbox(own.get("bbox"), _geographic(crs))]
        if encoding in NATIVE and name in schema.names:
            depth, kind = 0, schema.field(name).type
            while pa.types.is_list(kind) or pa.types.is_large_list(kind):
                depth, kind = depth + 1, kind.value_type
            if depth != NATIVE[encoding]:
                out.append(("V12", f"column {name!r}: {encoding} does not have the column's nesting"))
            elif isinstance(kinds, list) and any(str(k).split(" ")[0].lower() != encoding for k in kinds):
                out.append(("V12", f"column {name!r}: geometry_types disagree with {encoding}"))
    return out


def crs_problem(crs: Any) -> str | None:
    """Why a reference system cannot be read (V8): PROJJSON, an authority's code, or well-known text."""
    if crs is None:
        return None
    if isinstance(crs, str):
        good = re.fullmatch(r"\s*[A-Za-z]+:[A-Za-z0-9_.-]+\s*", crs) or (re.match(rf"\s*({'|'.join(CRS_WORDS)})\s*\[", crs) and crs.count("[") == crs.count("]"))
        return None if good else "the reference system is neither a code nor well-known text"
    if not isinstance(crs, dict):
        return "the reference system is neither text nor an object"
    if "type" not in crs:
        own = crs.get("id")
        return None if isinstance(own, dict) and own.get("authority") and own.get("code") is not None else "the reference system has neither a type nor an id"
    if crs["type"] not in CRS_KINDS:
        return f"unknown kind of reference system {crs['type']!r}"
    missing = [k for k in ("name", *CRS_PARTS.get(crs["type"], ())) if k not in crs]
    if missing and not (missing == ["datum"] and "datum_ensemble" in crs):
        return f"the reference system lacks {', '.join(missing)}"
    parts = [crs[k] for k in ("base_crs", "source_crs") if isinstance(crs.get(k), dict)] + [c for c in crs.get("components", []) if isinstance(c, dict)]
    return next((p for p in map(crs_problem, parts) if p), None)


def check_schema(value: Any, schema: Any, root: Any = None, at: str = "geo") -> list[str]:
    """Where a value breaks a JSON schema (V5): types, enumerations, bounds, patterns, properties, items, combinations, local references."""
    root = schema if root is None else root
    if schema is True or not isinstance(schema, dict):
        return [f"{at} is not allowed"] if schema is False else []
    out: list[str] = []
    if "$ref" in schema:
        place = root
        for step in schema["$ref"].removeprefix("#").strip("/").split("/"):
            place = place[step.replace("~1", "/").replace("~0", "~")] if step else place
        out += check_schema(value, place, root, at)
    kinds = schema.get("type")
    if kinds is not None and not any(JSON_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{at} is not of type {kinds}"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at} has a value that is not listed")
    if JSON_TYPES["number"](value):
        out += [f"{at} is out of bounds"] * any(k in schema and not test(value, schema[k]) for k, test in JSON_BOUNDS.items())
    if isinstance(value, str):
        out += [f"{at} does not match {schema.get('pattern')}"] * ("pattern" in schema and not re.search(schema["pattern"], value))
        out += [f"{at} is too short"] * (len(value) < schema.get("minLength", 0))
    if isinstance(value, list):
        out += [f"{at} has the wrong number of items"] * (not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)))
        out += [f"{at} repeats an item"] * (bool(schema.get("uniqueItems")) and len({json.dumps(v, sort_keys=True) for v in value}) < len(value))
        first = schema.get("prefixItems", schema["items"] if isinstance(schema.get("items"), list) else [])
        rest = schema.get("items") if isinstance(schema.get("items"), (dict, bool)) else True
        for i, v in enumerate(value):
            out += check_schema(v, first[i] if i < len(first) else rest, root, f"{at}[{i}]")
    if isinstance(value, dict):
        out += [f"{at} lacks {k!r}" for k in schema.get("required", []) if k not in value]
        out += [f"{at} has too few members"] * (len(value) < schema.get("minProperties", 0))
        for k, v in value.items():
            own = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)] + [s for p, s in schema.get("properties", {}).items() if p == k]
            for s in own or [schema.get("additionalProperties", True)]:
                out += check_schema(v, s, root, f"{at}.{k}")
    for part in schema.get("allOf", []):
        out += check_schema(value, part, root, at)
    fits = lambda name: sum(not check_schema(value, part, root, at) for part in schema[name])
    out += [f"{at} fits none of the choices"] * ("anyOf" in schema and not fits("anyOf")) + [f"{at} does not fit one choice"] * ("oneOf" in schema and fits("oneOf") != 1)
    out += [f"{at} is what it must not be"] * ("not" in schema and not check_schema(value, schema["not"], root, at))
    if "if" in schema:
        branch = "else" if check_schema(value, schema["if"], root, at) else "then"
        out += check_schema(value, schema.get(branch, True), root, at)
    return out


def _geographic(crs: Any) -> bool:
    text = json.dumps(crs) if isinstance(crs, dict) else str(crs)
    return crs is None or "Geographic" in text or "4326" in text or "CRS84" in text


def check_bbox(box: Any, geographic: bool) -> list[str]:
    if box is None:
        return []
    if not isinstance(box, list) or len(box) not in (4, 6) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in box):
        return ["bbox does not have 4 or 6 numbers"]
    half, out = len(box) // 2, []
    if box[half + 1] < box[1] or (half == 3 and box[5] < box[2]) or (box[half] < box[0] and not geographic):
        out.append("bbox has a maximum below its minimum")
    if geographic and (min(box[0], box[half]) < -180 or max(box[0], box[half]) > 180 or box[1] < -90 or box[half + 1] > 90):
        out.append("bbox leaves the globe")
    return out


def check_values(values: list[bytes | None], declared: list[str], oriented: bool, first: int = 0) -> list[tuple[str, str]]:
    """Findings on WKB values."""
    out = []
    for i, raw in enumerate(values, first):
        if raw is None:
            continue
        try:
            g = wkb.from_wkb(raw)
        except wkb.GeometryError as e:
            out.append(("V11", f"row {i}: {e}"))
            continue
        if declared and g.type_name not in declared:
            out.append(("V11", f"row {i}: {g.type_name} is not declared"))
        if oriented and not wkb.well_oriented(g):
            out.append(("V11", f"row {i}: a ring runs the wrong way"))
    return out


def check_file(path: str, check_data: bool = False, schema: dict | None = None) -> Iterator[tuple[str, str]]:
    """All findings on a file, as they come up."""
    where, name = open_fs(path)
    try:
        source = where.open_input_file(name)
        file = pq.ParquetFile(source)
    except (OSError, pa.ArrowInvalid) as e:
        yield "V1", f"no Parquet file: {str(e)[:80]}"
        return
    with source:
        raw = (file.metadata.metadata or {}).get(b"geo")
        if raw is None:
            yield "V2", "there is no geo key"
            return
        try:
            geo = json.loads(raw)
        except ValueError:
            yield "V3", "the geo key is not JSON"
            return
        yield from check_metadata(geo, file.schema_arrow)
        if schema is not None:
            yield from (("V5", m) for m in check_schema(geo, schema))
        for column, own in geo.get("columns", {}).items() if check_data and isinstance(geo, dict) and isinstance(geo.get("columns"), dict) else ():
            if isinstance(own, dict) and own.get("encoding") == "WKB" and column in file.schema_arrow.names:
                first = 0
                for batch in file.iter_batches(batch_size=8192, columns=[column]):
                    yield from check_values(batch.column(0).to_pylist(), own.get("geometry_types") or [], own.get("orientation") == "counterclockwise", first)
                    first += batch.num_rows


def validate(spark: SparkSession, files: list[str], check_data: bool = False, schema: dict | None = None) -> DataFrame:
    """FINDINGS on files, all of them; a file without findings has no row. `schema` is a JSON schema for the geo key."""
    kinds = pa.schema([("path", pa.string()), ("check", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = check_file(path, check_data, schema)
                while part := list(itertools.islice(found, 1000)):
                    yield pa.RecordBatch.from_pylist([{"path": path, "check": c, "message": m} for c, m in part], kinds)

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 1000))).mapInArrow(run, FINDINGS)


def compare_bounds(files: DataFrame, data: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Each file's declared bounds against those of its rows, with absolute differences.

    files: sources.files.footers; data: rows with their `path` and boxes. Local paths may be
    written as URIs or not.
    """
    plain = F.regexp_replace("path", "^file:/+", "/").alias("path")
    column = F.from_json("geo", "struct<primary_column:string,columns:map<string,struct<bbox:array<double>>>>")
    declared = files.select(plain, column.alias("g")).select("path", F.col("g.columns")[F.col("g.primary_column")].bbox.alias("declared"))
    b = F.col(bbox)
    real = data.groupBy(plain).agg(F.array(F.min(b.xmin), F.min(b.ymin), F.max(b.xmax), F.max(b.ymax)).alias("computed"))
    delta = F.zip_with("declared", "computed", lambda x, y: F.abs(x - y))
    return declared.join(real, "path", "left").select("path", "declared", "computed", delta.alias("delta"), F.array_max(delta).alias("largest"))
