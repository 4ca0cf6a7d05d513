"""GeoJSON: an incremental reader of feature collections of any size, and writers."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.geometry import wkb
from quadrille.sources.files import open_fs

FEATURES = "path string, ordinal long, feature string, properties string, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
#: Bytes read at once, and features of a batch.
PIECE, BATCH = 1 << 18, 2000
_GAP = re.compile(r"[\s,]*")


def features_of(stream) -> Iterator[dict]:
    """The members of `features` of a collection, or a lone feature, or one feature a line, as they are read."""
    decode, parser = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder()
    text, done = "", False

    def more(size: int = PIECE) -> None:
        nonlocal text, done
        piece = stream.read(size)
        done = not piece
        text += decode.decode(piece or b"", final=done)

    def value() -> Any:
        """The next whole value of the text; a long one is parsed again only when twice as much of it is there."""
        nonlocal text
        while True:
            try:
                out, end = parser.raw_decode(text)
                if end < len(text) or done:
                    text = text[end:]
                    return out
            except json.JSONDecodeError:
                if done:
                    raise ValueError("the text ends inside a value") from None
            more(max(PIECE, len(text)))

    def skip() -> str:
        """The next character after space and commas."""
        nonlocal text
        while True:
            text = text[_GAP.match(text).end() :]
            if text or done:
                return text[:1]
            more()

    while skip():
        if text[0] != "{":
            raise ValueError("a feature or collection is expected")
        # an object is read member by member, so that `features` need not fit in memory
        text = text[1:]
        members: dict[str, Any] = {}
        while skip() != "}":
            name = value()
            while skip() != ":":
                raise ValueError("a member has no value")
            text = text[1:]
            if name == "features" and skip() == "[":
                text = text[1:]
                while skip() != "]":
                    if not text:
                        raise ValueError("the list of features has no end")
                    yield value()
                text = text[1:]
            else:
                skip()
                members[name] = value()
        text = text[1:]
        if members.get("type") == "Feature":
            yield members


KINDS = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("feature", pa.string()), ("properties", pa.string()), ("geometry", pa.binary()), ("bbox", pa.struct([(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")]))])


def feature_row(path: str, ordinal: int, f: dict, order: str = "xy") -> dict:
    """A row of FEATURES; an unreadable geometry is null."""
    try:
        geometry = wkb.to_wkb(wkb.from_geojson(f["geometry"])) if f.get("geometry") else None
    except wkb.GeometryError:
        geometry = None
    box = wkb.json_bounds(f, order)
    dump = lambda v: json.dumps(v, ensure_ascii=False)
    return {"path": path, "ordinal": ordinal, "feature": dump(f), "properties": dump(f.get("properties") or {}), "geometry": geometry, "bbox": dict(zip(("xmin", "ymin", "xmax", "ymax"), box)) if box else None}


def read(spark: SparkSession, paths: list[str], order: str = "xy") -> DataFrame:
    """FEATURES of files, plain or gzipped (S6 to S9): a task streams a file and holds one batch.

    Every feature is one row, also with a null or unreadable geometry, which is null. bbox
    is the feature's own, its geometry's, or that of its positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = open_fs(path)
                rows: list[dict] = []
                with where.open_input_stream(name, compression="detect") as stream:
                    for i, f in enumerate(features_of(stream)):
                        rows.append(feature_row(path, i, f, order))
                        if len(rows) >= BATCH:
                            yield pa.RecordBatch.from_pylist(rows, KINDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, KINDS)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, FEATURES)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited features through Spark's own text reader, which splits files: (feature, properties, geometry_json)."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.col("value").alias("feature"), F.get_json_object("value", "$.properties").alias("properties"), F.get_json_object("value", "$.geometry").alias("geometry_json"))


def flatten(features: DataFrame, schema: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Properties as columns before geometry and bbox; the schema is the union over all features unless given."""
    if schema is None:
        found = features.agg(F.schema_of_variant_agg(F.try_parse_json("properties"))).first()[0] or "OBJECT<>"
        schema = found.replace("OBJECT<", "STRUCT<")
    if schema.upper() in ("STRUCT<>", "VOID"):
        return features.select(*(keep or []), "geometry", "bbox")
    parsed = features.withColumn("_p", F.from_json("properties", schema))
    return parsed.select(*(keep or []), "_p.*", "geometry", "bbox")


def feature_json(properties: list[str], geometry: Column) -> Column:
    """A feature as compact JSON; `geometry` holds GeoJSON text."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def write_lines(features: Column | str, df: DataFrame, folder: str, compression: str = "none") -> None:
    """Newline-delimited features (K5), as parallel as df, gzipped if asked for."""
    column = F.col(features) if isinstance(features, str) else features
    df.select(column.alias("value")).write.mode("overwrite").option("compression", compression).text(folder)


def collect_collection(spark: SparkSession, folder: str, target: str, indent: int | None = None, name: str | None = None) -> int:
    """One FeatureCollection out of a folder of lines (K6), streamed line by line; returns the number of features."""
    where, base = open_fs(folder)
    out_fs, out_path = open_fs(target)
    files = sorted(x.path for x in where.get_file_info(fs_selector(base)) if x.is_file and x.base_name.startswith("part-"))
    count, pad = 0, "\n" if indent else ""
    head = {"type": "FeatureCollection"} | ({"name": name} if name else {})
    with out_fs.open_output_stream(out_path, compression="detect") as out:
        out.write((json.dumps(head, ensure_ascii=False)[:-1] + ', "features": [').encode())
        for path in files:
            with where.open_input_stream(path, compression="detect") as stream:
                for f in features_of(stream):
                    body = json.dumps(f, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
                    out.write(("," * (count > 0) + pad + body).encode())
                    count += 1
        out.write((pad + "]}").encode())
    return count


def fs_selector(base: str):
    from pyarrow.fs import FileSelector

    return FileSelector(base)


def slice_box(features: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Features whose bounds touch a box; those without finite bounds are left out."""
    return features.where(boxes.is_finite(F.col("bbox.xmin")) & boxes.touches(F.col("bbox"), boxes.literal_box(*region)))
