"""WARC archives: a writer and a sequential reader of one gzip member per record.

The writer puts every record of a partition into archives of bounded size in the shared
folder. The reader inflates an archive piece by piece, member by member, frames blocks by
Content-Length, and verifies payload digests, so neither side holds more than a record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import checkpoint_dir, cut

#: Compressed bytes after which a new archive begins, and bytes inflated or read at once.
ARCHIVE_BYTES, PIECE = 32 << 20, 1 << 18
#: The format's version line, profile of revisits and media types.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL_LENGTH = "X-Payload-Length"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def _clean(value: str) -> str:
    return " ".join(value.split())


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record as its own gzip member."""
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode("utf-8", "replace") for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member, an iterator over its inflated pieces, to be exhausted before the next."""
    source, held = _pieces(stream), b""

    def one() -> Iterator[bytes]:
        nonlocal held
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not held:
                held = next(source, b"")
                if not held:
                    raise WarcError("the archive ends inside a record")
            out = inflate.decompress(held, PIECE)
            held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out

    while True:
        if not held:
            held = next(source, b"")
        if not held:
            return
        yield one()


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one member."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, b"")
        if not piece:
            raise WarcError("a record has no end of headers")
        held += piece
    version, *lines = bytes(held[:end]).split(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise WarcError(f"not a record: {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"not a header: {name[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("a record has no Content-Length") from None
    del held[: end + 4]
    for piece in pieces:
        held += piece
    if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}; the member holds {len(held) - 4} bytes")
    return headers, bytes(held[:length])


def read_archive(stream) -> Iterator[dict]:
    """Rows of RECORDS from an open archive, in order; warcinfo records are skipped."""
    for member in members(stream):
        headers, block = read_record(member)
        kind = headers.get("warc-type", "")
        if kind == "warcinfo":
            continue
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        revisit = kind == "revisit"
        full = headers.get(FULL_LENGTH.lower())
        yield {
            "record_id": headers.get("warc-record-id", "").strip("<>"),
            "record_type": kind,
            "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
            "payload_digest": digest,
            "payload_bytes": int(full) if revisit and full else len(block),
            "digest_ok": revisit or digest is None or hashlib.sha1(block).hexdigest() == digest,
            "payload": None if revisit else block,
        }


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes (record_id, target_uri, payload, digest, payload_bytes, refers_to) rows; returns (path, records).

    Rows with refers_to become revisit records without a block, all others responses. An
    archive is written under the attempt's own name and renamed when it is complete, so
    a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt, number = task.partitionId(), task.taskAttemptId(), 0
        done: list[tuple[str, int]] = []
        out = name = None
        size = count = 0

        def close() -> None:
            nonlocal out, number
            out.close()
            final = f"{base}/part-{part:06d}-{number:04d}.warc.gz"
            where.move(name, final)
            done.append((final, count))
            out, number = None, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{base}/.part-{part:06d}-{number:04d}.{attempt}"
                    out, count = where.open_output_stream(name), 0
                    size = out.write(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{base}/{part}/{number}')}>"}, b"format: WARC File Format 1.1\r\n"))
                headers = {
                    "WARC-Type": "revisit" if row["refers_to"] is not None else "response",
                    "WARC-Record-ID": f"<{row['record_id']}>",
                    "WARC-Target-URI": row["target_uri"] or "",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Payload-Digest": f"sha1:{row['digest']}",
                    FULL_LENGTH: str(row["payload_bytes"]),
                }
                block = row["payload"] or b""
                if row["refers_to"] is not None:
                    headers |= {"WARC-Refers-To": f"<{row['refers_to']}>", "WARC-Profile": PROFILE}
                    block = b""
                size += out.write(record_bytes(headers, block))
                count += 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    columns = ["record_id", "target_uri", "payload", "digest", "payload_bytes", "refers_to"]
    return records.select(*columns).mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """RECORDS of every archive in `path`; payloads stay null unless asked for.

    A broken archive or a record whose payload does not have its digest fails the job.
    """
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    types = dict(zip(names, [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                with where.open_input_stream(path, compression=None) as stream:
                    for row in read_archive(stream):
                        if not row["digest_ok"]:
                            raise WarcError(f"{path}: {row['record_id']} does not have its digest")
                        if not with_payload:
                            row["payload"] = None
                        held += 200 + len(row["payload"] or b"")
                        rows.append(row)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(types.items())))
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(types.items())))

    return archives.select("path").mapInArrow(run, RECORDS)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> DataFrame:
    """Records for write_archives: among equal payloads of `least` bytes or more, the largest id is the response.

    Only digests meet in the aggregation and its join, and payloads are joined by id, so a
    payload that fills a third of the table is no single task's work.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    sized = pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("digest"), F.length(body).cast("long").alias("payload_bytes"))
    large = sized.where((F.col("payload_bytes") >= least) & F.col("id").isNotNull())
    groups = large.groupBy("digest").agg(F.max("id").alias("first"), F.min("id").alias("last")).where("last < first").select("digest", "first")
    again = large.select("id", "digest").join(groups, "digest").where("id < first").distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.join(again, ["id", "digest"], "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.select(
        name(F.col("id")).alias("record_id"),
        "target_uri",
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
        "digest",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes one record for each row into archives in the shared folder and reads them back as RECORDS.

    Null bodies are empty payloads, null addresses empty headers; rows with null ids have
    records of their own that never revisit; repeated rows that share the largest id of
    their payload are all responses; other columns are not read; an empty table gives no
    archive and no record. Long bodies are inflated piece by piece.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder
    archives = cut(write_archives(plan_records(pages, id_col, url_col, body_col), folder))
    count = max(1, archives.count())
    return read_archives(archives.repartition(count), folder, with_payload)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = lambda c: F.nullif(F.replace(c, F.lit("urn:page:"), F.lit("")), F.lit("")).cast("long")
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


ORACLES = {
    "op5_warc_round_trip": """
with sized as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest as d, max(page_id) as first from sized where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
  case when first is null or page_id is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when first is null or page_id is null or page_id = first then null else first end as refers_to
from sized left join firsts on payload_bytes >= 1000 and payload_digest = d"""
}
