import gzip
import hashlib
import io

import pytest

from quadrille.llm.warc import WarcError, read_archive, record_bytes, round_trip


def member(headers, block):
    return record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<a>"} | headers, block)


def test_reader_frames_and_verifies():
    blocks = [b"", b"x" * 700_000, b"\r\n\r\nWARC/1.1\r\n", "é".encode()]
    raw = b"".join(member({"WARC-Payload-Digest": "sha1:" + hashlib.sha1(b).hexdigest()}, b) for b in blocks)
    rows = list(read_archive(io.BytesIO(raw)))
    assert [r["payload"] for r in rows] == blocks and all(r["digest_ok"] for r in rows)
    assert gzip.decompress(raw).count(b"WARC-Type") == 4
    assert not next(read_archive(io.BytesIO(member({"WARC-Payload-Digest": "sha1:00"}, b"y"))))["digest_ok"]
    assert list(read_archive(io.BytesIO(b""))) == []


@pytest.mark.parametrize("raw", [member({}, b"abc")[:-9], gzip.compress(b"no headers"), gzip.compress(b"HTTP/1.1\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")])
def test_broken_archives_are_errors(raw):
    with pytest.raises(WarcError):
        list(read_archive(io.BytesIO(raw)))


def test_round_trip(spark):
    long, other = "ü" * 600, "b" * 1000
    rows = [(1, "u1", long), (2, "u\r\n2", long), (3, None, None), (4, "u", ""), (5, "u", "b" * 999), (6, "u", "b" * 999)]
    rows += [(7, "u", other), (9, "u", other), (9, "u", other), (8, "u", other), (None, "u", other), (10, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "digest", 1) for r in rows], "page_id long, url string, html string, digest string, payload long").repartition(3)
    got = round_trip(df, with_payload=True).collect()
    assert len(got) == len(rows)
    by = sorted(((r.record_id, r.record_type, r.refers_to) for r in got))
    want = {1: 2, 7: 9, 8: 9}
    assert by == sorted((f"urn:page:{'' if i is None else i}", "revisit" if i in want else "response", f"urn:page:{want[i]}" if i in want else None) for i, _, _ in rows)
    bodies = {i: (h or "").encode() for i, _, h in rows if i is not None}
    for r in got:
        body = bodies.get(int(r.record_id[9:] or -1), other.encode())
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert round_trip(df.limit(0)).count() == 0
