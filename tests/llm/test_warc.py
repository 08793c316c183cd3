import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricefold.llm import warc

SCHEMA = "page_id long, url string, html string"


def sha(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by comparing all payloads."""
    out = []
    for i, _, h in rows:
        size = len((h or "").encode())
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None] if size >= least else []
        first = min(same, default=None)
        refers = first if first is not None and first != i else None
        out.append((i, size, sha(h), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aé√ 😀\r\n<>0") for _ in range(n))
    rows = [(i, f"http://h.example/{i}", text(rng.choice((0, 5, 300, 9_000, 60_000)))) for i in range(40)]
    rows += [(100 + i, f"http://c.example/{i} x", rows[i % 7][2]) for i in range(30)]
    rows += [(200, None, None), (201, "http://é/", ""), (202, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1"), (203, "u\r\nX-Page-ID: 9", "0\r\n\r\n"), (204, "u", "x" * 300_000)]
    return rows


def test_round_trip_and_dedup(spark):
    rows = corpus()
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS payload", "2 AS digest", "3 AS refers_to")
    got = warc.archived(pages)
    assert result(got) == brute(rows)
    texts = dict((i, h or "") for i, _, h in rows)
    for r in got.collect():
        assert r.complete
        assert r.payload == (texts[r.page_id] if r.record_type == "response" else None)


def test_least_bytes(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    assert result(warc.archived(spark.createDataFrame(rows, SCHEMA), least_bytes=3)) == brute(rows, 3)


def test_edges(spark):
    rows = [(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (7, "u", "same"), (None, "u", "own"), (None, "u", "own"), (3, None, None), (4, None, "")]
    assert result(warc.archived(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def records(path):
    return [x for f in sorted(path.glob("*.gz")) for x in warc.parsed(f.read_bytes())]


def test_segments_on_disk(spark, tmp_path):
    """Long blocks are cut as the format says; files are plain WARC once unzipped."""
    html = "é" * 100_000
    warc.write_archive(spark.createDataFrame([(1, "http://a/", html)], SCHEMA), str(tmp_path / "w"))
    got = records(tmp_path / "w")
    origin = got[0][0]["warc-record-id"]
    assert [h["warc-segment-number"] for h, _ in got] == [str(i + 1) for i in range(len(got))] and len(got) == 4
    assert all(h["warc-type"] == "continuation" and h["warc-segment-origin-id"] == origin for h, _ in got[1:])
    assert int(got[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in got)
    assert all(len(b) <= warc.SEGMENT_BYTES and len(b) == int(h["content-length"]) for h, b in got)
    raw = gzip.decompress(next((tmp_path / "w").glob("*.gz")).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("fault", ["missing", "swapped total", "short file", "bad digest"])
def test_damage_is_reported(spark, tmp_path, fault):
    """Records are reordered and plain; a damaged one comes out incomplete, the others whole."""
    pages = [(1, "u", "z" * 200_000), (2, "u", "fine")]
    recs = [r for i, u, h in pages for r in warc.records_of(i, u, h.encode(), sha(h), None, f"0-{i}")]
    assert len(recs) == 5
    if fault == "missing":
        del recs[2]
    elif fault == "swapped total":
        recs[3] = recs[3].replace(b"Segment-Total-Length: 2", b"Segment-Total-Length: 9")
    elif fault == "bad digest":
        recs[1] = recs[1].replace(b"zzzz", b"zzzy", 1)
    random.Random(1).shuffle(recs)
    body = b"".join(r + b"\r\n\r\n" for r in recs)
    if fault == "short file":
        recs.sort(key=lambda r: b"Segment-Number: 4" in r)
        body = b"".join(r + b"\r\n\r\n" for r in recs)[:-500]
    (tmp_path / "x.warc").write_bytes(body)
    got = {r.page_id: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got[2].complete and got[2].payload == "fine"
    assert not got[1].complete and got[1].payload is None


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcX0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(bad) is None


def test_base32(spark):
    texts = ["", "a", "é", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.col("t").cast("binary"))).collect()
    assert [r[0] for r in got] == [sha(t) for t in texts]
