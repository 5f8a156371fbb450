"""WARC round trips, with ranges that cut records anywhere."""

import gzip
import hashlib
import random

import pytest
from outlay.llm import warc as R
from outlay.llm.common import scratch_path


def pages(rng, n):
    bodies = ["<p>" + "".join(rng.choices("abcdef <>é\r\n", k=rng.choice([5, 95, 400, 3000]))) + "</p>" for _ in range(n // 2)]
    return [(i, None if i % 7 == 0 else f"http://x.example/{i}\r\nX: y", rng.choice(bodies) if i % 11 else None) for i in range(n)]


def want(rows):
    first, out = {}, {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= R.LEAST and i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        f = first.get(body)
        out.setdefault(i, []).append((len(body), hashlib.sha256(body).hexdigest(), "response" if f is None or f == i else "revisit", None if f == i else f))
    return out


@pytest.mark.parametrize("split,size", [(1 << 22, 1 << 26), (97, 2000), (1, 700), (1000, 1 << 26)])
def test_round_trip(spark, split, size):
    rows = pages(random.Random(split), 60)
    files = R.write(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), scratch_path(spark, "warc"), file_bytes=size)
    got = R.read(spark, files, split).collect()
    expected = want(rows)
    assert len(got) == len(rows) and all(r.intact for r in got)
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == expected[r.page_id][0]
    bodies = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == bodies[r.page_id] for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id % 7 == 0} == {None}


def test_listing_and_foreign_bytes(spark, tmp_path):
    """Junk, false magic, other members and a cut-off end are skipped; all records around them are read."""
    one, two = (R.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in (1, 2))
    junk = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + R.MAGIC
    (tmp_path / "a.warc.gz").write_bytes(junk + one + junk + two + one[:-9])
    for split in (1, 5, 64, 1 << 20):
        got = R.read(spark, R.listing(spark, f"file://{tmp_path}"), split).collect()
        assert sorted(r.page_id for r in got) == [1, 2]


def test_magic_inside_a_payload(spark, tmp_path):
    inner = R.record(9, "u", b"inner", hashlib.sha256(b"inner").hexdigest(), None)
    body = inner * 50
    (tmp_path / "a.warc.gz").write_bytes(R.record(1, "u", body, hashlib.sha256(body).hexdigest(), None))
    got = R.read(spark, R.listing(spark, f"file://{tmp_path}"), 1 << 20).collect()
    assert [(r.page_id, r.intact) for r in got] == [(1, True)]


def test_odd_rows(spark):
    long = "é" * 1_500_000
    rows = [(None, "u", "x" * 200), (3, "u", "x" * 200), (3, "u", "x" * 200), (2, None, long), (5, "u", long), (4, "u", None), (6, "u", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS payload", "4 AS n")
    got = R.read(spark, R.write(spark, docs, scratch_path(spark, "warc")), 1 << 16).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(None, "revisit", 3), (3, "response", None), (3, "response", None), (2, "response", None), (5, "revisit", 2), (4, "response", None), (6, "response", None)], key=str
    )
    none = R.write(spark, docs.limit(0), scratch_path(spark, "warc"))
    assert none.count() == 0 and R.read(spark, none).count() == 0


def test_malformed_headers_are_skipped(spark, tmp_path):
    one, two = (R.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in (1, 2))
    odd = [gzip.decompress(one).replace(b"Content-Length: ", b"Content-Length: x", 1), gzip.decompress(one).replace(b"\r\n\r\n", b"", 3), gzip.decompress(one).replace(b"x-page:1", b"x-page:" + b"9" * 30)]
    (tmp_path / "a.warc.gz").write_bytes(one + gzip.compress(odd[0]) + gzip.compress(odd[1]) + gzip.compress(odd[2]) + two)
    got = R.read(spark, R.listing(spark, f"file://{tmp_path}"), 50).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got if r.record_type == "response" and r.intact and r.payload_bytes) == [("1", 9), ("2", 9), ("None", 9)]


def test_one_payload_on_most_rows(spark):
    rows = [(i, "u", "same" * 50 if i % 3 else f"{i} " * 60) for i in range(3000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = R.read(spark, R.write(spark, docs, scratch_path(spark, "warc"))).collect()
    expected = want(rows)
    assert len(got) == 3000 and all((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == expected[r.page_id][0] for r in got)
