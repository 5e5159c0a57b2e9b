"""Archives written and read back, at many cut and split places."""

import base64
import hashlib
import random

from trustweave.llm import queries, warc
from trustweave.llm.staging import new_path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def check(spark, rows, path):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(f"{path}/pages.parquet")
    out = queries.op10_warc(spark, path).collect()
    assert len(out) == len(rows) and not any(r.damaged for r in out)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    want = []
    for i, _, h in rows:
        lead = first.get(digest(h))
        again = lead is not None and i != lead
        want.append((str(i), len((h or "").encode()), digest(h), "revisit" if again else "response", str(lead if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out) == sorted(want)


def test_defined_cases(spark, tmp_path):
    check(spark, [
        (1, "http://a.com/x", "hi"), (2, "http://b.com", "hi"), (3, None, None), (4, "nohost", ""), (5, "http://c/\r\nX: y", "line\r\n"), (6, "http://d/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (7, "u://e/p?q#f", "\r\n\r\n\r\n"), (None, "http://n/", "hi"), (9, "http://z/WARC/1.1", "é漢🙂\r"), (1, "http://a.com/x", "hi"), (10, "x://y", "WARC/1.1\r\nab"), (11, "x://y", "\r\n\r\nWARC/1.1"),
        (12, "x://y", "q" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (13, "x", "z" * 70_000 + "\r\n\r\n"), (None, None, "only without an id"),
    ], str(tmp_path))
    assert warc.base32_sha1 is not None


def test_cuts_at_buffer_and_split_ends(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", f"{i}" + "".join(rng.choice(["\r\n", "x", "WARC/1.1", "\r\n\r\n", "é", "W", "WAR"]) for _ in range(rng.randrange(0, 1500)))) for i in range(1200)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97k")
    try:
        check(spark, rows, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_captures_are_nested_and_damage_is_seen(spark, tmp_path):
    path = new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "http://a/b?c", "<p>x")], "page_id long, url string, html string"), path)
    row = warc.assemble(warc.read_records(spark, path)).first()
    assert row.response.payload == "<p>x" and row.response.target_uri == "http://a/b?c" and row.metadata.payload.strip() == "page-id: 1"
    assert row.request.http_head == "GET /b?c HTTP/1.1"
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort\r\n\r\n")
    bad = warc.read_records(spark, str(tmp_path / "bad.warc")).first()
    assert bad.damaged and bad.record_id == "<r>"
    empty = new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0
