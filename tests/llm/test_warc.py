import base64
import gzip
import hashlib

from docquarry.llm import warc
from docquarry.llm.common import shared_dir
from pyspark.sql import functions as F


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("sum", F.lit("x")).repartition(3)


ROWS = [
    (5, "http://www.Example.org/a?b=1", "<p>one</p>"),
    (3, "https://example.org:8080", "<p>one</p>"),
    (9, "https://example.org:8080/", "<p>é</p>" * 9),
    (1, None, None),
    (2, "no url at all\r\nX: y", ""),
    (-4, "//user@h.io:443/p#f", "<p>one</p>"),
    (7, "http://www.example.org/a?b=1", "x" * 300_000),
    (None, "http://z.com", "<p>one</p>"),
    (None, "http://z.com", "alone"),
]


def want(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        refers = first.get(h or "") if len(raw) >= least and sum((x[2] or "") == (h or "") for x in rows) > 1 else None
        revisit = refers is not None and refers != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


def test_keys():
    assert warc.url_key("http://www.Example.org/A?b=1#c") == "org,example,www)/A?b=1"
    assert warc.url_key("https://10.0.0.1:8080") == "10.0.0.1:8080)/"
    assert warc.url_key(None) == "-" and warc.url_key("a b") == "a%20b"
    assert warc.page_of(warc.record_id(-5)) == -5 and warc.page_of(warc.record_id(None)) is None


def test_round_trip(spark):
    for least in (0, 1, 50):
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages(spark, ROWS), least).collect()), key=str)
        assert got == want(ROWS, least)
    assert warc.archive_round_trip(pages(spark, ROWS).where("false")).collect() == []


def test_shuffled_roles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "LIMIT", 0)
    rows = ROWS + ROWS[:2] + [(100 + i, f"http://hot.com/{i % 7}", "copy") for i in range(300)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    assert got == want(rows)


def test_index_finds_urls_over_many_blocks(spark):
    rows = [(i, f"http://host{i % 3}.com/{i // 3 % 50}", f"page {i}") for i in range(900)]
    a, b = shared_dir(spark, "t-warc"), shared_dir(spark, "t-index")
    parts = warc.write_index(warc.write_archives(pages(spark, rows), a), b, lines=16)
    index = warc.Index([tuple(r) for r in parts.collect()], b, a)
    for n in (0, 7, 149):
        url = f"http://host{n % 3}.com/{n // 3 % 50}"
        assert sorted(r["page_id"] for r in index.url(url)) == [i for i in range(900) if rows[i][1] == url]
        assert all(r["payload"].decode() == f"page {r['page_id']}" for r in index.url(url))
    assert index.url("http://host0.com/5000") == []
    assert len(index.captures("", "\x7f")) == 900


def test_archives_are_plain_gzip(spark):
    folder = shared_dir(spark, "t-plain")
    captures = warc.write_archives(pages(spark, ROWS), folder).collect()
    for name in {r.file for r in captures}:
        with gzip.open(f"{folder.removeprefix('file://')}/{name}") as f:
            assert f.read().startswith(b"WARC/1.1\r\n")
