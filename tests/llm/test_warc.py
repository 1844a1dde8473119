import gzip
import hashlib
import io
import os
import zlib

import duckdb

from cohortline.llm import catalog, warc

SCHEMA = "page_id long, url string, html string, digest string, n int, leader long"
BIG = "é\r\n\r\nWARC/1.1\r\n" * 200


def brute(pages, least=1000):
    top = {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= least and p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        lead = top.get(b)
        again = lead is not None and p != lead
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(catalog.op6_warc(spark, sf_dir)) == brute(pages)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(con.execute(catalog.OP6_SQL).fetchall(), key=str) == brute(pages)


def test_odd_rows(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (2, "http://c\r\nX: y", None), (4, "http://d", ""), (6, "http://e", "small"), (7, "http://f", "small"), (8, "http://g", BIG + "x"), (8, "http://g", BIG + "x"), (None, "http://h", BIG), (None, "http://i", BIG + "y"), (None, "http://j", BIG + "y"), (9, "u", "q" * 1_000_000)]
    df = spark.createDataFrame([(*p, "x", 0, 1) for p in pages], SCHEMA)
    assert got(warc.round_trip(df)) == brute(pages)
    monkeypatch.setattr(warc, "FEW", 0)
    path = str(tmp_path / "w")
    assert got(warc.round_trip(df, path, file_bytes=2000)) == brute(pages)
    assert warc.round_trip(df.limit(0)).count() == 0
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) >= 3
    for f in files:  # a member for each record, which can be read by itself, and an empty one at the end
        left, whole = open(f"{path}/{f}", "rb").read(), []
        assert len(left) <= 2000 + len(warc.NOTHING) or len(list(warc.parse(gzip.open(f"{path}/{f}")))) == 1
        while left:
            one = zlib.decompressobj(wbits=31)
            whole.append(one.decompress(left))
            left = one.unused_data
        assert whole.pop() == b"" and all(len(list(warc.parse(io.BytesIO(x)))) == 1 for x in whole)
    records = [r for f in files for r in warc.parse(gzip.open(f"{path}/{f}"))]
    assert len(records) == 3 * len(pages) and {h["warc-type"] for h, _ in records} == {"request", "response", "revisit", "metadata"}


def test_nested_captures(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame([(1, "http://a", BIG, "", 0, 1), (2, "http://b", BIG, "", 0, 1)], SCHEMA)
    warc.write_archives(df, path)
    rows = {r.page_id: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
    assert bytes(rows[2].response.payload).decode() == BIG and rows[1].response.payload is None
    assert rows[1].refers_to == 2 and rows[1].response.kind == "revisit" and rows[1].request.target_uri == "http://a"
    assert rows[1].response.refers_to == rows[2].response.record_id


def test_parser_refuses_what_is_no_record():
    try:
        list(warc.parse(io.BytesIO(b"hello\n")))
    except ValueError:
        return
    raise AssertionError
