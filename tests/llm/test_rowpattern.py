import hashlib
import math
import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortline.llm import catalog, rowpattern

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, at string, part string, letter int"


def brute(rows):
    """Matches ``(client_id, match_no, first_id, last_id, n_rows, sum_cents, labels)``, tried row by row with Python's own regular expressions."""
    out, by = [], {}
    for r in set(rows):
        if r[2] is not None and r[1] is not None:
            by.setdefault(r[2], []).append(r)
    for client, own in by.items():
        own.sort(key=lambda r: (r[1], r[0]))
        cents = [None if r[4] is None or not math.isfinite(r[4]) else math.floor(100 * r[4] + 0.5) for r in own]
        number = 0
        for s in range(len(own)):
            if cents[s] is None:
                continue
            fits = []
            for i in range(s + 1, len(own)):
                ok = own[i][1] - own[i - 1][1] <= timedelta(minutes=30) and cents[i] is not None
                sound = ok and cents[i - 1] is not None and own[i][3] not in (None, "error")
                what = ("D" if sound and cents[i] < cents[i - 1] else "") + ("U" if sound and cents[i] > cents[i - 1] else "") + ("P" if ok and own[i][3] == "click" and cents[i] >= cents[s] else "")
                fits.append({"": "x", "DP": "d", "UP": "u"}.get(what, what))
                if fits[-1] in "xP":
                    break
            m = re.match("(?:[Dd]+[Uu]+)+[duP]?", "".join(fits))
            if m:
                number += 1
                n, body = len(m[0]), re.match("(?:[Dd]+[Uu]+)+", "".join(fits))[0]
                ids = own[s : s + n + 1]
                out.append((client, number, ids[0][0], ids[-1][0], n + 1, sum(cents[s : s + n + 1]), "A" + body.upper() + "P" * (n - len(body))))
    return sorted(out)


def rows_of(seed=1, n=3000):
    rng, at, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31]) if i % 7 else 30, microseconds=rng.choice([0, 0, 1]))
        out.append((i, at, rng.choice([7, 7, 7, 8, 9, None]), rng.choice(["click", "view", "click", "error", None]) if rng.random() < 0.5 else "click", rng.choice([None, 1.0, 1.004, 1.005, 2.5, -3.0, 10.0, float("nan"), float("inf")]) if rng.random() < 0.3 else rng.random() * 9, "x", "y", rng.choice([1, 1, 2])))
    return out + rng.sample(out, 200)


@pytest.mark.parametrize(("partitions", "block"), [(4, 512), (23, 2)])
def test_against_brute_force(spark, monkeypatch, partitions, block):
    """A run goes over many tasks, whose rows begin anywhere; the scans over tasks go in several rounds."""
    monkeypatch.setattr(rowpattern, "BLOCK", block)
    monkeypatch.setattr(rowpattern.last_before, "__defaults__", (block,))
    monkeypatch.setattr(rowpattern.total_before, "__defaults__", (block,))
    rows = rows_of()
    long = [(10_000 + i, datetime(2024, 2, 1) + timedelta(seconds=i), 11, "click", float(i % 2 + i / 1000), "x", "y", 1) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = sorted(map(tuple, rowpattern.matches(spark.createDataFrame(rows + long, SCHEMA)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert got == brute(rows + long)
    assert max(r[4] for r in got) > 300


def test_query_beside_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view clicks as select * from '{sf_dir}/clicks.parquet'")
    df = catalog.op13_row_pattern(spark, sf_dir)
    want = con.execute(catalog.OP13_SQL)
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert {c: t for c, t in df.dtypes if c != "labels_sha256"} == dict.fromkeys(df.columns[:-1], "bigint")


def test_digest(spark, sf_dir):
    labels = rowpattern.matches(spark.read.parquet(f"{sf_dir}/clicks.parquet")).limit(20).collect()
    got = {(r.client_id, r.match_no): r.labels_sha256 for r in catalog.op13_row_pattern(spark, sf_dir).collect()}
    assert all(got[r.client_id, r.match_no] == hashlib.sha256(r.labels.encode()).hexdigest() for r in labels)


def test_odd_rows(spark):
    rows = rows_of(3, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rowpattern.matches(df.limit(0)).count() == 0
    assert rowpattern.matches(df.where("client_id is null")).count() == 0
    assert sorted(map(tuple, rowpattern.matches(df.withColumn("kind", F.lit(None).cast("string"))).collect())) == []
    assert rowpattern.matches(df.withColumn("value", F.lit(None).cast("double"))).count() == 0
    assert rowpattern.matches(df.withColumn("value", F.lit(1.0))).count() == 0


def test_long_strings_need_no_deep_stack(spark):
    code = spark.range(1).select(F.expr("repeat('DdUu', 200000)").alias("c"))
    assert code.select(F.length(F.regexp_extract("c", rowpattern.FORM, 1))).first()[0] == 800_000


def test_no_python_and_no_group_of_a_whole_client(spark, sf_dir):
    df = rowpattern.fragments(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning(client_id" not in plan
