import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortline.llm import simhash
from cohortline.llm.common import components

SCHEMA = "doc_id long, text string, fp string, key int, component_id string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, distance=4):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for x, i in zip(label, ids, strict=True):
        low[x] = min(low.get(x, i), i)
    return [low[x] for x in label]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in want]
    label = slow_components([r.doc_id for r in want], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(want, fps, label, strict=True)}


def test_nulls_empty_long_ties_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    data = [(5, None, "x", 1, "c"), (3, "", "x", 1, "c"), (9, " \t\n", None, None, None), (7, "One two", "y", 2, "d"), (8, "oNE\x0btwo", "y", 2, "d"), (8, "one two", "z", 2, "d"), (1, long, "", 0, ""), (None, "one two", "", 0, ""), (2, "É é", "", 0, "")]
    got = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got.collect())
    fp = {t: f"{slow_fingerprint(t):016x}" for t in ("", "one two", long, "É é")}
    assert rows == sorted([(5, fp[""], 3), (3, fp[""], 3), (9, fp[""], 3), (7, fp["one two"], 7), (8, fp["one two"], 7), (8, fp["one two"], 7), (-1, fp["one two"], 7), (1, fp[long], 1), (2, fp["É é"], 2)])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = {base}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(12)))
    fps = sorted(fps | {rng.getrandbits(63) for _ in range(100)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = slow_components(fps, fps)
    for bucket in (16, 8192):
        found = {r.node: r.component for r in components(simhash.links(frame, 4, bucket)).collect()}
        assert [found.get(x, x) for x in fps] == want


def test_any_close_pair_shares_a_key(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        pairs.append([int(np.uint64(x).astype(np.int64)) for x in (a, b)])
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert frame.where(~F.arrays_overlap(simhash.block_keys(F.col("a"), 4), simhash.block_keys(F.col("b"), 4))).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(200, 260)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {1: 1} | {i: 1 for i in range(200, 260)}


def test_kept_rows_with_clashing_names(spark):
    schema = "doc_id long, text string, gone long, again long, component_id string, count int, fp int"
    data = [(5, "a b", 5, 5, "x", 1, 1), (3, "A B", 3, 3, "x", 1, 1), (3, "A B", 3, 3, "x", 1, 1), (9, "other words here", 9, 9, None, None, None), (None, "a b", None, None, "x", 1, 1)]
    df = spark.createDataFrame(data, schema)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.where("doc_id = 9 or doc_id is null").union(df.where("doc_id = 3").limit(1)).collect()))
    assert simhash.keep_first(df.limit(0)).count() == 0
