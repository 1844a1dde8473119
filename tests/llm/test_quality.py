import zlib

import numpy as np
import pytest

from cohortline.llm import catalog, quality

DOCS, LABELS = "doc_id long, text string, score string, y int", "doc_id long, quality int, toxic int, text string"


def test_shapes_and_terms():
    assert [quality.shape(w) for w in ("Word,", "word###", "WORD!!", "x1y22", "Élan")] == ["Aa,", "a#", "A!", "a0a0", "Aa"]
    assert quality.terms(None)[0] == quality.terms(" \n")[0] == 1
    assert quality.terms("de de de de")[1] == pytest.approx(np.sqrt(3 / 4))


def test_votes_against_plain_neighbours():
    rng = np.random.default_rng(1)
    x, y = rng.random((200, quality.TERMS)).astype(np.float32) * (rng.random((200, quality.TERMS)) < 0.05), rng.integers(0, 2, 200)
    voters = quality.Voters.fit(x, y)
    got = voters.vote(x[:20])
    z = voters.unit(voters.unit(x * voters.weight) @ voters.space)
    for k in range(20):
        near = np.argsort(-(z @ z[k]))[: quality.NEIGHBOURS]
        w = (z[near] @ z[k]).clip(1e-6) ** quality.POWER
        assert got[k] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-3)
    assert voters.vectors.shape == (200, quality.LATENT)


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = catalog.op5_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in bad) <= 0.1 * len(bad)


def test_odd_rows(spark):
    docs = [(i, "Plain words of a text here." if i % 2 else "junk### of*** text&&& here$$$", "x", 0) for i in range(60)]
    odd = [(100, None, "x", 0), (101, "", "x", 0), (102, "word " * 50_000, "x", 0), (103, "Plain words.", "x", 0), (103, "junk### a***", "x", 0), (None, "Plain words.", "x", 0)]
    labels = [(i, i % 2, 0, "x") for i in range(60)] + [(1, 1, 0, ""), (None, 0, 0, ""), (100, None, 0, ""), (101, 7, 0, "")]
    d, y = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels, LABELS)
    got = {}
    for r in quality.score(d, y).collect():
        got.setdefault(r.doc_id, []).append(r.predicted)
    assert len(got[103]) == 2 and got[None] == [1] and set(got) == {*range(60), 100, 101, 102, 103, None}
    assert all(got[i] == [i % 2] for i in range(60))
    assert quality.score(d.limit(0), y).count() == 0
    assert {r.score for r in quality.score(d, y.limit(0)).collect()} == {0.0}
