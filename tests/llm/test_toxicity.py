import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import catalog, toxicity

DOCS, LABELS = "doc_id long, text string, toxic string, score int, y int", "doc_id long, toxic int, quality int, text string"


def slow_marginals(e, step, first):
    out = np.zeros(len(e))
    total = 0.0
    for tags in itertools.product((0, 1), repeat=len(e)):
        s = first[tags[0]] + sum(x * t for x, t in zip(e, tags, strict=True)) + sum(step[a, b] for a, b in itertools.pairwise(tags))
        p = np.exp(s)
        total += p
        out += p * np.array(tags)
    return out / total


def test_marginals_are_exact_across_texts_and_lines(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(toxicity, "LINE", 4)
    t = toxicity.Tagger()
    t.step, t.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [3, 1, 9, 0, 5, 2]
    scores = [rng.normal(size=n) * 2 for n in sizes]
    starts = np.cumsum([0, *sizes[:-1]])
    got = t.marginals(np.concatenate(scores), starts)
    want = np.concatenate([slow_marginals(e, t.step, t.first) for e in scores if len(e)])
    assert got == pytest.approx(want, abs=1e-9)
    assert len(t.marginals(np.empty(0), np.zeros(2, int))) == 0


def test_expectations_are_exact():
    rng = np.random.default_rng(4)
    e, step, first = rng.normal(size=(2, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    on = np.array([[True] * 5, [True] * 3 + [False] * 2])
    p, pairs = toxicity._expectations(e, on, step, first)
    assert p[0] == pytest.approx(slow_marginals(e[0], step, first)) and p[1][:3] == pytest.approx(slow_marginals(e[1][:3], step, first))
    assert pairs.sum() == pytest.approx(4 + 2)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("lor", "ipsu", "dolo", "ametco", "sit") for b in ("em", "ta", "ris", "quen", "la")]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for k in rng.sample(range(40), 3):
                words[k] = "grobu" + rng.choice(("x", "y", "zed", "k", "rt", "mol"))
        docs.append((i, " ".join(words), "x", 1, 0))
        labels.append((i, int(bad), 1, "x"))
    return docs, labels


def test_held_out_documents_and_spans(spark, made):
    docs, labels = made
    got = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    text = {d[0]: d[1] for d in docs}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            assert r.predicted == int(r.doc_id % 4 == 0)
        assert all("grobu" in text[r.doc_id][s["from"] : s["to"]] for s in r.spans)
    assert sum(len(r.spans) for r in got if r.doc_id % 4 == 0) > 200


def test_odd_rows(spark, made):
    docs, labels = made
    odd = [(1000, None, "", 0, 0), (1001, "", "", 0, 0), (1002, "12 ...", "", 0, 0), (1003, "lorem " * 30_000, "", 0, 0), (1004, "grobuqq grobuww", "", 0, 0), (1004, "lorem", "", 0, 0), (None, "lorem", "", 0, 0)]
    more = [(1002, None, 0, ""), (None, 1, 0, ""), (0, 0, 0, ""), (1003, 5, 0, "")]
    d, y = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS)
    got = {}
    for r in toxicity.score(d, y).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert got[1000] == got[1001] == got[1002] == [(0.0, 0)] and got[1003][0][1] == 0 and sorted(p for _, p in got[1004]) == [0, 1]
    kept = toxicity.keep_clean(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {1000, 1001, 1002, 1003, 1004, None}
    assert toxicity.score(d.limit(0), y).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(d, y.limit(0)).collect())


def test_flags_few_clean_documents(spark, sf_dir):
    got = catalog.op7_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    clean = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_held_out_recall_and_precision(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    got = catalog.op7_toxicity(spark, big).select("doc_id", "held_out", "predicted").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    held = got.where("held_out and toxic is not null").groupBy().agg(F.sum(F.col("toxic") * F.col("predicted")).alias("hits"), F.sum("toxic").alias("toxic"), F.sum("predicted").alias("found")).first()
    assert held.hits >= 0.9 * held.toxic and held.hits >= 0.85 * held.found, held
