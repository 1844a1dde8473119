import random

import duckdb
import numpy as np
import pytest

from cohortline.llm import catalog, ngramjoin
from cohortline.llm.nearcopies import shingles

SCHEMA = "doc_id long, text string, node string, n int, component_id int"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([b" ".join(w)] if w else [])


def linked(x, y, least=85):
    both = len(x & y)
    return both > 0 and 100 * both >= least * (len(x) + len(y) - both)


def brute(rows, least=85):
    """``(id, size, component)`` by comparing all pairs."""
    own = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if linked(own[a], own[b], least) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            low[k] = min(i, low.get(k, i))
    return sorted(((-1 if i is None else i), len(s), -1 if (c := low.get(k) if s else i) is None else c) for (i, _), s, k in zip(rows, own, label, strict=True))


def corpus(seed=0, n=60):
    """Texts of few words, of passages that many share, and chains of copies each a few words from the one before."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Word"]
    passage = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 5, 9, 40, 120])))
        if rng.random() < 0.5:
            text = " ".join([*rng.sample(passage, rng.randint(1, 3)), text])
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 4])):
            own = text.split(" ")
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            rows.append(rng.choice([text, text.upper() if "é" not in text.lower() else text, text.replace(" ", "\t\n")]))
    return list(enumerate(rows))


def got(df, **more):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngramjoin.classes(df, **more).collect())


@pytest.mark.parametrize("least", [85, 50])
def test_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(ngramjoin.met, "__defaults__", (97,))
    rows = corpus(least)
    want = brute(rows, least)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least=least) == want
    assert len({c for _, _, c in want}) < len(want) - 10


def test_crowded_components_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin.links, "__defaults__", (4, 200))
    rows = corpus(3, 30)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_query_beside_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = catalog.op12_ngram_join(spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalog.OP12_SQL).fetchall())
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_each_filter_keeps_all_links_and_drops_most_others():
    rows = [sets(t) for _, t in corpus(5, 200)]
    own = [shingles(t.encode(), 4) for _, t in corpus(5, 200)]
    for order in (lambda s: s, ngramjoin.second_order):
        first = [set(order(s)[: ngramjoin.spare(len(s)) + 1].tolist()) for s in own]
        meet = [(a, b) for a in range(len(rows)) for b in range(a) if first[a] & first[b]]
        true = {(a, b) for a in range(len(rows)) for b in range(a) if linked(rows[a], rows[b])}
        assert true <= set(meet) and len(meet) < len(rows) ** 2 / 8


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 100])
def test_shared_tokens_over_batches(cut):
    import pyarrow as pa

    rng = np.random.default_rng(cut)
    token, v = np.sort(rng.integers(0, 30, 60)), np.where(rng.random(60) < 0.2, -1, np.arange(60))
    own = np.flatnonzero(rng.random(60) < 0.2)
    token[own], v[own] = (own % 3 + 1) << 20 | 5, -2 - own
    order = np.argsort(token, kind="stable")
    whole = pa.record_batch([pa.array(token[order]), pa.array(v[order])], names=["token", "v"])
    out = [(n, k) for b in ngramjoin.shared(whole.slice(i, cut) for i in range(0, 60, cut)) for n, k in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    keyed = [t for t, k in zip(token, v, strict=True) if k >= -1]
    assert sorted(out) == sorted([(int(i), int(i) % 3 + 1) for i in own] + [(int(k), 1) for t, k in zip(token, v, strict=True) if k >= 0 and keyed.count(t) > 1])


def test_odd_rows(spark):
    words = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, words), (6, words), (7, words + " more"), (None, "a"), (None, ""), (None, "only here"), (9, "a b c"), (8, "a\tB\x0bc")]
    df = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], SCHEMA)
    assert got(df) == brute(rows)
    assert ngramjoin.classes(df.limit(0)).count() == 0
    assert got(df.where("doc_id = 1")) == [(1, 0, 1)]
