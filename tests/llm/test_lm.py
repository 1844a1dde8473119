import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cohortline.llm import catalog, lm

SCHEMA = "doc_id long, text string, score string, same int, h long"
END = "</end>"


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [END]


def base(rows):
    """Exact base scores by the definition."""
    train = Counter(w for i, t in rows for w in tokens(t) if zlib.crc32(str(i).encode()) % 10 != 0)
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        own = tokens(t)
        out.setdefault(i, []).append((zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def compare(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert r.score <= 0
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = catalog.op9_lm_scores(spark, sf_dir)
    compare(df, base(rows))
    held = df.where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def model_scores(rows):
    """The model's scores by its definition, with dictionaries in place of the filter."""
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    words, seen = Counter(w for t in train for w in t), Counter()
    seen.update((u, v) for t in train for u, v in zip(["<s>", *t], t, strict=False))
    times = Counter({"<s>": len(train)}) + words
    least = max(8, (sum(len((t or "").encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0) // 2 + 2 * len(train)) // lm.HOT)
    kind = lambda n: 0 if n < least else (n // least).bit_length()
    after, single = Counter(), Counter()
    for u in times.keys() - {END}:  # nothing follows the end
        after[kind(times[u])] += times[u]
    for (u, _), n in seen.items():
        single[kind(times[u])] += n == 1
    low, high = 1e-3, 1e6
    for _ in range(200):  # after rare words new pairs come as often as pairs that were seen once
        k = math.sqrt(low * high)
        low, high = (k, high) if sum(n * k / (n + k) for u, n in times.items() if u != END and n < least) < single[0] else (low, k)
    k = low if any(n < least for u, n in times.items() if u != END) else 1.0
    h = {w: np.uint64(xxhash.xxh64_intdigest(w.encode())) for w in times} | {"<s>": lm.START, END: lm.END}
    n, v = sum(words.values()), len(words)

    def probability(u, w):
        alone = (words[w] + 0.1) / (n + 0.1 * (v + 1))
        if not times[u]:
            return alone
        both = 0
        if seen[u, w]:
            key = lm.pairs(np.array([h[u]]), np.array([h[w]]), np.array([kind(times[u])]))
            both = min(int(lm.VALUE[lm.quantised(key, np.array([seen[u, w]]))[0]]), times[u], words[w])
        x = times[u] / (times[u] + k) if times[u] < least else min(0.95, max(1e-3, 1 - single[kind(times[u])] / after[kind(times[u])]))
        return x * both / times[u] + (1 - x) * alone

    return [(i, sum(math.log10(probability(u, w)) for u, w in zip(["<s>", *tokens(t)], tokens(t), strict=False))) for i, t in rows], probability, times, words


def small_corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(vocabulary, [1 / k for k in range(1, 41)], k=rng.randint(0, 60)))) for i in range(300)]


def test_score_against_the_definition(spark):
    rows = small_corpus() + [(1000, "never w1 seen w2"), (1001, "w1 w2"), (1001, "w1 w2")]
    want, probability, times, words = model_scores(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, model = lm.count(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").select("text"), bits_a_level=80)  # a filter that hardly errs
    got = {i: s for (i, t) in rows for s in model.score([t.encode()], model.times_of, model.value_of)[3].tolist()}
    for i, s in want:
        assert got[i] == pytest.approx(s, rel=1e-9)
    # over all words and one unknown word a word's continuations make 1 on average, and exactly where no count is rounded
    sums = {u: sum(probability(u, w) for w in [*words, "unknown"]) for u in times if u != END}
    assert np.average(list(sums.values()), weights=[times[u] for u in sums]) == pytest.approx(1, abs=0.01)
    assert sum(probability("unknown", w) for w in [*words, "unknown"]) == pytest.approx(1, rel=1e-12)


@pytest.mark.parametrize("routed", [False, True])
def test_scores_do_not_depend_on_how_rows_lie(spark, sf_dir, monkeypatch, routed):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    found = []
    for parts, flush in ((1, 1_000_000), (8, 3_000), (64, 500)):
        monkeypatch.setattr(lm, "FLUSH", flush)
        df = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), most_words=0 if routed else lm.MOST_WORDS)
        found.append(sorted((r.doc_id, r.base_score, r.score) for r in df.collect()))
    assert np.allclose(found[0], found[1], rtol=1e-9) and np.allclose(found[0], found[2], rtol=1e-9)


def test_prior_makes_as_many_new_pairs_as_come_once():
    rng = np.random.default_rng(1)
    times = rng.zipf(1.5, 5000).clip(max=10**9)
    times = times[times < 200]
    k = lm.prior(np.bincount(lm.binned(times, 200), minlength=lm.BINS), np.bincount(lm.binned(times, 200), times, lm.BINS), 4000)
    assert (times * k / (times + k)).sum() == pytest.approx(4000, rel=1e-6)
    assert lm.binned(np.array([1, 99_999]), 100_000).tolist() == [1, lm.BINS - 1]
    assert lm.classes(np.array([0, 9, 10, 19, 20, 39, 40, 10**12]), 10).tolist() == [0, 0, 1, 1, 2, 2, 3, lm.CLASSES - 1]


def test_hot_keys_are_not_asked_for(spark, monkeypatch):
    """Every text has the same words: a segment gets no row of them."""
    asked = []
    group = type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *c: (asked.append(self) if c == ("segment",) and "slice" in self.columns else None, group(self, *c))[1])
    monkeypatch.setattr(lm, "LEAST_HOT", 40)
    docs = spark.createDataFrame([(i, f"the same words again {i}") for i in range(600)], "doc_id long, text string").repartition(40)
    want = sorted(map(tuple, lm.score(docs).collect()))
    got = sorted(map(tuple, lm.score(docs, most_words=0).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-12)
    assert asked and asked[0].groupBy("kind", "key").count().agg({"count": "max"}).first()[0] <= 2
    monkeypatch.setattr(lm, "LEAST_HOT", 10_000)  # nothing is hot: all slices ask for the same words
    asked.clear()
    lm.score(docs, most_words=0).collect()
    assert asked[0].groupBy("kind", "key").count().agg({"count": "max"}).first()[0] >= 40


def test_exactly_one_where_no_count_is_rounded(spark):
    rows = [(i, "a b c d" if i % 2 else "b a d") for i in range(3)]
    _, probability, times, words = model_scores(rows)
    for u in times.keys() - {END}:
        assert sum(probability(u, w) for w in [*words, "unknown"]) == pytest.approx(1, rel=1e-12)


def test_rounded_counts_have_the_right_mean():
    keys = np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64)
    for n in (1, 2, 5, 7, 100, 12_345):
        assert lm.VALUE[lm.quantised(keys, np.full(len(keys), n))].mean() == pytest.approx(n, rel=0.005)


def test_saturated_filter_never_gives_more_than_one(spark):
    docs = spark.createDataFrame(small_corpus(), "doc_id long, text string")
    _, model = lm.count(docs.select("text"))
    model.bits = np.full_like(model.bits, 255)
    assert max(model.score([t.encode() for _, t in small_corpus()], model.times_of, model.value_of)[3]) <= 0


@pytest.mark.parametrize("dealt", [8, 2])
def test_model_beyond_broadcast_scores_the_same(spark, sf_dir, monkeypatch, dealt):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7, None), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "FLUSH", 3_000)
    monkeypatch.setattr(lm, "PER_SEGMENT", 1_000)
    monkeypatch.setattr(lm, "PER_TASK", 10_000)
    monkeypatch.setattr(lm, "DEALT", 8)
    whole = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "DEALT", dealt)  # several exchanges, none more than four rows a flush and kind
    compare(lm.score(docs, most_words=0), base(rows))
    parts = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, most_bits=0).collect())
    assert np.allclose(np.array(whole), np.array(parts), rtol=1e-12)


def test_filter_never_counts_less_and_errs_rarely():
    rng = np.random.default_rng(1)
    keys, n = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2), rng.geometric(0.3, 5000)
    level = lm.quantised(keys, n)
    bits = np.frombuffer(lm.filter_of(keys, level), np.uint8)
    whole = np.zeros(5000, np.uint64), np.full(5000, len(bits) * 8, np.uint64), bits
    found = lm.levels(keys, *whole)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (lm.levels(keys + np.uint64(1), *whole) > 0).mean() < 0.05
    assert [int(x) for x in lm.VALUE[:7]] == [0, 1, 2, 3, 4, 6, 8]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b\x0bc " * 30_000), (4, "a"), (4, "a"), (5, "é É"), (None, "a b")]
    df = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in lm.score(df).collect())
    assert got == [(-1, 3), (1, 1), (2, 1), (3, 90_001), (4, 2), (4, 2), (5, 3)]
    assert lm.score(df.limit(0)).count() == 0
    nothing = lm.score(df.where("doc_id is null")).first()
    assert (nothing.held_out, nothing.n_known, nothing.train_tokens) == (True, 0, 0)
    assert lm.score(df, most_words=0).count() == 7
