import random

import corpus_pipeline
from cohortline.llm import nearcopies
from cohortline.llm.common import components, cut


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def slow(rows):
    """The smallest id of each component, by all pairs."""
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(r[0] for r, x in zip(rows, label, strict=True) if x == y) for y in set(label))


def test_stage_against_brute_force_jaccard(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))]
        for copy in range(4):
            own = list(words)
            for i in rng.sample(range(len(own)), round(len(own) * rng.choice([0, 0.01, 0.02, 0.03]))):
                own[i] = "changed"
            rows.append((1000 - 4 * k - copy, " ".join(own)))
    rows += [(5, None), (6, ""), (7, "a b"), (8, "A  b"), (9, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == slow(rows)


def test_pairs_beyond_four_bits_are_found(spark, sf_dir):
    """On the test table documents 1 and 177 have a similarity of 0.83, their SimHash differs in 9 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == slow(rows)


def test_crowded_components_lose_no_link(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):
        base[rng.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = cut(nearcopies.sketches(df, "doc_id", "text"))
    node = {r.id: r.node for r in marked.collect()}
    for crowd in (8, 1024):
        label = {r.node: r.component for r in components(nearcopies.links(df, marked, "doc_id", "text", crowd)).collect()}
        assert len({label.get(x, x) for x in node.values()}) == len(slow(rows))


def test_rows_with_null_or_repeated_ids(spark):
    schema = "doc_id long, text string, i long, k long, low string"
    data = [(None, "one two"), (None, "one two"), (None, "other"), (4, "one two"), (4, "alone here"), (4, "alone here"), (9, "alone  here"), (3, "third")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in data], schema)
    kept = nearcopies.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "other"), (3, "third"), (4, "alone here"), (4, "one two")]
    assert nearcopies.keep_first(df.limit(0)).count() == 0
