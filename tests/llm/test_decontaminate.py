import random
import re
import time

import duckdb
import pytest

from cohortline.llm import catalog, decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id string, same int, leak string, item int", "item_id long, text string, doc_id string, n int"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, items, share=0.8):
    out = {}
    for d, t in docs:
        for i, x in items:
            own = grams(x)
            n = len(own & grams(t))
            if own and n >= share * len(own) - 1e-9:
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(own)))
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.shared, r.shingles) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    item = "a b c d e f g h i j k l m n"  # ten shingles
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [
        (1, f"{long} {item.upper()}!! {long}"), (2, "A, b; c d e f g h i j k l x n"), (3, "a b c d e f g h i j k l m"), (4, item[:20]), (5, None), (6, ""), (7, "short item"), (7, "Short  ITEM."),
        (8, "the short item"), (None, item), (9, item), (9, "else"), (10, "É é " + item), (11, item + " " + item), (12, " ".join(item.split()[:9]) + " zz " + " ".join(item.split()[5:])),
    ]
    items = [(1, item), (2, "short item"), (3, None), (4, ""), (5, item + " . "), (6, "one two three four five"), (6, item)]
    return docs, items, spark.createDataFrame([(d, t, "x", 1, None, 3) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "x", 2) for i, t in items], ITEMS)


def test_cases_against_brute_force(tables):
    docs, items, d, i = tables
    want = brute(docs, items)
    assert (1, 1) in want and (7, 2) in want and (8, 2) not in want and (None, 1) in want
    assert found(decontaminate.report(d, i)) == want


def test_shuffled_sketches_give_the_same(tables):
    docs, items, d, i = tables
    assert found(decontaminate.report(d, i, most_rows=0, most_leaks=0)) == brute(docs, items)


def test_items_of_all_sizes_and_documents_short_and_long(spark):
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choices(pool, k=n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 14, 30, 70, 200, 900] * 3)]
    docs = []
    for k in range(300):
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = "zz"
        docs.append((k, " ".join(rng.choices(pool, k=rng.choice([0, 3, 500])) + own + rng.choices(pool, k=rng.choice([0, 3, 500])))))
    got = found(decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len({n for _, n in got.values()}) > 5


def test_a_candidate_is_met_by_class_and_hash_and_found_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, 7, text), (2, 8, "w1 w2 w3 w4 w5")], "doc long, same long, text string")
    items = spark.createDataFrame([(1, text), (2, "w1 w2 w3 w4 w5"), (3, "else")], "item_id long, text string")
    _, sketch = decontaminate.sketches(items, 0.8, 5, "item_id", "text")
    assert {r.size_class for r in sketch.collect()} == {0, 5}
    got = decontaminate.candidates(docs, sketch, 5, 1000).collect()
    assert sorted((r.doc, r.item) for r in got) == [(1, 1), (1, 2), (2, 2)]  # the short one is too short for class 5


def test_long_items_take_time_in_proportion(spark):
    text = " ".join(f"w{k}" for k in range(20_000))
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, item_id long, text string")
    start = time.monotonic()
    assert found(decontaminate.report(df, df)) == {(1, 1): (19_996, 19_996)}
    assert time.monotonic() - start < 30


def test_whole_table_against_brute_force(spark, sf_dir):
    d, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])
    got = catalog.op2_decontamination(spark, sf_dir)
    assert found(got) == want and want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert {(r[0], r[1]) for r in con.execute(catalog.OP2_SQL).fetchall()} == set(want)


def test_rows_kept_are_unchanged(spark, tables):
    docs, items, d, i = tables
    leaks = {k[0] for k in brute(docs, items)}
    kept = decontaminate.keep_clean(d, i)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(x or 0 for x, t in docs if (x not in leaks) or (x == 9 and t == "else"))


def test_empty_tables_and_plan(spark, tables):
    _, _, d, i = tables
    assert decontaminate.report(d.limit(0), i).count() == 0
    assert decontaminate.report(d, i.limit(0)).count() == 0
    assert decontaminate.keep_clean(d, i.limit(0)).count() == d.count()
    plan = decontaminate.report(d, i)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
