"""Every registered query beside its SQL, on the smallest tables."""

import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cohortline.functions import similarity
from cohortline.operators import filters, metrics, resolve
from cohortline.plans import catalog, star

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str(tuple(round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), names)


def jaro_winkler(a, b):
    """By the definition: matches within the window, half the transpositions, a prefix of four; equal strings only if the window is 0."""
    if a == b:
        return 1.0
    window = max(len(a), len(b)) // 2 - 1
    if window <= 0:
        return 0.0
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    second = [y for y, u in zip(b, used, strict=True) if u]
    m = len(first)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = len(os.path.commonprefix([a[:4], b[:4]]))
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dictionaries(con):
    known = con.execute("select distinct p_brand, p_name from part").fetchall()
    return sorted({(m, n[:4] + "0" + n[5:]) for m, n in known}), known


def test_jaro_winkler_against_brute_force(spark, con, sf_dir):
    unknown, known = dictionaries(con)
    want = {(a, b): round(jaro_winkler(a.upper(), b.upper()), 6) for m, a in unknown for k, b in known if m == k}
    got = {(r.model, r.canonical_model): r.score for r in catalog.QUERIES["jaro_winkler"](spark, sf_dir).collect()}
    assert got == pytest.approx(want, abs=1e-6) and want


def test_blocked_matches_against_brute_force(spark, con, sf_dir):
    unknown, known = dictionaries(con)
    want = {}
    for m, a in unknown:
        found = []
        for k, b in known:
            if m.upper() == k.upper():
                same = a.replace("-", "") == b.replace("-", "") and a != b
                score = 0.99 if same else 0.4 * (1 - edits(a.upper(), b.upper()) / max(len(a), len(b))) + 0.6 * jaro_winkler(a.upper(), b.upper())
                if score >= 0.75:
                    found.append((-score, k, b))
        if found:
            want[m, a] = (min(found)[1:], round(-min(found)[0], 6))
    got = {(r.make, r.model): ((r.canonical_make, r.canonical_model), r.score) for r in catalog.QUERIES["best_match_blocked"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def test_similarity_runs_no_python(spark, sf_dir):
    for name in ("jaro_winkler", "best_match_blocked"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_jaro_winkler_of_odd_strings(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcDé", k=rng.randint(0, 12)))
    rows = [(word(), word()) for _ in range(400)] + [("", ""), ("", "a"), ("ab", "ba"), ("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s"), similarity.jaro_winkler_most(F.col("a"), F.col("b")).alias("most")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.s is None
        else:
            assert r.s == pytest.approx(jaro_winkler(r.a.upper(), r.b.upper())) and r.s <= r.most + 1e-9


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_no_close_pair_is_missed(spark, least):
    rng = random.Random(2)
    a, b = ({"".join(rng.choices("abC", k=rng.randint(0, 9))) for _ in range(150)} | {"", "Volvo", "mercedes-benz"} for _ in range(2))
    got = resolve.close_strings(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), least)
    want = {(x, y) for x in a for y in b if (1 - edits(x.upper(), y.upper()) / max(len(x), len(y)) if x or y else 1.0) >= least}
    assert {tuple(r) for r in got.collect()} == want
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_candidates_are_few(spark):
    """On 1,600 codes against 1,600, each with one letter changed, less than a tenth of the product is compared."""
    known = star.read(spark, "/root/testdata/sf0.01", "part").select(F.concat("p_brand", "p_name").alias("b")).distinct()
    n = known.count()
    unknown = known.select(F.concat(F.substring("b", 1, 12), F.lit("0"), F.substring("b", 14, 99)).alias("a")).distinct()
    x, y = resolve.indexed(resolve.spelled(unknown, F.col("a")), resolve.spelled(known, F.col("b")))
    for level in (0.95, 0.85):
        assert resolve.meeting(x, y, level).distinct().count() < n * unknown.count() / 10


def test_best_match_makes_no_product(spark, sf_dir):
    plan = catalog.QUERIES["best_match_concat"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_levels_give_the_best_of_all(spark):
    """Codes whose best match is at any level, some without one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 14)))
    known = [("M", word()) for _ in range(60)]
    unknown = [("M", "".join(c if rng.random() > share else rng.choice("abcxyz") for c in m)) for _, m in known for share in (0.05, 0.3, 0.6)] + [("ZZZZZZZZZZ", "0000000000")]
    want = {}
    for u in set(unknown):
        near = [(-(1 - edits("".join(u).upper(), "".join(k).upper()) / max(len("".join(u)), len("".join(k)))), *k) for k in set(known)]
        if -min(near)[0] >= 0.4:
            want[u] = min(near)[1:]
    df = resolve.best_joined(spark.createDataFrame(unknown, "make string, model string").distinct(), spark.createDataFrame(known, "canonical_make string, canonical_model string").distinct())
    assert {(r.make, r.model): (r.canonical_make, r.canonical_model) for r in df.collect()} == want and len(want) < len(set(unknown))


def test_every_query_has_sql_or_brute_force():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"jaro_winkler", "best_match_blocked"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["year", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_are_known_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 140 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0], timeout=100)


def test_plans_reach_the_scan(spark, sf_dir):
    """Only the tables and columns that a query needs are read, and a mapped filter joins without multiplying facts."""
    plan = catalog.QUERIES["count_by_year"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and "customer" not in plan and "l_quantity" not in plan
    spec = filters.FilterSpec(types=("PROMO",), regularize=True)
    facts = star.registrations(spark, sf_dir, *spec.columns())
    twice = star.mapping(spark, sf_dir).union(star.mapping(spark, sf_dir))
    one = metrics.query(facts, spec, metrics.Metric(), star.YEARS, star.mapping(spark, sf_dir))
    assert sorted(map(tuple, metrics.query(facts, spec, metrics.Metric(), star.YEARS, twice).collect())) == sorted(map(tuple, one.collect()))
