import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortline.operators import dims, metrics, ranks
from cohortline.operators.filters import FilterSpec
from cohortline.operators.metrics import Metric
from cohortline.plans import catalog, star


@pytest.mark.parametrize(("buckets", "few"), [(4, 1), (7, 5), (4096, 10_000)])
def test_median_by_ranks(spark, buckets, few):
    rng = random.Random(few)
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.choice([1.5, 2.5]), 10.0 ** rng.randint(-9, 9)])) for g in (1, 2, None) for _ in range(rng.choice([1, 2, 300, 301]))]
    rows += [(3, 7.0)] * 50 + [(4, None), (5, 1.0), (5, float("nan")), (5, float("inf")), (5, 2.0), (6, -1e300), (6, 1e300)]
    got = {r.g: r.value for r in ranks.median_by_ranks(spark.createDataFrame(rows, "g int, x double"), "g", F.col("x"), buckets, few).collect()}
    want = {}
    for g, v in rows:
        if v is not None and abs(v) < float("inf"):
            want.setdefault(g, []).append(v)
    assert got == pytest.approx({g: statistics.median(v) for g, v in want.items()}) and 4 not in got
    assert ranks.median_by_ranks(spark.createDataFrame([], "g int, x double"), "g", F.col("x")).count() == 0


def test_a_million_distinct_values_of_a_year(spark):
    """No task holds them: they are counted in buckets, and at most ``FEW`` are sorted."""
    facts = spark.range(1_000_000).select(F.lit(2020).alias("year"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) * 1.25).alias("x"))
    df = ranks.median_by_ranks(facts, "year", F.col("x"))
    values = sorted(i * 7919 % 1_000_003 * 1.25 for i in range(1_000_000))
    assert df.first().value == (values[499_999] + values[500_000]) / 2
    assert "percentile" not in df._jdf.queryExecution().toString()


def test_many_series_in_one_scan(spark, sf_dir):
    plan = catalog.many_series(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("lineitem.parquet") == 1 and plan.count("FileScan") == len({"lineitem", "orders", "customer", "nation", "region", "part"})
    facts = star.registrations(spark, sf_dir, "year")
    with pytest.raises(ValueError, match="median"):
        metrics.many(facts, {"m": (FilterSpec(), Metric("median", "net_mass"))}, star.YEARS)
    with pytest.raises(ValueError, match="at most"):
        metrics.many(facts, {str(k): (FilterSpec(), Metric()) for k in range(63)}, star.YEARS)


def test_many_series_with_nulls_and_nothing(spark):
    facts = spark.createDataFrame([(2000, None, 1.0), (2000, "R", None), (2001, "R", None)], "year int, fuel_type string, net_mass double")
    of = {"a": (FilterSpec(fuels=("R",)), Metric()), "b": (FilterSpec(), Metric("average", "net_mass")), "c": (FilterSpec(fuels=()), Metric()), "d": (FilterSpec(), Metric("missing", "net_mass"))}
    got = sorted(map(tuple, metrics.many(facts, of, star.YEARS).collect()))
    assert got == [("a", 2000, 1.0), ("a", 2001, 1.0), ("b", 2000, 1.0), ("d", 2000, 1.0), ("d", 2001, 1.0)]
    assert metrics.many(facts.limit(0), of, star.YEARS).count() == 0


def test_all_lists_in_one_scan(spark, sf_dir):
    plan = catalog.QUERIES["licence_lists"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("orders.parquet") == 1


def test_ids_are_given_by_all_tasks(spark):
    facts = spark.range(5000).select(F.format_string("v%05d", F.col("id")).alias("v"))
    existing = spark.createDataFrame([(7, "v00003"), (2, "v00001")], "id int, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = dims.surrogate_ids(existing, facts, "v")
        rows = {r.v: r.id for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = [f"v{k:05d}" for k in range(5000) if k not in (1, 3)]
    assert rows == {"v00003": 7, "v00001": 2} | {v: 8 + k for k, v in enumerate(want)}
    assert dims.surrogate_ids(existing, facts.limit(0), "v").count() == 2
