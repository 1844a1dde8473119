"""Aggregates kept by year: only years that an import has changed are read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import Years
from ..operators.mapping import PAIR
from ..sources import store

#: What the kept tables count rows by: the hierarchy's groups, from which pairs, statistics and lists follow too.
GROUPS = ["make", "model", "model_year", "fuel_type", "vehicle_type"]


def groups_of_year(facts: DataFrame) -> DataFrame:
    """Rows of each year by the hierarchy's groups."""
    return facts.groupBy("year", *GROUPS).agg(F.count(F.lit(1)).alias("n"))


def versions(log: DataFrame) -> DataFrame:
    """``(year, version)``: a year's last import by the log, and how many it has had."""
    return log.groupBy("year").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.max("import_date").cast("string"), F.max_by("record_count", "import_date").cast("string")).alias("version"))


def changed(spark: SparkSession, log: DataFrame, place: str) -> tuple[list[int], list[int]]:
    """Years whose kept rows are not those of their last import, and kept years that the log has no more: metadata, a row a year."""
    now = {r.year: r.version for r in versions(log).collect()}
    kept = {r.year: r.version for r in spark.read.parquet(f"{place}/versions").collect()} if store.exists(spark, f"{place}/versions") else {}
    return sorted(y for y, v in now.items() if kept.get(y) != v), sorted(kept.keys() - now.keys())


def refresh(spark: SparkSession, facts: Callable[[list[int]], DataFrame], log: DataFrame, place: str, make: Callable[[DataFrame], DataFrame] = groups_of_year) -> list[int]:
    """Brings the aggregates under ``place`` up to the log and says which years it has read.

    ``facts`` gives the rows of some years, ``make`` their aggregates with a column ``year``.  Versions are forgotten
    before a year is written and noted after it, so that a refresh that is killed is done again by the next.
    """
    renewed, gone = changed(spark, log, place)
    if not renewed and not gone:
        return []
    known = spark.read.parquet(f"{place}/versions").where(~F.col("year").isin(renewed + gone)) if store.exists(spark, f"{place}/versions") else None
    if known is not None:
        note(spark, known, place)
    store.delete_years(spark, f"{place}/groups", tuple(gone))
    if renewed:
        made = make(facts(renewed))
        store.delete_years(spark, f"{place}/groups", tuple(renewed))  # a year without rows any more writes none
        made.repartition("year").write.mode("append").partitionBy("year").parquet(f"{place}/groups")
    note(spark, versions(log), place)
    return renewed


def note(spark: SparkSession, rows: DataFrame, place: str) -> None:
    beside = f"{place}/versions-new-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(beside)
    store.swap(spark, beside, f"{place}/versions")


def groups(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(f"{place}/groups")


def hierarchy(kept: DataFrame, config: Years) -> DataFrame:
    """``mapping.hierarchy`` from the kept groups: rows are summed, not counted."""
    return kept.where(F.col("year").isin(*config.curated)).groupBy(*GROUPS).agg(F.sum("n").alias("n"))


def uncurated_pairs(kept: DataFrame, config: Years) -> DataFrame:
    """``mapping.uncurated_pairs`` from the kept groups."""
    late, early = F.col("year").isin(*config.uncurated), F.col("year").isin(*config.curated)
    rows = kept.where("make is not null and model is not null").where(late | early).groupBy(*PAIR)
    pairs = rows.agg(F.min(F.when(late, F.col("year"))).alias("from_year"), F.max(F.when(late, F.col("year"))).alias("to_year"), F.sum(F.when(late, F.col("n"))).alias("n"), F.sum(F.when(early, F.col("n"))).alias("curated")).where("n > 0")
    joined = pairs.crossJoin(pairs.agg(F.sum("n").alias("total")))  # one row: the total
    return joined.select(*PAIR, "from_year", "to_year", "n", (F.col("n").cast("double") / F.col("total").cast("double") * 100).alias("share"), F.coalesce(F.col("curated") > 0, F.lit(False)).alias("is_exact_match"))


def detailed_stats(kept: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """``mapping.detailed_stats`` from the kept groups."""
    m = mapping.select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model"), "model_year", "vehicle_type", "fuel_type")
    pair = m.groupBy(*PAIR).agg(F.max(F.col("vehicle_type").isNotNull()).alias("typed"))
    fuel = m.where("model_year is not null and fuel_type is not null").select(*PAIR, "model_year").distinct().withColumn("fuelled", F.lit(True))
    late = kept.where(F.col("year").isin(*config.uncurated)).groupBy(*PAIR, "model_year").agg(F.sum("n").alias("n"))
    joined = late.join(pair, PAIR, "left").join(fuel, [*PAIR, "model_year"], "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return joined.agg(total(F.lit(True)).alias("n"), total(F.col("typed").isNotNull()).alias("mapped"), total(F.col("typed")).alias("with_type"), total(F.col("fuelled")).alias("with_fuel"))
