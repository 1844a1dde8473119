"""Profiling queries over the registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import age


def availability(facts: DataFrame, *fields: str) -> DataFrame:
    """Rows, rows with each field, and distinct values of it, by year."""
    counts = [c for f in fields for c in (F.count(f).alias(f"with_{f}"), F.count_distinct(f).alias(f"distinct_{f}"))]
    return facts.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *counts)


def fingerprint(facts: DataFrame, least: int = 50, model_like: str | None = None) -> DataFrame:
    """Mean mass, cylinders and displacement and the range of model years by make, model, class and fuel, of groups over ``least`` rows."""
    facts = facts if model_like is None else facts.where(F.col("model").like(model_like))
    out = facts.groupBy("make", "model", "vehicle_class", "fuel_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("net_mass"), 1).alias("mass"), F.round(F.avg("cylinder_count"), 1).alias("cylinders"),
        F.round(F.avg("displacement"), 1).alias("displacement"), F.min("model_year").alias("from_model_year"), F.max("model_year").alias("to_model_year"),
    )
    return out.where(F.col("n") > least)


def alphanumeric_by_class(facts: DataFrame) -> DataFrame:
    """Distinct models with and without digits by class."""
    models = facts.select("vehicle_class", "model").distinct()
    digit = F.col("model").rlike("[0-9]")
    return models.groupBy("vehicle_class").agg(F.count_if(digit).alias("with_digits"), F.count_if(~digit).alias("without_digits"))


def year_histogram(facts: DataFrame, least: int = 100, top: int | None = None) -> DataFrame:
    """Rows by registration year and model year, of groups over ``least`` rows, the largest ``top`` of them."""
    out = facts.groupBy("year", "model_year").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return out if top is None else out.orderBy(F.desc("n"), "year", "model_year").limit(top)


def model_year_range(facts: DataFrame) -> DataFrame:
    return facts.groupBy("make", "model").agg(F.min("model_year").alias("low"), F.max("model_year").alias("high"), F.count_distinct("model_year").alias("distinct_years"), F.count(F.lit(1)).alias("n"))


def age_distribution(facts: DataFrame, low: int = -1, high: int = 10) -> DataFrame:
    """Rows by age at registration, with the share of all rows that have a model year, in percent to two decimals: one pass."""
    ages = facts.where("model_year is not null").groupBy(age().alias("age")).agg(F.count(F.lit(1)).alias("n"))
    total = ages.agg(F.sum("n").alias("total"))
    return ages.crossJoin(total).where(F.col("age").between(low, high)).select("age", "n", F.round(F.col("n").cast("double") * 100 / F.col("total").cast("double"), 2).alias("share"))


def first_last_seen(facts: DataFrame, since: int) -> DataFrame:
    """First and last years of models first seen in ``since`` or later."""
    return facts.groupBy("make", "model").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n")).where(F.col("first_year") >= since)


def model_evolution(facts: DataFrame, make: str) -> DataFrame:
    """Rows of a make's models by year and model year."""
    return facts.where(F.col("make") == make).groupBy("model", "year", "model_year").agg(F.count(F.lit(1)).alias("n"))


def future_model_years(facts: DataFrame) -> DataFrame:
    """Rows whose model year is after the year of registration."""
    return facts.where(F.col("model_year") > F.col("year")).groupBy("year", "model_year").agg(F.count(F.lit(1)).alias("n"))


def classes_of_pairs(facts: DataFrame) -> DataFrame:
    """Classes of each pair in one sorted list, and its years."""
    return facts.groupBy("make", "model").agg(F.array_join(F.array_sort(F.collect_set("vehicle_class")), ",").alias("classes"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))


def reference_stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count_distinct("make").alias("makes"), F.count_distinct("model").alias("models"), F.count_distinct("ref_type").alias("types"), F.count(F.lit(1)).alias("n"))
