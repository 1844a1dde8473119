"""Yearly metrics over filtered facts: one aggregation by year each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import Years
from .filters import FEW_MODELS, FilterSpec, age, apply, predicates
from .ranks import median_by_ranks
from .wear import Wear

#: Aggregates over a field; the median is exact.
AGGREGATES = {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max, "median": F.median}


@dataclass(frozen=True)
class Metric:
    """``kind``: count, one of ``AGGREGATES``, coverage, missing, or wear_average, wear_sum, wear_median.

    ``field`` is a column or ``age``; an aggregate without a field is a count.
    """

    kind: str = "count"
    field: str | None = None
    wear: Wear = Wear()

    def value(self) -> Column | None:
        if self.kind.startswith("wear_"):
            return self.wear.index()
        if self.field is None:
            return None
        return age() if self.field == "age" else F.col(self.field)

    def columns(self) -> set[str]:
        if self.kind.startswith("wear_"):
            return {"max_axles", "vehicle_type", "net_mass", "year"}
        return {"year"} | ({"model_year"} if self.field == "age" else {self.field} if self.field else set())

    def aggregate(self) -> tuple[Column, Column | None]:
        """The aggregate and the condition on the rows that enter it."""
        v = self.value()
        if self.kind == "coverage":
            return F.count(v).cast("double") / F.count(F.lit(1)).cast("double") * 100, None
        if self.kind == "missing":
            return F.count(F.lit(1)) - F.count(v), None
        if self.kind == "count" or v is None:
            return F.count(F.lit(1)), None
        kind = self.kind.removeprefix("wear_")
        guard = F.col("net_mass").isNotNull() if self.kind.startswith("wear_") else v.isNotNull()
        return AGGREGATES[kind](v.cast("double")), guard


def by_year(facts: DataFrame, metric: Metric) -> DataFrame:
    """``(year, value)`` with a double value, a row per year that has rows."""
    value, guard = metric.aggregate()
    facts = facts if guard is None else facts.where(guard)
    return facts.groupBy("year").agg(value.cast("double").alias("value"))


def query(facts: DataFrame, spec: FilterSpec, metric: Metric, config: Years, mapping: DataFrame | None = None) -> DataFrame:
    """A chart query: filters, then the metric of each year."""
    return by_year(apply(facts, spec, config, mapping), metric)


def percentage(numerator: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two yearly series as a percentage; a year without a baseline is 0."""
    b = baseline.select("year", F.col("value").alias("base"))
    share = F.when(F.col("base") > 0, F.col("value") / F.col("base") * 100).otherwise(0.0)
    return numerator.join(b, "year", "left").select("year", F.coalesce(share, F.lit(0.0)).alias("value"))


def percentage_one_scan(facts: DataFrame, spec: FilterSpec, dropped: tuple[str, ...], config: Years) -> DataFrame:
    """The share of the rows of a baseline (``spec`` without some filters) that ``spec`` takes, in one pass over the facts."""
    both = apply(facts, spec.without(*dropped), config)
    inside = F.lit(True)
    for condition in predicates(spec, config):
        inside = inside & condition
    counted = both.groupBy("year").agg(F.count_if(inside).alias("n"), F.count(F.lit(1)).alias("base")).where("n > 0")
    return counted.select("year", (F.col("n").cast("double") / F.col("base").cast("double") * 100).alias("value"))


def median_of_years(facts: DataFrame, spec: FilterSpec, metric: Metric, config: Years, mapping: DataFrame | None = None) -> DataFrame:
    """A median chart for years of any size: by counting, where ``query`` keeps the distinct values of a year in a task."""
    _, guard = metric.aggregate()
    return median_by_ranks(apply(facts, spec, config, mapping).where(guard), "year", metric.value())


#: Series that one scan serves: a bit of a long each.
MOST_SERIES = 62


def many(facts: DataFrame, series: dict[str, tuple[FilterSpec, Metric]], config: Years) -> DataFrame:
    """``(series, year, value)`` of several chart queries in one scan of the facts and one shuffle.

    Each filter sets a bit of a row's mask.  Rows are summed up by year and mask, with the sums that the metrics need;
    there are few masks, so that a series then adds up those with its bit.  Filters with the mapping are joins
    and cannot be bits, and medians are no sums: these are refused, as are more than ``MOST_SERIES``.
    """
    if len(series) > MOST_SERIES or any(spec.regularize or metric.kind.endswith("median") for spec, metric in series.values()):
        raise ValueError(f"at most {MOST_SERIES} series, without the mapping and without medians")
    if any(spec.models and len(spec.models) > FEW_MODELS for spec, _ in series.values()):
        raise ValueError(f"a list of more than {FEW_MODELS} models is a join")
    mask, values = F.lit(0).cast("long"), {}
    for k, (spec, metric) in enumerate(series.values()):
        inside = F.lit(True)
        for condition in predicates(spec, config):
            inside = inside & F.coalesce(condition, F.lit(False))
        mask = mask.bitwiseOR(F.when(inside, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        v, (_, guard) = metric.value(), metric.aggregate()
        if v is not None:
            values[metric] = (f"v{k}", (v if guard is None else F.when(guard, v)))
    columns = {name: v.cast("double") if not m.kind in ("coverage", "missing") else v for m, (name, v) in values.items()}
    states = [F.count(F.lit(1)).alias("n")]
    for name in columns:
        own = F.col(name)
        states += [F.count(own).alias(f"{name}_n")]
    for m, (name, _) in values.items():
        if m.kind not in ("coverage", "missing"):
            states += [F.sum(name).alias(f"{name}_s"), F.min(name).alias(f"{name}_a"), F.max(name).alias(f"{name}_b")]
    rows = facts.select("year", mask.alias("mask"), *[v.alias(name) for name, v in columns.items()]).where("mask <> 0")
    summed = rows.groupBy("year", "mask").agg(*states)
    names = list(series)
    spread = summed.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)))
    added = [F.sum("n").alias("n")]
    for m, (name, _) in values.items():
        added.append(F.sum(f"{name}_n").alias(f"{name}_n"))
        if m.kind not in ("coverage", "missing"):
            added += [F.sum(f"{name}_s").alias(f"{name}_s"), F.min(f"{name}_a").alias(f"{name}_a"), F.max(f"{name}_b").alias(f"{name}_b")]
    whole = spread.groupBy("k", "year").agg(*added)
    value = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, (_, metric) in enumerate(series.values()):
        n, own = F.col("n").cast("double"), values.get(metric, (None,))[0]
        kind = metric.kind.removeprefix("wear_")
        if own is None:
            of = n
        elif kind == "coverage":
            of = F.col(f"{own}_n").cast("double") / n * 100
        elif kind == "missing":
            of = n - F.col(f"{own}_n")
        else:
            of = {"sum": F.col(f"{own}_s"), "average": F.col(f"{own}_s") / F.col(f"{own}_n"), "minimum": F.col(f"{own}_a"), "maximum": F.col(f"{own}_b")}.get(kind, n)
            of = F.when(F.col(f"{own}_n") > 0, of)  # a year without values has no point
        value = value.when(F.col("k") == k, of)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("k") + 1)
    return whole.select(name.alias("series"), "year", value.alias("value")).where("value is not null")


def percentages(points: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """From the points of ``many``: ``(series, year, value)``, one series as a percentage of another for each name; a year without a baseline is 0."""
    out = None
    for name, (numerator, baseline) in of.items():
        pick = F.max(F.when(F.col("series") == numerator, F.col("value"))).alias("value"), F.max(F.when(F.col("series") == baseline, F.col("value"))).alias("base")
        both = points.where(F.col("series").isin(numerator, baseline)).groupBy("year").agg(*pick).where("value is not null")
        one = both.select(F.lit(name).alias("series"), "year", F.when(F.col("base") > 0, F.col("value") / F.col("base") * 100).otherwise(0.0).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
