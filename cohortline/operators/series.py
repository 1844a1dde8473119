"""Transforms of yearly series ``(year, value)``.

A series has a row per year, so that windows over all of it are small; with ``by``, several series are
held in one frame and windows are partitioned by those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _window(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("year")


def zero_fill(points: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Exactly the given years: missing ones are 0, others go.  Without years the series stays as it is."""
    if not years:
        return points
    wanted = points.sparkSession.createDataFrame([(y,) for y in sorted(set(years))], "year int")
    return wanted.join(points, "year", "left").select("year", F.coalesce("value", F.lit(0.0)).alias("value"))


def normalise(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Values over the first year's, if that is over 0; else unchanged."""
    first = F.first("value").over(_window(by))
    return points.withColumn("value", F.when(first > 0, F.col("value") / first).otherwise(F.col("value")))


def cumulate(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Running totals by year."""
    return points.withColumn("value", F.sum("value").over(_window(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def transform(points: DataFrame, years: tuple[int, ...] | None = None, exclude_zeroes: bool = False, normalised: bool = False, cumulative: bool = False) -> DataFrame:
    """Zero-fill, then normalise, then cumulate: the order matters."""
    points = zero_fill(points, years) if years and not exclude_zeroes else points
    points = normalise(points) if normalised else points
    return cumulate(points) if cumulative else points


def statistics(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, mean, median, extremes, range, sample deviation (0 for one point), change from the first to the last year and yearly growth."""
    v = F.col("value")
    out = points.groupBy(*by).agg(
        F.count("value").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"), F.min_by(v, "year").alias("first"), F.max_by(v, "year").alias("last"), (F.max("year") - F.min("year")).alias("span"),
    )
    change = F.col("last") - F.col("first")
    growth = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("span") > 0), (F.pow(F.col("last") / F.col("first"), 1.0 / F.col("span")) - 1) * 100)
    return out.withColumns({"range": F.col("high") - F.col("low"), "change": change, "change_pct": F.when(F.col("first") != 0, change / F.col("first") * 100), "growth_pct": growth})


def ordered(points: DataFrame, column: str = "year", descending: bool = False) -> DataFrame:
    return points.orderBy(F.desc(column) if descending else F.asc(column), "year")


def axis(points: DataFrame, by: tuple[str, ...] = (), steps: int = 5) -> DataFrame:
    """Bounds of a chart's axes: years, values from 0 (or below) with a tenth of room, and a stride of 1, 2 or 5 times a power of ten."""
    out = points.groupBy(*by).agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"), F.least(F.min("value"), F.lit(0.0)).alias("low"), F.max("value").alias("most"))
    high = F.when(F.col("most") > 0, F.col("most") * 1.1).otherwise(F.lit(1.0))
    raw = (high - F.col("low")) / steps
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = F.when(raw / power <= 1, 1.0).when(raw / power <= 2, 2.0).when(raw / power <= 5, 5.0).otherwise(10.0)
    return out.select(*by, "from_year", "to_year", "low", high.alias("high"), (unit * power).alias("stride"))
