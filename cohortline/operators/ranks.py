"""Exact medians of groups of any size: values are counted in buckets that close in on the middle ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Buckets that the values between two bounds are counted in, and values of a bucket that are sorted instead.
BUCKETS, FEW = 4096, 10_000


def bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """The number of a value's bucket between two bounds: larger values never have smaller numbers, and the bounds have different ones."""
    return F.when(value >= high, buckets - 1).otherwise(F.least(F.floor((value - low) / (high - low) * (buckets - 1)), F.lit(buckets - 2))).cast("int")


def median_by_ranks(facts: DataFrame, group: str, value: Column, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """``(group, value)``: the exact median of the values of each group that are not null, for groups of any size.

    One scan counts a group's values and finds their bounds.  Each further one counts the values between the bounds of a
    middle rank by bucket and takes the bounds of the bucket that has the rank, until these are equal or the bucket
    has few values, which the last scan sorts.  What a task holds is bounded by buckets and ``few``, whatever the
    number of distinct values: usually three scans are enough.

    Null values are passed over, NaN and infinite ones too; groups without values have no row; a null group is one.
    """
    rows = facts.select(F.col(group).alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    # a row for each group and middle rank: the bounds of the values it is among, their number, and how many are below
    open_ = written(sizes.select("g", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "n"))
    done = open_.where("low = high or n <= %d" % few)
    open_ = open_.where("low < high and n > %d" % few)
    while not open_.isEmpty():
        spans = open_.select(F.col("g").alias("h"), "low", "high").distinct()
        inside = rows.join(spans, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("g", "low", "high", bucket(F.col("v"), F.col("low"), F.col("high"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("new_low"), F.max("v").alias("new_high"))
        up_to = F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("b"))
        counts = counts.withColumn("up_to", up_to).withColumnsRenamed({"g": "h", "low": "l", "high": "k", "n": "m"})
        met = open_.join(counts, F.col("g").eqNullSafe(F.col("h")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("k")))
        met = met.where((F.col("below") + F.col("up_to") >= F.col("rank")) & (F.col("below") + F.col("up_to") - F.col("m") < F.col("rank")))
        found = written(met.select("g", "rank", F.col("new_low").alias("low"), F.col("new_high").alias("high"), (F.col("below") + F.col("up_to") - F.col("m")).alias("below"), F.col("m").alias("n")))
        done = done.unionByName(found.where("low = high or n <= %d" % few))
        open_ = found.where("low < high and n > %d" % few)
    known = done.where("low = high").select("g", F.col("low").alias("v"))
    spans = done.where("low < high").select(F.col("g").alias("h"), "rank", "low", "high", "below")
    inside = rows.join(spans, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
    number = F.row_number().over(Window.partitionBy("g", "rank").orderBy("v"))  # of few values
    sorted_ = inside.withColumn("at", number).where(F.col("at") == F.col("rank") - F.col("below")).select("g", "v")
    return known.unionByName(sorted_).groupBy("g").agg(F.avg("v").alias("value")).select(F.col("g").alias(group), "value")
