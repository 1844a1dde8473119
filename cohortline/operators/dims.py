"""Value lists of the dimensions, with display names, and counts of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import LICENCE_CLASSES, Years
from ..sources.store import written


def values(facts: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are not null."""
    return facts.where(F.col(column).isNotNull()).select(column).distinct()


def years_of(*facts: DataFrame) -> DataFrame:
    """Years that any of the fact tables has."""
    out = facts[0].select("year")
    for other in facts[1:]:
        out = out.union(other.select("year"))
    return out.distinct()


def display(name: Column, code: Column) -> Column:
    """``Name (code)``."""
    return F.concat(name, F.lit(" ("), code, F.lit(")"))


def unlisted(name: Column, code: Column) -> Column:
    """A place whose name is not known is ``Unlisted (code)``."""
    return F.when(F.coalesce(name == code, F.lit(True)), display(F.lit("Unlisted"), code)).otherwise(display(name, code))


def named(codes: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """Codes with their names, a code without one under itself."""
    return codes.join(names.select(code, name), code, "left").withColumn(name, F.coalesce(name, F.col(code).cast("string")))


def resolve(dimension: DataFrame, key: str, value: str, fuzzy: bool = False) -> DataFrame:
    """Rows of a dimension that a value means: equal, else equal without outer spaces, else (if ``fuzzy``) the first, by id, that holds it."""
    c = F.col(key)
    rank = F.when(c == value, 0).when(F.trim(c) == value.strip(), 1)
    rank = rank.when(F.contains(F.lower(c), F.lit(value.lower())), 2) if fuzzy else rank
    ranked = dimension.withColumn("_rank", rank).where("_rank is not null")
    return ranked.orderBy("_rank", "id").limit(1).drop("_rank")


def surrogate_ids(existing: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """A dimension ``(id, column)`` with an id for each new value, after the largest one, in order of the values.

    Distinct new values are sorted over all tasks and written; a value's number is its place in its part after the
    sizes of the parts before.  Facts keep their natural keys.
    """
    new = values(facts, column).join(existing, column, "left_anti").select(F.col(column).alias("_v"), F.lit(0).alias("_all"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    at = numbered_rows(new, "_all", F.col("_v")).crossJoin(top)  # one row
    return existing.select("id", column).union(at.select((F.col("top") + F.col("_n")).cast("int").alias("id"), F.col("_v").alias(column)))


def numbered_rows(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """Rows with ``_n``, their number from 1 within each value of ``by`` in the order given, by no task alone.

    Rows are sorted over all tasks and written, so that parts stay as they are; a row's number is its place in its
    part after the rows of its group in the parts before, of which there is a row each.
    """
    sorted_ = rows.withColumn("_o", order).repartitionByRange(by, "_o").sortWithinPartitions(by, "_o").drop("_o")
    parts = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_first", "_before")
    joined = parts.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_n", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_by", "_p", "_first", "_before", "_part", "_at")


#: Lists of values of a family: the categories that a filter offers.
VEHICLE_LISTS = ("vehicle_class", "vehicle_type", "make", "color", "fuel_type", "model_year", "max_axles", "admin_region", "mrc", "municipality")
LICENCE_LISTS = ("licence_type", "age_group", "gender", "admin_region", "mrc", "exp_1234", "exp_5", "exp_6abce", "exp_global")


def all_lists(facts: DataFrame, columns: tuple[str, ...], config: Years) -> DataFrame:
    """``(category, value, curated, uncurated)``: the values of all categories as texts, with their rows in curated and uncurated years, in one scan.

    Each category is a grouping set; rows are counted in the tasks before they are sent, a row for each value.
    """
    curated, late = (F.count_if(F.col("year").isin(*y)) for y in (config.curated, config.uncurated))
    cube = facts.select("year", *[F.col(c).cast("string").alias(c) for c in columns]).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    found = cube.agg(F.grouping_id(*columns).alias("_g"), curated.alias("curated"), late.alias("uncurated"))
    # in a category's own set its bit alone is 0
    bits = {c: ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - k)) for k, c in enumerate(columns)}
    name = F.coalesce(*[F.when(F.col("_g") == bit, F.lit(c)) for c, bit in bits.items()])
    return found.select(name.alias("category"), F.coalesce(*columns).alias("value"), "curated", "uncurated").where("value is not null")


def split_years(facts: DataFrame, config: Years) -> tuple[DataFrame, DataFrame]:
    return facts.where(F.col("year").isin(*config.curated)), facts.where(F.col("year").isin(*config.uncurated))


def make_badges(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """Makes ``(make, display_name)``: those mapped to another make show it, those of uncurated years only their number of rows."""
    counts = facts.groupBy("make").agg(F.count_if(F.col("year").isin(*config.curated)).alias("curated"), F.count_if(F.col("year").isin(*config.uncurated)).alias("rows"))
    to = mapping.where("uncurated_make <> canonical_make").groupBy(F.col("uncurated_make").alias("make")).agg(F.min("canonical_make").alias("to"), F.sum("record_count").alias("mapped"))
    badge = F.when(F.col("to").isNotNull(), F.concat("make", F.lit(" → "), "to", F.lit(" ("), F.col("mapped").cast("string"), F.lit(" records)")))
    badge = badge.when((F.col("curated") == 0) & (F.col("rows") > 0), F.concat("make", F.lit(" [uncurated: "), F.col("rows").cast("string"), F.lit(" records]")))
    return counts.where("make is not null").join(to, "make", "left").select("make", badge.otherwise(F.col("make")).alias("display_name"))


def model_badges(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """Models as ``MODEL (MAKE)`` with the same badges, by pair."""
    counts = facts.groupBy("make", "model").agg(F.count_if(F.col("year").isin(*config.curated)).alias("curated"), F.count_if(F.col("year").isin(*config.uncurated)).alias("rows"))
    moved = F.struct("canonical_make", "canonical_model")
    to = mapping.where("uncurated_make <> canonical_make or uncurated_model <> canonical_model").groupBy(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model")).agg(F.min(moved).alias("to"), F.sum("record_count").alias("mapped"))
    base = display(F.col("model"), F.col("make"))
    badge = F.when(F.col("to").isNotNull(), F.concat(base, F.lit(" → "), display(F.col("to.canonical_model"), F.col("to.canonical_make")), F.lit(" ("), F.col("mapped").cast("string"), F.lit(" records)")))
    badge = badge.when((F.col("curated") == 0) & (F.col("rows") > 0), F.concat(base, F.lit(" [uncurated: "), F.col("rows").cast("string"), F.lit(" records]")))
    return counts.where("make is not null and model is not null").join(to, ["make", "model"], "left").select("make", "model", badge.otherwise(base).alias("display_name"))


def curated_makes(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """The makes of ``make_badges`` that curated years have."""
    known, _ = split_years(facts, config)
    return make_badges(facts, mapping, config).join(known.select("make").distinct(), "make", "left_semi")


def curated_models(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """The models of ``model_badges`` that curated years have, but for those that are mapped to another pair."""
    known, _ = split_years(facts, config)
    shown = model_badges(facts, mapping, config).where(~F.contains("display_name", F.lit(" → ")))
    return shown.join(known.select("make", "model").distinct(), ["make", "model"], "left_semi")


def in_order(facts: DataFrame, *columns: str) -> DataFrame:
    """``(place, value)``: the distinct values of some columns together, in order of display; a list of codes, not of facts."""
    found = facts.select(F.explode(F.array(*columns)).alias("value")).where("value is not null").distinct()
    return found.select(F.row_number().over(Window.orderBy("value")).alias("place"), "value")


def models_of(facts: DataFrame, makes: tuple[str, ...]) -> DataFrame:
    """Models of some makes."""
    return facts.where(F.col("make").isin(*makes)).select("make", "model").distinct()


def classes_present(licences: DataFrame) -> DataFrame:
    """Licence classes that any row has, with the numbers of rows: one pass, then one row per class."""
    totals = licences.agg(*[F.count_if(F.col(c)).alias(c) for c in LICENCE_CLASSES.values()])
    pairs = ", ".join(f"'{name}', {column}" for name, column in LICENCE_CLASSES.items())
    return totals.selectExpr(f"stack({len(LICENCE_CLASSES)}, {pairs}) as (licence_class, n)").where("n > 0")


def table_stats(facts: DataFrame, *distinct: str) -> DataFrame:
    """Rows, first and last year, and distinct values of some columns."""
    return facts.agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("from_year"), F.max("year").alias("to_year"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def children(places: DataFrame, parent: str) -> DataFrame:
    """Places right below another."""
    return places.where(F.col("parent_code") == parent)


def fuels(names: DataFrame) -> DataFrame:
    """Fuel types ``(code, description)`` in display order: not ``NS``, the unknown one last."""
    return names.where("code <> 'NS'").withColumn("place", F.row_number().over(Window.orderBy(F.col("code") == "U", "description")))
