"""Which make and model codes of uncurated years mean which curated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import Years
from .dims import split_years

PAIR = ["make", "model"]


def hierarchy(facts: DataFrame, config: Years) -> DataFrame:
    """Rows of curated years by make, model, model year, fuel and type; nulls are groups."""
    curated, _ = split_years(facts, config)
    return curated.groupBy("make", "model", "model_year", "fuel_type", "vehicle_type").agg(F.count(F.lit(1)).alias("n"))


def nested_hierarchy(facts: DataFrame, config: Years) -> DataFrame:
    """A row per make and model: model years with their fuels, and vehicle types, each with the sum of its rows."""
    flat = hierarchy(facts, config)
    fuels = flat.groupBy("make", "model", "model_year", "fuel_type").agg(F.sum("n").alias("n"))
    years = fuels.groupBy("make", "model", "model_year").agg(F.sort_array(F.collect_list(F.struct("fuel_type", "n"))).alias("fuels"))
    years = years.groupBy("make", "model").agg(F.sort_array(F.collect_list(F.struct("model_year", "fuels"))).alias("model_years"))
    types = flat.groupBy("make", "model", "vehicle_type").agg(F.sum("n").alias("n")).groupBy("make", "model").agg(F.sort_array(F.collect_list(F.struct("vehicle_type", "n"))).alias("types"))
    years, types = years.alias("y"), types.alias("t")
    same = F.col("y.make").eqNullSafe(F.col("t.make")) & F.col("y.model").eqNullSafe(F.col("t.model"))
    return years.join(types, same).select("y.make", "y.model", "model_years", "types")


def _when(years: tuple[int, ...], value: Column | None = None) -> Column:
    inside = F.col("year").isin(*years)
    return inside if value is None else F.when(inside, value)


def pair_counts(facts: DataFrame, config: Years) -> DataFrame:
    """Of each pair: first and last uncurated year, rows of uncurated and of curated years, in one scan."""
    rows = facts.where("make is not null and model is not null").where(_when(config.curated + config.uncurated))
    year = _when(config.uncurated, F.col("year"))
    return rows.groupBy(*PAIR).agg(F.min(year).alias("from_year"), F.max(year).alias("to_year"), F.count(year).alias("n"), F.count_if(_when(config.curated)).alias("curated")).where("n > 0")


def uncurated_pairs(facts: DataFrame, config: Years) -> DataFrame:
    """Pairs of uncurated years: first and last year, rows, share of all such rows in percent, and whether curated years have the pair."""
    pairs = pair_counts(facts, config)
    total = pairs.agg(F.sum("n").alias("total"))
    joined = pairs.crossJoin(total)  # one row: the total
    return joined.select(*PAIR, "from_year", "to_year", "n", (F.col("n").cast("double") / F.col("total").cast("double") * 100).alias("share"), (F.col("curated") > 0).alias("is_exact_match"))


def pair_model_years(facts: DataFrame, config: Years) -> DataFrame:
    """Model years of each uncurated pair, with rows."""
    _, uncurated = split_years(facts, config)
    return uncurated.where("model_year is not null").groupBy(*PAIR, "model_year").agg(F.count(F.lit(1)).alias("n"))


def listing(mapping: DataFrame) -> DataFrame:
    """Mappings with their share of all mapped rows in percent."""
    total = mapping.agg(F.sum("record_count").alias("total"))
    return mapping.crossJoin(total).withColumn("share", F.col("record_count").cast("double") / F.col("total").cast("double") * 100).drop("total")


def stats(mapping: DataFrame, facts: DataFrame, config: Years) -> DataFrame:
    """Number of mappings, rows that they cover, and rows of uncurated years."""
    _, uncurated = split_years(facts, config)
    return mapping.agg(F.count(F.lit(1)).alias("mappings"), F.coalesce(F.sum("record_count"), F.lit(0)).cast("bigint").alias("covered")).crossJoin(uncurated.agg(F.count(F.lit(1)).alias("uncurated")))


def detailed_stats(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """Rows of uncurated years whose pair is mapped, has a mapped type, and (by model year) a mapped fuel: one pass over the facts."""
    _, uncurated = split_years(facts, config)
    m = mapping.select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model"), "model_year", "vehicle_type", "fuel_type")
    pair = m.groupBy(*PAIR).agg(F.max(F.col("vehicle_type").isNotNull()).alias("typed"))
    fuel = m.where("model_year is not null and fuel_type is not null").select(*PAIR, "model_year").distinct().withColumn("fuelled", F.lit(True))
    joined = uncurated.join(pair, PAIR, "left").join(fuel, [*PAIR, "model_year"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("typed").alias("mapped"), F.count_if("typed").alias("with_type"), F.count("fuelled").alias("with_fuel"))


def status(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """Of each uncurated pair: complete, partial or unassigned.

    Complete: a row without model year gives a type, there is a row with a model year, and each model
    year of the pair has one with a fuel (a pair without model years has none that lacks it).
    """
    _, uncurated = split_years(facts, config)
    m = mapping.select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model"), "model_year", "vehicle_type", "fuel_type")
    of = m.groupBy(*PAIR).agg(F.max(F.col("model_year").isNull() & F.col("vehicle_type").isNotNull()).alias("typed"), F.count("model_year").alias("rows"))
    fuelled = m.where("model_year is not null and fuel_type is not null").select(*PAIR, "model_year").distinct().withColumn("has", F.lit(True))
    years = uncurated.where("make is not null and model is not null").select(*PAIR, "model_year").distinct().join(fuelled, [*PAIR, "model_year"], "left")
    covered = F.min(F.when(F.col("model_year").isNotNull(), F.coalesce("has", F.lit(False)))).alias("covered")
    joined = years.groupBy(*PAIR).agg(covered).join(of, PAIR, "left")
    whole = F.col("typed") & (F.col("rows") > 0) & F.coalesce("covered", F.lit(True))
    return joined.select(*PAIR, F.when(whole, "complete").when(F.col("typed").isNotNull(), "partial").otherwise("unassigned").alias("status"))


def expand_makes(mapping: DataFrame, makes: DataFrame) -> DataFrame:
    """Makes, what they are mapped to, and what is mapped to either: two hops, not a closure."""
    first = makes.union(mapping.join(makes, mapping.uncurated_make == makes.make, "left_semi").select("canonical_make")).distinct()
    second = mapping.join(first, mapping.canonical_make == first.make, "left_semi").select(F.col("uncurated_make").alias("make"))
    return first.union(second).distinct()


def expand_pairs(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of make and model likewise, pair by pair, so that no curated row is lost to a make it does not have."""
    m = mapping.select("uncurated_make", "uncurated_model", "canonical_make", "canonical_model").distinct()
    here = (m.uncurated_make == pairs.make) & (m.uncurated_model == pairs.model)
    first = pairs.union(m.join(pairs, here, "left_semi").select("canonical_make", "canonical_model")).distinct()
    there = (m.canonical_make == first.make) & (m.canonical_model == first.model)
    return first.union(m.join(first, there, "left_semi").select("uncurated_make", "uncurated_model")).distinct()


def expand_filters(mapping: DataFrame, makes: DataFrame | None, models: DataFrame, coupling: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """What a filter on models ``(make, model)``, and on makes if there is one, takes with the mapping.

    The first hop goes from mapped pairs that pass both filters to what they are mapped to, the second from
    there to all that is mapped to it; each adds to the filters that there are.  With ``coupling`` the
    second also adds makes where only models were filtered: a filter on makes that the caller did not set.
    """
    m = mapping.select("uncurated_make", "uncurated_model", "canonical_make", "canonical_model").distinct()

    def passing(kind: str, by_make: DataFrame | None, by_model: DataFrame) -> DataFrame:
        out = m.join(by_model.withColumnsRenamed({"make": f"{kind}_make", "model": f"{kind}_model"}), [f"{kind}_make", f"{kind}_model"], "left_semi")
        return out if by_make is None else out.join(by_make.withColumnRenamed("make", f"{kind}_make"), f"{kind}_make", "left_semi")

    first = passing("uncurated", makes, models)
    models = models.union(first.select("canonical_make", "canonical_model")).distinct()
    wide = None if makes is None else makes.union(first.select("canonical_make")).distinct()
    second = passing("canonical", wide, models)
    models = models.union(second.select("uncurated_make", "uncurated_model")).distinct()
    if makes is None and not coupling:
        return None, models
    more = second.select(F.col("uncurated_make").alias("make"))
    if makes is None:
        return (None if more.isEmpty() else more.distinct()), models
    return wide.union(more).distinct(), models


def auto_wildcards(facts: DataFrame, mapping: DataFrame, config: Years, preferred: tuple[str, ...]) -> DataFrame:
    """Rows ``(make, model, vehicle_type)`` for unmapped pairs that curated years have: their only type, or the first preferred one that they have."""
    kinds = facts.where("make is not null and model is not null").groupBy(*PAIR).agg(F.count_if(_when(config.uncurated)).alias("n"), F.count_if(_when(config.curated)).alias("curated"), F.collect_set(_when(config.curated, F.col("vehicle_type"))).alias("types"))
    choice = F.when(F.size("types") == 1, F.get("types", F.lit(0)))
    for code in preferred:
        choice = choice.when(F.array_contains("types", code), F.lit(code))
    return _unmapped(kinds.where("n > 0 and curated > 0"), mapping).select(*PAIR, choice.alias("vehicle_type"))


def auto_triplets(facts: DataFrame, mapping: DataFrame, config: Years) -> DataFrame:
    """Rows ``(make, model, model_year, fuel_type)`` for the model years of such pairs that have one fuel only in curated years."""
    fuel = _when(config.curated, F.col("fuel_type"))
    years = facts.where("make is not null and model is not null and model_year is not null").groupBy(*PAIR, "model_year").agg(F.count_if(_when(config.uncurated)).alias("n"), F.min(fuel).alias("fuel_type"), F.max(fuel).alias("other"))
    return _unmapped(years.where("n > 0 and fuel_type = other"), mapping).select(*PAIR, "model_year", "fuel_type")


def _unmapped(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose pair no mapping has."""
    mapped = mapping.select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model"))
    return pairs.join(mapped, PAIR, "left_anti")


def make_rollup(mapping: DataFrame) -> DataFrame:
    """Mapped rows by make and the make it is mapped to."""
    return mapping.groupBy("uncurated_make", "canonical_make").agg(F.sum("record_count").alias("n"))


def make_conflicts(mapping: DataFrame) -> DataFrame:
    """Makes that are mapped to more than one make."""
    return mapping.groupBy("uncurated_make").agg(F.count_distinct("canonical_make").alias("n")).where("n > 1")


def type_usage(mapping: DataFrame) -> DataFrame:
    return mapping.where("vehicle_type is not null").groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("n"))


def uncurated_only_makes(facts: DataFrame, config: Years) -> DataFrame:
    """Makes that no curated year has, with rows."""
    curated, uncurated = split_years(facts, config)
    return uncurated.where("make is not null").groupBy("make").agg(F.count(F.lit(1)).alias("n")).join(curated.select("make").distinct(), "make", "left_anti")


def save(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """The mapping with rows added: a row replaces that of the same make, model and model year, null counting as a value.

    Rows of a make that is mapped to another make already, by the mapping or among themselves, are refused; of
    equal keys among the new rows one is kept, the largest by its values.
    """
    both = mapping.select("uncurated_make", "canonical_make").union(new.select("uncurated_make", "canonical_make")).distinct()
    asked = new.select("uncurated_make").distinct()
    if not both.join(asked, "uncurated_make", "left_semi").groupBy("uncurated_make").count().where("count > 1").isEmpty():
        raise ValueError("the make is mapped to another make already")
    key = ["uncurated_make", "uncurated_model", "model_year"]
    rest = [c for c in new.columns if c not in key]
    new = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_v")).select(*key, "_v.*").select(*new.columns)
    m, n = mapping.alias("m"), new.alias("n")
    same: Column = F.col("m.uncurated_make").eqNullSafe(F.col("n.uncurated_make")) & F.col("m.uncurated_model").eqNullSafe(F.col("n.uncurated_model")) & F.col("m.model_year").eqNullSafe(F.col("n.model_year"))
    return m.join(n, same, "left_anti").unionByName(new)


def delete(mapping: DataFrame, make: str, model: str, model_year: int | None = None, whole_pair: bool = False) -> DataFrame:
    """The mapping without a row, or without all rows of a pair."""
    hit = (F.col("uncurated_make") == make) & (F.col("uncurated_model") == model)
    hit = hit if whole_pair else hit & F.col("model_year").eqNullSafe(F.lit(model_year))
    return mapping.where(~F.coalesce(hit, F.lit(False)))


def with_counts(pairs: DataFrame, facts: DataFrame, config: Years) -> DataFrame:
    """New mapping rows with what they cover: the rows of their pair (and model year, if they have one) in uncurated years, and those years."""
    whole = uncurated_pairs(facts, config).select(F.col("make").alias("uncurated_make"), F.col("model").alias("uncurated_model"), "n")
    yearly = pair_model_years(facts, config).select(F.col("make").alias("uncurated_make"), F.col("model").alias("uncurated_model"), "model_year", F.col("n").alias("of_year"))
    joined = pairs.join(whole, ["uncurated_make", "uncurated_model"], "left").join(yearly, ["uncurated_make", "uncurated_model", "model_year"], "left")
    n = F.when(F.col("model_year").isNull(), F.col("n")).otherwise(F.col("of_year"))
    return joined.withColumns({"record_count": F.coalesce(n, F.lit(0)).cast("bigint"), "year_start": F.lit(min(config.uncurated)), "year_end": F.lit(max(config.uncurated))}).drop("n", "of_year")


def display_info(mapping: DataFrame) -> DataFrame:
    """What each pair is mapped to and whether type and fuels are assigned: one row per pair."""
    fields = mapping.groupBy("uncurated_make", "uncurated_model").agg(
        F.min(F.struct("canonical_make", "canonical_model")).alias("to"), F.max("record_count").alias("record_count"),
        F.max(F.col("vehicle_type").isNotNull()).alias("has_type"), F.count("model_year").alias("model_years"), F.count_if(F.col("model_year").isNotNull() & F.col("fuel_type").isNotNull()).alias("with_fuel"),
    )
    return fields.select("uncurated_make", "uncurated_model", "to.canonical_make", "to.canonical_model", "record_count", "has_type", "model_years", "with_fuel")


def pairs_of_type(mapping: DataFrame, vehicle_type: str) -> DataFrame:
    """Pairs that are mapped to a vehicle type."""
    return mapping.where(F.col("vehicle_type") == vehicle_type).select("uncurated_make", "uncurated_model").distinct()
