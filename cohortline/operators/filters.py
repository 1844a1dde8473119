"""Filters of the chart queries: a specification and what it makes of a fact table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import LICENCE_CLASSES, Years
from .mapping import expand_filters, expand_makes

#: Columns that a field of the specification is compared with.
COLUMNS = {
    "years": "year", "regions": "admin_region", "mrcs": "mrc", "municipalities": "municipality", "classes": "vehicle_class", "types": "vehicle_type",
    "makes": "make", "colors": "color", "model_years": "model_year", "fuels": "fuel_type", "axles": "max_axles",
    "licence_types": "licence_type", "age_groups": "age_group", "genders": "gender",
}
VEHICLE_ONLY = ("municipalities", "classes", "types", "makes", "models", "colors", "model_years", "fuels", "axles", "age_ranges")
LICENCE_ONLY = ("licence_types", "age_groups", "genders", "experience", "licence_classes")
#: Pairs of make and model that are compared in place; a longer list is joined.
FEW_MODELS = 200
EXPERIENCE_COLUMNS = ("exp_1234", "exp_5", "exp_6abce", "exp_global")


@dataclass(frozen=True)
class FilterSpec:
    """What rows to take.  None is no filter; an empty tuple takes no row, or with ``lenient`` is no filter either.

    ``models`` are pairs (make, model), as model names repeat across makes.  ``age_ranges`` are pairs (from,
    to or None).  With ``regularize`` the vehicle type and fuel filters also take uncurated rows whose
    mapping has a wanted value, and makes and models, unless ``curated_only``, what the mapping puts beside
    them; with ``coupling`` that of models adds makes and models, without it only what is filtered.
    """

    years: tuple[int, ...] | None = None
    curated_only: bool = False
    regions: tuple[str, ...] | None = None
    mrcs: tuple[str, ...] | None = None
    municipalities: tuple | None = None
    classes: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    makes: tuple[str, ...] | None = None
    models: tuple[tuple[str, str], ...] | None = None
    colors: tuple[str, ...] | None = None
    model_years: tuple[int, ...] | None = None
    fuels: tuple[str, ...] | None = None
    axles: tuple[int, ...] | None = None
    age_ranges: tuple[tuple[int, int | None], ...] | None = None
    licence_types: tuple[str, ...] | None = None
    age_groups: tuple[str, ...] | None = None
    genders: tuple[str, ...] | None = None
    experience: tuple[str, ...] | None = None
    licence_classes: tuple[str, ...] | None = None
    regularize: bool = False
    coupling: bool = True
    fuel_before: bool = True
    lenient: bool = False

    def for_vehicles(self) -> FilterSpec:
        return replace(self, **dict.fromkeys(LICENCE_ONLY))

    def for_licences(self) -> FilterSpec:
        return replace(self, **dict.fromkeys(VEHICLE_ONLY))

    def without(self, *fields: str) -> FilterSpec:
        """A baseline: the same filters but for some."""
        return replace(self, **dict.fromkeys(fields))

    def wanted_years(self, config: Years) -> tuple[int, ...] | None:
        if not self.curated_only:
            return self.years
        return config.curated if self.years is None else tuple(y for y in self.years if y in config.curated)

    @property
    def expands(self) -> bool:
        """Whether makes and models take what the mapping puts beside them."""
        return self.regularize and not self.curated_only

    def columns(self) -> set[str]:
        """The columns that the filters read."""
        used = {c for f, c in COLUMNS.items() if getattr(self, f) is not None} | {"year"}
        used |= {"make", "model"} if self.models is not None or self.regularize else set()
        used |= {"model_year"} if self.age_ranges is not None or self.regularize else set()
        used |= set(EXPERIENCE_COLUMNS) if self.experience is not None else set()
        return used | {LICENCE_CLASSES[x] for x in self.licence_classes or () if x in LICENCE_CLASSES}


def age() -> Column:
    return F.col("year") - F.col("model_year")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def in_age_range(ranges: tuple[tuple[int, int | None], ...]) -> Column:
    return F.col("model_year").isNotNull() & any_of([age() >= a if b is None else age().between(a, b) for a, b in ranges])


def predicates(spec: FilterSpec, config: Years) -> list[Column]:
    """Conditions on a fact's own columns; those on years reach the scan as partition filters."""
    out = []
    for name, column in COLUMNS.items():
        wanted = spec.wanted_years(config) if name == "years" else getattr(spec, name)
        if wanted is None or spec.lenient and not wanted or spec.regularize and name in ("types", "fuels") or spec.expands and name == "makes":
            continue
        out.append(F.col(column).isin(*wanted) if wanted else F.lit(False))
    use = lambda x: x is not None and (x or not spec.lenient)
    if use(spec.models) and not spec.models:
        out.append(F.lit(False))
    elif use(spec.models) and len(spec.models) <= FEW_MODELS and not spec.expands:
        out.append(F.struct("make", "model").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in spec.models]))
    if use(spec.age_ranges):
        out.append(in_age_range(spec.age_ranges))
    if use(spec.experience):
        out.append(any_of([F.col(c).isin(*spec.experience) for c in EXPERIENCE_COLUMNS] if spec.experience else []))
    if use(spec.licence_classes):
        out.append(any_of([F.col(LICENCE_CLASSES[x]) for x in spec.licence_classes if x in LICENCE_CLASSES]))
    return out


def with_mapping(facts: DataFrame, mapping: DataFrame, spec: FilterSpec, config: Years) -> DataFrame:
    """The type and fuel filters with the mapping: an existence join each, which never multiplies a fact.

    The mapping's keys with a wanted value are made distinct before the join; the planner sends them to
    all executors if they are small and deals both sides by key if not.
    """
    use = lambda x: x is not None and (x or not spec.lenient)
    if use(spec.types):
        hit = mapping.where(F.col("vehicle_type").isin(*spec.types)).select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model")).distinct().withColumn("_type", F.lit(True))
        known = F.col("vehicle_type").isin(*spec.types)
        facts = facts.join(hit, ["make", "model"], "left").where(known | F.col("vehicle_type").isNull() & F.col("year").isin(*config.uncurated) & F.col("_type").isNotNull()).drop("_type")
    if use(spec.fuels):
        hit = mapping.where(F.col("fuel_type").isin(*spec.fuels) & F.col("model_year").isNotNull()).select(F.col("uncurated_make").alias("make"), F.col("uncurated_model").alias("model"), "model_year").distinct().withColumn("_fuel", F.lit(True))
        known, late = F.col("fuel_type").isin(*spec.fuels), F.lit(True) if spec.fuel_before else F.col("year") >= config.fuel_from
        facts = facts.join(hit, ["make", "model", "model_year"], "left").where(known | F.col("fuel_type").isNull() & late & F.col("_fuel").isNotNull()).drop("_fuel")
    return facts


def chosen(facts: DataFrame, spec: FilterSpec, mapping: DataFrame | None) -> DataFrame:
    """The make and model filters that are joins: expanded ones and long lists.

    Each is an existence join on a list of distinct keys, which the planner sends to all executors while it
    is small.
    """
    spark = facts.sparkSession
    listed = lambda rows, schema: spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema)
    if not spec.expands:
        if spec.models and len(spec.models) > FEW_MODELS:
            facts = facts.join(listed(spec.models, "make string, model string").distinct(), ["make", "model"], "left_semi")
        return facts
    makes = None if spec.makes is None or spec.lenient and not spec.makes else expand_makes(mapping, listed(spec.makes, "make string"))
    models = listed(spec.models, "make string, model string") if spec.models else None
    if models is not None:
        makes, models = expand_filters(mapping, makes, models, spec.coupling)
    if makes is not None:
        facts = facts.join(makes, "make", "left_semi")
    return facts if models is None else facts.join(models, ["make", "model"], "left_semi")


def apply(facts: DataFrame, spec: FilterSpec, config: Years, mapping: DataFrame | None = None) -> DataFrame:
    """The rows of ``facts`` that the specification takes."""
    if spec.regularize and mapping is None:
        raise ValueError("a regularized filter needs the mapping")
    for condition in predicates(spec, config):
        facts = facts.where(condition)
    facts = chosen(facts, spec, mapping)
    return with_mapping(facts, mapping, spec, config) if spec.regularize else facts
