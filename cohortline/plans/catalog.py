"""Registered queries: each a Spark plan and, beside it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import dims, metrics, profile, resolve, series
from ..operators import mapping as mp
from ..operators.filters import FilterSpec, apply
from ..operators.metrics import Metric
from ..operators.wear import BY_AXLES, Wear, coefficient
from . import star
from .star import LIC, MAP, REG, YEARS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ALL_YEARS = (1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001)
WEAR = Wear(tuple(BY_AXLES.items()), (("ECONOMY", (50.0, 50.0)), ("LARGE", (30.0, 35.0, 35.0)), ("PROMO", (35.0, 65.0)), ("*", (50.0, 50.0))))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def reg(spec: FilterSpec, metric: Metric) -> Callable[[SparkSession, str], DataFrame]:
    """The facts with the columns that a filter and a metric read."""
    return lambda spark, sf: star.registrations(spark, sf, *sorted(spec.columns() | metric.columns()))


def chart(spec: FilterSpec, metric: Metric = Metric(), scale: float = 1.0, digits: int = 4) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        mapping = star.mapping(spark, sf) if spec.regularize else None
        out = metrics.query(reg(spec, metric)(spark, sf), spec, metric, YEARS, mapping)
        return out.select("year", F.round(F.col("value") / scale, digits).alias("value"))

    return run


def sql_chart(value: str, where: str = "true", scale: str = "1.0", digits: int = 4, ctes: str = REG) -> str:
    return f"with {ctes} select year, round(cast({value} as double) / {scale}, {digits}) as value from reg r where {where} group by year"


# ---- metrics
NONE = FilterSpec()
add("count_by_year", chart(NONE), sql_chart("count(*)"))
for _kind, _f in (("sum", "sum"), ("average", "avg"), ("minimum", "min"), ("maximum", "max"), ("median", "median")):
    _short = {"average": "avg", "minimum": "min", "maximum": "max"}.get(_kind, _kind)
    add(f"{_short}_mass", chart(NONE, Metric(_kind, "net_mass")), sql_chart(f"{_f}(net_mass)", "net_mass is not null"))
    add(f"{_short}_age", chart(NONE, Metric(_kind, "age")), sql_chart(f"{_f}(year - model_year)", "model_year is not null"))
    add(f"{_short}_displacement", chart(NONE, Metric(_kind, "displacement")), sql_chart(f"{_f}(displacement)", "displacement is not null"))
    add(f"{_short}_cylinders", chart(NONE, Metric(_kind, "cylinder_count")), sql_chart(f"{_f}(cylinder_count)", "cylinder_count is not null"))
for _field in ("fuel_type", "model_year", "max_axles", "vehicle_type", "displacement"):
    add(f"coverage_pct_{_field}", chart(NONE, Metric("coverage", _field)), sql_chart(f"count({_field})::double / count(*) * 100"))
    add(f"coverage_null_{_field}", chart(NONE, Metric("missing", _field)), sql_chart(f"count(*) - count({_field})"))
_arms = " ".join(f"when max_axles {'>=' if k == 6 else '='} {k} then {coefficient(w)!r}" for k, w in BY_AXLES.items()) + " " + " ".join(f"when vehicle_type = '{k}' then {coefficient(w)!r}" for k, w in WEAR.by_type if k != "*")
_wear = f"(case {_arms} else {coefficient((50.0, 50.0))!r} end) * power(net_mass, 4)"
for _kind, _f in (("average", "avg"), ("sum", "sum"), ("median", "median")):
    add(f"wear_{_kind}", chart(NONE, Metric(f"wear_{_kind}", wear=WEAR), 1e9, 3), sql_chart(f"{_f}({_wear})", "net_mass is not null", "1e9", 3))



def median_by_ranks(metric: Metric, scale: float = 1.0, digits: int = 4) -> Query:
    """A median for years of any size."""
    return lambda spark, sf: metrics.median_of_years(reg(NONE, metric)(spark, sf), NONE, metric, YEARS).select("year", F.round(F.col("value") / scale, digits).alias("value"))


add("median_by_ranks", median_by_ranks(Metric("median", "net_mass")), ORACLES["median_mass"])
add("wear_median_by_ranks", median_by_ranks(Metric("wear_median", wear=WEAR), 1e9, 3), ORACLES["wear_median"])

# ---- filters
FILTERS: dict[str, tuple[FilterSpec, str]] = {
    "years": (FilterSpec(years=(1996, 1998)), "year in (1996, 1998)"),
    "curated_years": (FilterSpec(years=(1998, 1999, 2000), curated_only=True), "year in (1998, 1999)"),
    "region": (FilterSpec(regions=("EUROPE", "ASIA")), "admin_region in ('EUROPE', 'ASIA')"),
    "mrc": (FilterSpec(mrcs=("NATION_3", "NATION_8")), "mrc in ('NATION_3', 'NATION_8')"),
    "municipality": (FilterSpec(municipalities=("1", "2", "3", "17")), "municipality in ('1', '2', '3', '17')"),
    "class": (FilterSpec(classes=("BUILDING", "MACHINERY")), "vehicle_class in ('BUILDING', 'MACHINERY')"),
    "type": (FilterSpec(types=("PROMO", "SMALL")), "vehicle_type in ('PROMO', 'SMALL')"),
    "make": (FilterSpec(makes=("Brand#11", "Brand#32")), "make in ('Brand#11', 'Brand#32')"),
    "color": (FilterSpec(colors=("1-URGENT",)), "color = '1-URGENT'"),
    "model_year": (FilterSpec(model_years=(1990, 1991)), "model_year in (1990, 1991)"),
    "fuel": (FilterSpec(fuels=("R", "A")), "fuel_type in ('R', 'A')"),
    "axles": (FilterSpec(axles=(2, 5)), "max_axles in (2, 5)"),
    "age_ranges": (FilterSpec(age_ranges=((-1, 5), (16, None))), "(year - model_year between -1 and 5 or year - model_year >= 16)"),
    "combined": (FilterSpec(years=(1997, 1998, 1999), regions=("EUROPE",), fuels=("R",), age_ranges=((6, 10),)), "year in (1997, 1998, 1999) and admin_region = 'EUROPE' and fuel_type = 'R' and year - model_year between 6 and 10"),
    "nothing": (FilterSpec(regions=()), "false"),
}
for _name, (_spec, _where) in FILTERS.items():
    add(f"f_{_name}", chart(_spec), sql_chart("count(*)", _where))


#: Eight series of one chart with their SQL, and two shares of them.
SERIES: dict[str, tuple[FilterSpec, Metric, str, str]] = {
    "all": (NONE, Metric(), "count(*)", "true"),
    "fuel R": (FilterSpec(fuels=("R",)), Metric(), "count(*)", "fuel_type = 'R'"),
    "Europe": (FilterSpec(regions=("EUROPE",)), Metric(), "count(*)", "admin_region = 'EUROPE'"),
    "Europe, fuel R": (FilterSpec(regions=("EUROPE",), fuels=("R",)), Metric(), "count(*)", "admin_region = 'EUROPE' and fuel_type = 'R'"),
    "mass of promo": (FilterSpec(types=("PROMO",)), Metric("average", "net_mass"), "avg(net_mass)", "vehicle_type = 'PROMO' and net_mass is not null"),
    "oldest": (FilterSpec(years=(1995, 1998)), Metric("maximum", "age"), "max(year - model_year)", "year in (1995, 1998) and model_year is not null"),
    "axles known": (FilterSpec(classes=("BUILDING", "MACHINERY")), Metric("coverage", "max_axles"), "count(max_axles)::double / count(*) * 100", "vehicle_class in ('BUILDING', 'MACHINERY')"),
    "young": (FilterSpec(age_ranges=((-1, 5),)), Metric("sum", "cylinder_count"), "sum(cylinder_count)", "year - model_year between -1 and 5 and cylinder_count is not null"),
}
SHARES = {"share of R": ("fuel R", "all"), "share of R in Europe": ("Europe, fuel R", "Europe")}


def many_series(spark: SparkSession, sf: str) -> DataFrame:
    """All series of a chart, numerators and baselines too, from one scan of the facts."""
    columns = set().union(*(spec.columns() | metric.columns() for spec, metric, _, _ in SERIES.values()))
    points = metrics.many(star.registrations(spark, sf, *sorted(columns)), {k: v[:2] for k, v in SERIES.items()}, YEARS)
    return points.select("series", "year", F.round("value", 4).alias("value"))


def many_shares(spark: SparkSession, sf: str) -> DataFrame:
    facts = star.registrations(spark, sf, "year", "fuel_type", "admin_region")
    points = metrics.many(facts, {k: SERIES[k][:2] for k in ("all", "fuel R", "Europe", "Europe, fuel R")}, YEARS)
    return metrics.percentages(points, SHARES).select("series", "year", F.round("value", 4).alias("value"))


add("many_series", many_series, f"with {REG} " + " union all ".join(f"select '{k}' as series, year, round(cast({value} as double), 4) as value from reg where {where} group by year" for k, (_, _, value, where) in SERIES.items()))
add("many_shares", many_shares, f"with {REG} " + " union all ".join(f"select '{k}' as series, year, round(count(*) filter ({SERIES[a][3]} and {SERIES[b][3]})::double / count(*) filter ({SERIES[b][3]}) * 100, 4) as value from reg group by year having count(*) filter ({SERIES[a][3]}) > 0" for k, (a, b) in SHARES.items()))


def f_make_model(spark: SparkSession, sf: str) -> DataFrame:
    facts = star.registrations(spark, sf, "year", "make", "model")
    wanted = facts.where("make = 'Brand#11'").agg(F.min("model").alias("low"), F.max("model").alias("high")).first()
    spec = FilterSpec(models=(("Brand#11", wanted.low or ""), ("Brand#11", wanted.high or "")))
    return metrics.query(facts, spec, Metric(), YEARS).select("year", F.round("value", 4).alias("value"))


add("f_make_model", f_make_model, sql_chart("count(*)", "make = 'Brand#11' and model in ((select min(model) from reg where make = 'Brand#11'), (select max(model) from reg where make = 'Brand#11'))"))
add("type_filter_regularized", chart(FilterSpec(types=("PROMO",), regularize=True)), sql_chart("count(*)", "vehicle_type = 'PROMO' or (vehicle_type is null and year in (2000, 2001) and exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model and m.vehicle_type = 'PROMO'))", ctes=MAP))
add("fuel_filter_triplet", chart(FilterSpec(fuels=("A",), regularize=True)), sql_chart("count(*)", "fuel_type = 'A' or (fuel_type is null and exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model and m.model_year = r.model_year and m.fuel_type = 'A'))", ctes=MAP))
add("fuel_filter_triplet_late", chart(FilterSpec(fuels=("A", "N"), regularize=True, fuel_before=False)), sql_chart("count(*)", "fuel_type in ('A', 'N') or (fuel_type is null and year >= 1997 and exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model and m.model_year = r.model_year and m.fuel_type in ('A', 'N')))", ctes=MAP))


def licence_chart(spec: FilterSpec, metric: Metric = Metric()) -> Query:
    return lambda spark, sf: metrics.query(star.licences(spark, sf), spec, metric, YEARS).select("year", F.round("value", 4).alias("value"))


def sql_licence(value: str, where: str = "true") -> str:
    return f"with {LIC} select year, round(cast({value} as double), 4) as value from lic where {where} group by year"


add("licence_count", licence_chart(NONE), sql_licence("count(*)"))
add("licence_coverage", licence_chart(NONE, Metric("coverage", "age_group")), sql_licence("count(age_group)::double / count(*) * 100"))
add("l_type_age_gender", licence_chart(FilterSpec(licence_types=("RÉGULIER",), age_groups=("16-19", "35-44"), genders=("F",))), sql_licence("count(*)", "licence_type = 'RÉGULIER' and age_group in ('16-19', '35-44') and gender = 'F'"))
add("l_experience_any", licence_chart(FilterSpec(experience=("Absente", "2 à 5 ans"))), sql_licence("count(*)", " or ".join(f"{c} in ('Absente', '2 à 5 ans')" for c in ("exp_1234", "exp_5", "exp_6abce", "exp_global"))))
add("l_class_flags", licence_chart(FilterSpec(licence_classes=("5", "6D", "Probationary"))), sql_licence("count(*)", "driver_5 or driver_6d or probationary"))
add("l_region_mrc", licence_chart(FilterSpec(regions=("EUROPE",), mrcs=("NATION_8", "NATION_1"))), sql_licence("count(*)", "admin_region = 'EUROPE' and mrc in ('NATION_8', 'NATION_1')"))

# ---- series
_R = FilterSpec(years=(1994, 1995, 1997, 2000), fuels=("R",))
_base = f"{REG}, p as (select year, count(*)::double as value from reg where fuel_type = 'R' and year in (1994, 1995, 1997, 2000) group by year), z as (select y as year, coalesce(value, 0) as value from unnest([1994, 1995, 1997, 2000]) as t(y) left join p on p.year = y)"
_counts = f"{REG}, p as (select year, count(*)::double as value from reg group by year)"


def points(spark: SparkSession, sf: str, spec: FilterSpec = NONE, metric: Metric = Metric()) -> DataFrame:
    return metrics.query(reg(spec, metric)(spark, sf), spec, metric, YEARS)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("year", F.round("value", digits).alias("value"))


add("zero_fill", lambda s, d: series.zero_fill(points(s, d, _R), _R.years), f"with {_base} select cast(year as int) as year, value from z")
add("normalise_first", lambda s, d: rounded(series.normalise(points(s, d)), 8), f"with {_counts} select year, round(case when f > 0 then value / f else value end, 8) as value from (select *, first(value) over (order by year) as f from p)")
add("normalise_zero_first", lambda s, d: rounded(series.normalise(series.zero_fill(points(s, d, _R), _R.years)), 8), f"with {_base} select cast(year as int) as year, value from z")
add("cumulative", lambda s, d: series.cumulate(points(s, d)), f"with {_counts} select year, sum(value) over (order by year) as value from p")
add("normalise_then_cumulative", lambda s, d: rounded(series.transform(points(s, d), normalised=True, cumulative=True), 6), f"with {_counts} select year, round(sum(value / f) over (order by year), 6) as value from (select *, first(value) over (order by year) as f from p)")
_P = FilterSpec(regions=("EUROPE",), fuels=("R",))
_share = f"with {REG} select year, round(count(*) filter (fuel_type = 'R')::double / count(*) * 100, 6) as value from reg where admin_region = 'EUROPE' group by year having count(*) filter (fuel_type = 'R') > 0"
add("percentage_of_baseline", lambda s, d: rounded(metrics.percentage(points(s, d, _P), points(s, d, _P.without("fuels"))), 6), _share)
add("percentage_one_scan", lambda s, d: rounded(metrics.percentage_one_scan(reg(_P, Metric())(s, d), _P, ("fuels",), YEARS), 6), _share)
_stat_columns = ("n", "total", "mean", "median", "low", "high", "deviation", "range", "change", "change_pct", "growth_pct")


def series_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = series.statistics(points(spark, sf))
    return out.select("n", *[F.round(c, 4).alias(c) for c in _stat_columns[1:]])


add("series_stats", series_stats, f"""with {_counts}, s as (select count(*) as n, sum(value) as total, avg(value) as mean, median(value) as median, min(value) as low, max(value) as high,
 coalesce(stddev_samp(value), 0) as deviation, min_by(value, year) as f, max_by(value, year) as l, max(year) - min(year) as span from p)
select n, round(total, 4) as total, round(mean, 4) as mean, round(median, 4) as median, round(low, 4) as low, round(high, 4) as high, round(deviation, 4) as deviation, round(high - low, 4) as range,
 round(l - f, 4) as change, round((l - f) / f * 100, 4) as change_pct, round((power(l / f, 1.0::double / span) - 1) * 100, 4) as growth_pct from s""")
add("series_axis", lambda s, d: series.axis(points(s, d)).select("from_year", "to_year", F.round("high", 4).alias("high"), F.round("stride", 4).alias("stride")), f"""with {_counts}, a as (select min(year) as from_year, max(year) as to_year, max(value) * 1.1::double as high from p),
 b as (select *, high / 5 as raw, power(10.0::double, floor(log10(high / 5))) as pw from a)
select from_year, to_year, round(high, 4) as high, round(case when raw / pw <= 1 then 1 when raw / pw <= 2 then 2 when raw / pw <= 5 then 5 else 10 end * pw, 4) as stride from b""")

# ---- mapping
M = lambda s, d: star.mapping(s, d)
R = lambda *columns: lambda s, d: star.registrations(s, d, *columns)
_pairs = R("year", "make", "model")
_pairs_sql = f"{MAP}, pairs as (select make, model, min(year) as from_year, max(year) as to_year, count(*) as n from reg where year in (2000, 2001) group by make, model), known as (select distinct make, model from reg where year between 1995 and 1999)"
add("canonical_hierarchy", lambda s, d: mp.hierarchy(R("year", "make", "model", "model_year", "fuel_type", "vehicle_type")(s, d), YEARS), f"with {REG} select make, model, model_year, fuel_type, vehicle_type, count(*) as n from reg where year between 1995 and 1999 group by all")


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """The nested hierarchy with its lists written out: ``year:fuel=n,...;...`` and ``type=n,...``, null as ``-``."""
    out = mp.nested_hierarchy(R("year", "make", "model", "model_year", "fuel_type", "vehicle_type")(spark, sf), YEARS)
    said = lambda x, name: F.concat(F.coalesce(x[name].cast("string"), F.lit("-")), F.lit("="), x["n"].cast("string"))
    years = F.transform("model_years", lambda y: F.concat(F.coalesce(y["model_year"].cast("string"), F.lit("-")), F.lit(":"), F.array_join(F.transform(y["fuels"], lambda x: said(x, "fuel_type")), ",")))
    return out.select("make", "model", F.array_join(years, ";").alias("model_years"), F.array_join(F.transform("types", lambda x: said(x, "vehicle_type")), ",").alias("types"))


add("hierarchy_nested", nested, f"""with {REG}, h as (select make, model, model_year, fuel_type, vehicle_type, count(*) as n from reg where year between 1995 and 1999 group by all),
f as (select make, model, model_year, fuel_type, sum(n)::bigint as n from h group by all), y as (select make, model, model_year, coalesce(model_year::varchar, '-') || ':' || string_agg(coalesce(fuel_type, '-') || '=' || n, ',' order by fuel_type nulls first) as s from f group by make, model, model_year),
t as (select make, model, vehicle_type, sum(n)::bigint as n from h group by all)
select make, model, model_years, types from (select make, model, string_agg(s, ';' order by model_year nulls first) as model_years from y group by all)
 join (select make, model, string_agg(coalesce(vehicle_type, '-') || '=' || n, ',' order by vehicle_type nulls first) as types from t group by all) using (make, model)""")
add("uncurated_pairs", lambda s, d: mp.uncurated_pairs(_pairs(s, d), YEARS).withColumn("share", F.round("share", 8)), f"with {_pairs_sql} select p.make, p.model, from_year, to_year, n, round(n::double / (select sum(n) from pairs) * 100, 8) as share, k.make is not null as is_exact_match from pairs p left join known k using (make, model)")
add("pairs_exact_match", lambda s, d: mp.uncurated_pairs(_pairs(s, d), YEARS).where("is_exact_match").select("make", "model", "n"), f"with {_pairs_sql} select make, model, n from pairs semi join known using (make, model)")
add("pair_model_years", lambda s, d: mp.pair_model_years(R("year", "make", "model", "model_year")(s, d), YEARS).select("make", "model", "model_year"), f"with {REG} select distinct make, model, model_year from reg where year in (2000, 2001) and model_year is not null")
add("pair_model_year_counts", lambda s, d: mp.pair_model_years(R("year", "make", "model", "model_year")(s, d), YEARS), f"with {REG} select make, model, model_year, count(*) as n from reg where year in (2000, 2001) and model_year is not null group by all")
add("mapping_list", lambda s, d: mp.listing(M(s, d)).withColumn("share", F.round("share", 8)), f"with {MAP} select *, round(record_count::double / (select sum(record_count) from map) * 100, 8) as share from map")
add("mapping_stats", lambda s, d: mp.stats(M(s, d), R("year")(s, d), YEARS), f"with {MAP} select count(*) as mappings, cast(coalesce(sum(record_count), 0) as bigint) as covered, (select count(*) from reg where year in (2000, 2001)) as uncurated from map")
add("detailed_stats", lambda s, d: mp.detailed_stats(R("year", "make", "model", "model_year")(s, d), M(s, d), YEARS), f"""with {MAP} select count(*) as n, count(*) filter (exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model)) as mapped,
 count(*) filter (exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model and m.vehicle_type is not null)) as with_type,
 count(*) filter (exists (select 1 from map m where m.uncurated_make = r.make and m.uncurated_model = r.model and m.model_year = r.model_year and m.fuel_type is not null)) as with_fuel from reg r where year in (2000, 2001)""")
add("pair_status", lambda s, d: mp.status(R("year", "make", "model", "model_year")(s, d), M(s, d), YEARS), f"""with {_pairs_sql}, st as (select make, model, exists (select 1 from map m where m.uncurated_make = p.make and m.uncurated_model = p.model) as mapped,
 exists (select 1 from map m where m.uncurated_make = p.make and m.uncurated_model = p.model and m.model_year is null and m.vehicle_type is not null) as typed,
 exists (select 1 from map m where m.uncurated_make = p.make and m.uncurated_model = p.model and m.model_year is not null) as yearly,
 not exists (select 1 from reg r where r.year in (2000, 2001) and r.make = p.make and r.model = p.model and r.model_year is not null and not exists (select 1 from map m where m.uncurated_make = p.make and m.uncurated_model = p.model and m.model_year = r.model_year and m.fuel_type is not null)) as covered from pairs p)
select make, model, case when typed and yearly and covered then 'complete' when mapped then 'partial' else 'unassigned' end as status from st""")
add("expand_makes", lambda s, d: mp.expand_makes(M(s, d), s.createDataFrame([("Brand#11",), ("Brand#22",)], "make string")), f"with {MAP}, a as (select unnest(['Brand#11', 'Brand#22']) as make), b as (select make from a union select canonical_make from map where uncurated_make in (select make from a)) select make from b union select uncurated_make from map where canonical_make in (select make from b)")
add("expand_pairs", lambda s, d: mp.expand_pairs(M(s, d), star.registrations(s, d, "make", "model").where("make in ('Brand#11', 'Brand#22')").distinct()), f"""with {MAP}, a as (select distinct make, model from reg where make in ('Brand#11', 'Brand#22')), b as (select make, model from a union select canonical_make, canonical_model from map where (uncurated_make, uncurated_model) in (select (make, model) from a))
select make, model from b union select uncurated_make, uncurated_model from map where (canonical_make, canonical_model) in (select (make, model) from b)""")
_exact = f"{_pairs_sql}, ex as (select make, model from pairs semi join known using (make, model) where not exists (select 1 from map m where m.uncurated_make = pairs.make and m.uncurated_model = pairs.model))"
add("auto_regularize_wildcard", lambda s, d: mp.auto_wildcards(R("year", "make", "model", "model_year", "vehicle_type")(s, d), M(s, d), YEARS, ("PROMO", "SMALL")), f"with {_exact}, t as (select make, model, list(distinct vehicle_type) as types from reg where year between 1995 and 1999 and vehicle_type is not null group by make, model) select make, model, case when len(types) = 1 then types[1] when list_contains(types, 'PROMO') then 'PROMO' when list_contains(types, 'SMALL') then 'SMALL' end as vehicle_type from ex left join t using (make, model)")
add("auto_regularize_triplets", lambda s, d: mp.auto_triplets(R("year", "make", "model", "model_year", "fuel_type")(s, d), M(s, d), YEARS), f"with {_exact}, y as (select distinct make, model, model_year from reg where year in (2000, 2001) and model_year is not null), f as (select make, model, model_year, min(fuel_type) as fuel_type from reg where year between 1995 and 1999 and fuel_type is not null and model_year is not null group by make, model, model_year having count(distinct fuel_type) = 1) select make, model, model_year, fuel_type from ex join y using (make, model) join f using (make, model, model_year)")
add("make_rollup", lambda s, d: mp.make_rollup(M(s, d)), f"with {MAP} select uncurated_make, canonical_make, cast(sum(record_count) as bigint) as n from map group by all")
add("make_conflicts", lambda s, d: mp.make_conflicts(M(s, d).unionByName(M(s, d).where("uncurated_make = 'Brand#12'").withColumn("canonical_make", F.lit("Brand#55")))), f"with {MAP}, m as (select uncurated_make, canonical_make from map union all select uncurated_make, 'Brand#55' from map where uncurated_make = 'Brand#12') select uncurated_make, count(distinct canonical_make) as n from m group by 1 having n > 1")
add("mapping_type_usage", lambda s, d: mp.type_usage(M(s, d)), f"with {MAP} select vehicle_type, count(*) as n from map where vehicle_type is not null group by 1")
add("mapping_display", lambda s, d: mp.display_info(M(s, d)), f"with {MAP} select uncurated_make, uncurated_model, min(canonical_make) as canonical_make, min(canonical_model) as canonical_model, max(record_count) as record_count, bool_or(vehicle_type is not null) as has_type, count(model_year) as model_years, count(*) filter (model_year is not null and fuel_type is not null) as with_fuel from map group by all")
add("mapping_pairs_of_type", lambda s, d: mp.pairs_of_type(M(s, d), "PROMO"), f"with {MAP} select distinct uncurated_make, uncurated_model from map where vehicle_type = 'PROMO'")
add("mapping_with_counts", lambda s, d: mp.with_counts(M(s, d).select("uncurated_make", "uncurated_model", "model_year"), R("year", "make", "model", "model_year")(s, d), YEARS).where("model_year is not null"), f"with {MAP} select uncurated_make, uncurated_model, model_year, record_count, 2000 as year_start, 2001 as year_end from map where model_year is not null")
_few = R("year", "make", "model")


def late_makes(spark: SparkSession, sf: str) -> DataFrame:
    """Makes of which curated years have been taken away."""
    facts = _few(spark, sf).where("not (year < 2000 and make in ('Brand#13', 'Brand#24'))")
    return mp.uncurated_only_makes(facts, YEARS)


add("uncurated_only_makes", late_makes, f"with {REG} select make, count(*) as n from reg where year in (2000, 2001) and make in ('Brand#13', 'Brand#24') group by make")


def delete_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping without all rows of a pair and without the row of another that has no model year."""
    table = M(spark, sf)
    ends = table.where("uncurated_make = 'Brand#12'").agg(F.min("uncurated_model").alias("low"), F.max("uncurated_model").alias("high")).first()
    left = mp.delete(mp.delete(table, "Brand#12", ends.low or "", whole_pair=True), "Brand#12", ends.high or "")
    return left.groupBy("uncurated_make", "uncurated_model").agg(F.count(F.lit(1)).alias("n"))


add("mapping_delete_pair", delete_pair, f"""with {MAP}, e as (select min(uncurated_model) as low, max(uncurated_model) as high from map where uncurated_make = 'Brand#12')
select uncurated_make, uncurated_model, count(*) as n from map, e where not (uncurated_make = 'Brand#12' and (uncurated_model = low or uncurated_model = high and model_year is null)) group by 1, 2""")
add("mapping_save", lambda s, d: mp.save(M(s, d), M(s, d).where("uncurated_make = 'Brand#12' and model_year is null").withColumn("vehicle_type", F.lit("LARGE"))), f"with {MAP} select * replace (case when uncurated_make = 'Brand#12' and model_year is null then 'LARGE' else vehicle_type end as vehicle_type) from map")

# ---- dimensions
add("dim_years_union", lambda s, d: dims.years_of(R("year")(s, d), star.licences(s, d)), f"with {REG}, {LIC} select year from reg union select year from lic")
add("dim_regions", lambda s, d: star.read(s, d, "region").select(dims.display(F.col("r_name"), F.col("r_regionkey").cast("string")).alias("display_name")), "select r_name || ' (' || r_regionkey || ')' as display_name from region")
add("dim_mrcs", lambda s, d: star.read(s, d, "nation").select(dims.display(F.col("n_name"), F.col("n_nationkey").cast("string")).alias("display_name")), "select n_name || ' (' || n_nationkey || ')' as display_name from nation")


def municipalities(spark: SparkSession, sf: str) -> DataFrame:
    codes = dims.values(star.registrations(spark, sf, "municipality"), "municipality")
    names = star.read(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("municipality"), F.col("s_name").alias("name"))
    return dims.named(codes, names, "municipality", "name").select(dims.unlisted(F.col("name"), F.col("municipality")).alias("display_name"))


add("dim_municipality_unlisted", municipalities, f"with {REG} select case when s_suppkey is null then 'Unlisted (' || municipality || ')' else s_name || ' (' || municipality || ')' end as display_name from (select distinct municipality from reg) left join supplier on cast(s_suppkey as varchar) = municipality and s_suppkey % 3 = 0")
for _column in ("max_axles", "color", "vehicle_class", "vehicle_type", "make", "model_year", "fuel_type"):
    add(f"dim_{_column}", (lambda c: lambda s, d: dims.values(star.registrations(s, d, c), c))(_column), f"with {REG} select distinct {_column} from reg where {_column} is not null")
add("dim_surrogate_ids", lambda s, d: dims.surrogate_ids(s.createDataFrame([(5, "Brand#33"), (9, "Brand#11")], "id int, make string"), star.registrations(s, d, "make"), "make"), f"with {REG}, e as (select * from (values (5, 'Brand#33'), (9, 'Brand#11')) as t(id, make)) select id, make from e union all select cast(9 + row_number() over (order by make) as int), make from (select distinct make from reg where make not in (select make from e))")
add("make_badges", lambda s, d: dims.make_badges(_few(s, d), M(s, d), YEARS), f"""with {MAP}, c as (select make, count(*) filter (year < 2000) as curated, count(*) filter (year >= 2000) as n from reg group by make), t as (select uncurated_make as make, min(canonical_make) as dest, sum(record_count)::bigint as m from map where uncurated_make <> canonical_make group by 1)
select make, case when dest is not null then make || ' → ' || dest || ' (' || m || ' records)' when curated = 0 and n > 0 then make || ' [uncurated: ' || n || ' records]' else make end as display_name from c left join t using (make)""")
add("model_badges", lambda s, d: dims.model_badges(_few(s, d), M(s, d), YEARS), f"""with {MAP}, c as (select make, model, count(*) filter (year < 2000) as curated, count(*) filter (year >= 2000) as n from reg group by all), t as (select uncurated_make as make, uncurated_model as model, min(canonical_make) as dest, sum(record_count)::bigint as m from map group by all)
select make, model, case when dest is not null then model || ' (' || make || ') → ' || model || ' (' || dest || ') (' || m || ' records)' when curated = 0 and n > 0 then model || ' (' || make || ') [uncurated: ' || n || ' records]' else model || ' (' || make || ')' end as display_name from c left join t using (make, model)""")
add("models_for_makes", lambda s, d: dims.models_of(star.registrations(s, d, "make", "model"), ("Brand#11", "Brand#12")), f"with {REG} select distinct make, model from reg where make in ('Brand#11', 'Brand#12')")
add("licence_classes_present", lambda s, d: dims.classes_present(star.licences(s, d)), f"with {LIC} " + " union all ".join(f"select '{n}' as licence_class, count(*) as n from lic where {c} having n > 0" for n, c in dims.LICENCE_CLASSES.items()))
add("db_stats", lambda s, d: dims.table_stats(R("year", "make", "model", "municipality", "admin_region")(s, d), "make", "model", "municipality", "admin_region"), f"with {REG} select count(*) as n, min(year) as from_year, max(year) as to_year, count(distinct make) as n_make, count(distinct model) as n_model, count(distinct municipality) as n_municipality, count(distinct admin_region) as n_admin_region from reg")
add("licence_stats", lambda s, d: dims.table_stats(star.licences(s, d), "mrc", "age_group"), f"with {LIC} select count(*) as n, min(year) as from_year, max(year) as to_year, count(distinct mrc) as n_mrc, count(distinct age_group) as n_age_group from lic")


def places(spark: SparkSession, sf: str) -> DataFrame:
    r = star.read(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("adminRegion").alias("type"), F.lit(None).cast("string").alias("parent_code"))
    n = star.read(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey"), "n_name", F.lit("mrc"), F.concat(F.lit("R"), "n_regionkey"))
    return r.union(n).union(star.read(spark, sf, "supplier").select(F.concat(F.lit("M"), "s_suppkey"), "s_name", F.lit("municipality"), F.concat(F.lit("N"), "s_nationkey")))


add("geo_children", lambda s, d: dims.children(places(s, d), "R3").select("code", "name", "type"), "select 'N' || n_nationkey as code, n_name as name, 'mrc' as type from nation where n_regionkey = 3")
add("geo_levels", lambda s, d: places(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "select 'adminRegion' as type, count(*) as n from region union all select 'mrc', count(*) from nation union all select 'municipality', count(*) from supplier")
add("dim_resolve", lambda s, d: dims.resolve(dims.surrogate_ids(s.createDataFrame([], "id int, make string"), star.registrations(s, d, "make"), "make"), "make", "brand#3", fuzzy=True), f"with {REG} select cast(row_number() over (order by make) as int) as id, make from (select distinct make from reg) qualify make like 'Brand#3%' order by id limit 1")

# ---- ingest
_seq = "sequence, year, make, model, vehicle_class, color, net_mass, model_year, mrc, municipality, cylinder_count, vehicle_type, fuel_type"


def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.store import last_wins

    facts = star.registrations(spark, sf)
    order = [F.desc_nulls_last(c) for c in ("municipality", "make", "model", "net_mass", "model_year", "fuel_type", "cylinder_count", "vehicle_type")]
    return last_wins(facts, ["year", "sequence"], order).select("year", "sequence", "make", "model", "municipality", "net_mass")


add("dedupe_last_wins", dedupe, f"with {REG} select year, sequence, make, model, municipality, net_mass from reg qualify row_number() over (partition by year, sequence order by municipality desc nulls last, make desc, model desc, net_mass desc, model_year desc nulls last, fuel_type desc nulls last, cylinder_count desc, vehicle_type desc nulls last) = 1")


def over(table: str, columns: Callable[[], list[tuple[str, Column]]]) -> Query:
    """Distinct values of some expressions over a table; columns are made when the query is."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return star.read(spark, sf, table).select(*[c.alias(n) for n, c in columns()]).distinct()

    return run


_nc = lambda: F.concat(F.initcap("n_name"), F.lit(" ( "), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" )"))
_nc_sql = "select n_name as raw_name, lpad(cast(n_nationkey as varchar), 2, '0') as code from nation"
add("name_code_split", over("nation", lambda: [("name", F.upper(tx.name_of(_nc()))), ("code", tx.code_of(_nc())), ("last_name", F.upper(tx.last_name_of(_nc()))), ("last_code", tx.last_code_of(_nc())), ("trailing", tx.trailing_code(_nc()))]), "select n_name as name, lpad(cast(n_nationkey as varchar), 2, '0') as code, n_name as last_name, lpad(cast(n_nationkey as varchar), 2, '0') as last_code, lpad(cast(n_nationkey as varchar), 2, '0') as trailing from nation")
add("region_normalise", over("region", lambda: [("name", tx.space_region(F.concat("r_name", F.lit("(0"), F.col("r_regionkey").cast("string"), F.lit(")"))))]), "select r_name || ' (0' || r_regionkey || ')' as name from region")
_damaged = lambda: F.replace(F.replace("n_name", F.lit("A"), F.lit("Ã©")), F.lit("I"), F.lit("Ã´"))
add("mojibake_fix", over("nation", lambda: [("name", tx.repair_mojibake(_damaged()))]), "select replace(replace(n_name, 'A', 'é'), 'I', 'ô') as name from nation")
_text = lambda: F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat("p_size", F.lit(".0"))).otherwise("n/a")
add("safe_cast", over("part", lambda: [("size", F.col("p_size")), ("as_int", tx.to_int(_text())), ("as_double", tx.to_double(_text()))]), "select distinct p_size as size, case when p_size % 3 = 0 then cast(p_size as int) end as as_int, case when p_size % 3 in (0, 1) then cast(p_size as double) end as as_double from part")
add("year_from_filename", over("customer", lambda: [("c_custkey", F.col("c_custkey")), ("year", tx.year_in_name(F.concat(F.lit("/in/12345_v"), 2000 + F.col("c_custkey") % 25, F.lit("_01.csv"))))]), "select c_custkey, cast(2000 + c_custkey % 25 as int) as year from customer")
_accents = lambda: F.translate("n_name", "AEIOU", "ÀÉÎÔÜ")
add("accent_strip", over("nation", lambda: [("name", tx.strip_accents(_accents())), ("normal", tx.normal_name(_accents()))]), "select n_name as name, lower(n_name) as normal from nation")
add("blank_to_null", over("orders", lambda: [("o_orderkey", F.col("o_orderkey")), ("value", tx.blank_to_null(F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))))]), "select o_orderkey, case when o_orderkey % 2 <> 0 then o_orderpriority end as value from orders")
add("default_sequence", over("orders", lambda: [("o_orderkey", F.col("o_orderkey")), ("sequence", F.coalesce(tx.blank_to_null(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderkey").cast("string"))), F.concat(F.year("o_orderdate").cast("string"), F.lit("_UNKNOWN"))))]), "select o_orderkey, case when o_orderkey % 7 = 0 then year(o_orderdate) || '_UNKNOWN' else cast(o_orderkey as varchar) end as sequence from orders")
add("badge_strip", over("part", lambda: [("model", tx.strip_model_badge(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") → X")))), ("make", tx.strip_make_badge(F.concat("p_brand", F.lit(" → Y (3 records)")))), ("make2", tx.strip_make_badge(F.concat("p_brand", F.lit(" [uncurated: 3 records]"))))]), "select distinct p_name as model, p_brand as make, p_brand as make2 from part")
add("rating", over("lineitem", lambda: [("n", F.col("l_quantity")), ("rating", tx.rating(F.col("l_quantity")))]), "select distinct l_quantity as n, case when l_quantity < 1 then 'excellent' when l_quantity < 5 then 'good' when l_quantity < 10 then 'acceptable' when l_quantity < 25 then 'slow' else 'very slow' end as rating from lineitem")
add("yes_flag", over("orders", lambda: [("status", F.col("o_orderstatus")), ("yes", tx.yes(F.when(F.col("o_orderstatus") == "F", "OUI").when(F.col("o_orderstatus") == "O", "NON")))]), "select distinct o_orderstatus as status, o_orderstatus = 'F' as yes from orders")

# ---- resolution
_brand_pairs = lambda s, d: star.read(s, d, "part").select("p_brand", "p_name").distinct()


def unknown_known(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All pairs of make and model, damaged (a sign and a letter changed) and as they are."""
    pairs = _brand_pairs(spark, sf)
    unknown = pairs.select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("make"), F.concat(F.substring("p_name", 1, 4), F.lit("0"), F.expr("substring(p_name, 6)")).alias("model")).distinct()
    return unknown, pairs.select(F.col("p_brand").alias("canonical_make"), F.col("p_name").alias("canonical_model"))


_dict = "names as (select distinct p_name, p_brand from part), u as (select distinct replace(p_brand, '#', '-') as make, substr(p_name, 1, 4) || '0' || substr(p_name, 6) as model from names), k as (select p_brand as canonical_make, p_name as canonical_model from names)"
_lev = lambda a, b: f"(1.0::double - levenshtein(upper({a}), upper({b}))::double / greatest(length({a}), length({b}))::double)"
_top = "select make, model, canonical_make, canonical_model, round(score, 6) as score from c where score >= {t} qualify row_number() over (partition by make, model order by score desc, canonical_make, canonical_model) = 1"
_r6 = lambda df: df.withColumn("score", F.round("score", 6))


def close_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models of an edit similarity of 0.6 or more."""
    unknown, known = unknown_known(spark, sf)
    met = resolve.close_strings(unknown.select(F.col("model").alias("a")), known.select(F.col("canonical_model").alias("b")), 0.6)
    return met.select(F.col("a").alias("model"), F.col("b").alias("canonical_model"), F.round(sim.edit_similarity(F.col("a"), F.col("b")), 8).alias("score"))


add("lev_similarity", close_models, f"with {_dict}, m as (select distinct model from u), n as (select distinct canonical_model from k) select model, canonical_model, round({_lev('model', 'canonical_model')}, 8) as score from m, n where {_lev('model', 'canonical_model')} >= 0.6::double")
add("best_match_weighted", lambda s, d: _r6(resolve.best_weighted(*unknown_known(s, d))), f"with {_dict}, c as (select *, case when {_lev('make', 'canonical_make')} >= 0.7 then 0.7::double * {_lev('make', 'canonical_make')} + 0.3::double * {_lev('model', 'canonical_model')} else 0 end as score from u, k) " + _top.format(t="0.7"))
add("best_match_concat", lambda s, d: _r6(resolve.best_joined(*unknown_known(s, d))), f"with {_dict}, c as (select *, case when replace(model, '-', '') = replace(canonical_model, '-', '') and model <> canonical_model then 0.99::double else {_lev('make || model', 'canonical_make || canonical_model')} end as score from u, k) " + _top.format(t="0.4"))
add("standard_makes", lambda s, d: _r6(resolve.standard_makes(*unknown_known(s, d))), f"with {_dict}, c as (select *, {_lev('make', 'canonical_make')} as score from (select distinct make from u), (select distinct canonical_make from k)) select make, canonical_make, round(score, 6) as score from c where score >= 0.4 qualify row_number() over (partition by make order by score desc, canonical_make) = 1")
add("best_match_blocked", lambda s, d: _r6(resolve.best_blocked((lambda u: u.withColumn("make", F.replace("make", F.lit("-"), F.lit("#"))))(unknown_known(s, d)[0]), unknown_known(s, d)[1])))
add("jaro_winkler", lambda s, d: (lambda u, k: u.join(k, F.replace("make", F.lit("-"), F.lit("#")) == F.col("canonical_make")).select("model", "canonical_model", F.round(sim.jaro_winkler(F.col("model"), F.col("canonical_model")), 6).alias("score")).distinct())(*unknown_known(s, d)))
_codes_sql = "select distinct replace(p_brand, 'Brand#', 'CX') as a, 'CX-' || ((p_size % 5 + 1) * 10 + 3) as b from part"


def codes(columns: Callable[[], list[tuple[str, Column]]]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = F.replace("p_brand", F.lit("Brand#"), F.lit("CX"))
        b = F.concat(F.lit("CX-"), ((F.col("p_size") % 5 + 1) * 10 + 3).cast("string"))
        return star.read(spark, sf, "part").select(a.alias("a"), b.alias("b")).distinct().select("a", "b", *[c.alias(n) for n, c in columns()])

    return run


add("hyphen_boost", codes(lambda: [("score", sim.hyphen_boost(F.col("a"), F.col("b"), F.lit(0.5)))]), f"select a, b, case when a = replace(b, '-', '') then 0.99::double else 0.5::double end as score from ({_codes_sql})")
add("numeric_difference", codes(lambda: [("differs", sim.numeric_difference(F.col("a"), F.col("b")))]), f"select a, b, abs(x - y)::double / least(x, y) > 0.15 as differs from (select *, cast(substr(a, 3) as int) as x, cast(substr(b, 4) as int) as y from ({_codes_sql}))")
add("hyphen_variant", codes(lambda: [("variant", sim.hyphenated(F.col("a")))]), f"select a, b, 'CX-' || substr(a, 3) as variant from ({_codes_sql})")
_pat = lambda: F.concat(F.upper(F.substring("p_name", 1, 3)), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("250"))
add("model_patterns", over("part", lambda: [("model", _pat()), ("motorcycle", sim.motorcycle_model(_pat())), ("passenger", sim.passenger_model(_pat()))]), "select distinct m as model, regexp_matches(m, 'CBR|GSX|NINJA|R1250|R1200|FZ|MT-|YZF|ZX|VFR|HAYABUSA|SUPER|STREET|^[A-Z]{2,4}[0-9]{3,4}$') as motorcycle, regexp_matches(m, '^[A-Z]{3,8}$|^[A-Z]{1,2}-?[0-9]{1,3}[A-Z]{0,2}$') as passenger from (select upper(substr(p_name, 1, 3)) || case when p_size % 2 = 0 then cast(p_size as varchar) else '250' end as m from part)")
add("make_variants", over("part", lambda: [("make", F.col("p_brand")), ("normal", sim.normal_make(F.when(F.col("p_brand") == "Brand#11", "Volv0").otherwise(F.col("p_brand"))))]), "select distinct p_brand as make, case when p_brand = 'Brand#11' then 'VOLVO' else upper(p_brand) end as normal from part")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("int")
    table = star.read(spark, sf, "part").select((2010 + size % 16).alias("a"), (2010 + size % 16 + key % 3).alias("b"), (2009 + key % 14).alias("x"), (2009 + key % 14 + size % 4).alias("y")).distinct()
    e = resolve.temporal_evidence(F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    return table.withColumn("e", e).select("a", "b", "x", "y", "e.decision", "e.confidence")


add("temporal_evidence", spans, """with t as (select distinct cast(2010 + p_size % 16 as int) as a, cast(2010 + p_size % 16 + p_partkey % 3 as int) as b, cast(2009 + p_partkey % 14 as int) as x, cast(2009 + p_partkey % 14 + p_size % 4 as int) as y from part)
select a, b, x, y, case when not (b < x or y < a) then 'SUPPORT' when a >= 2023 and y <= 2022 then 'NEUTRAL' else 'PREVENT' end as decision,
 case when not (b < x or y < a) then 0.9::double when a >= 2023 and y <= 2022 then 0.7::double when a > y + 2 then 0.8::double else 0.75::double end as confidence from t""")
_kinds = lambda: F.array(F.lit("PAU"), F.lit("CAU"), F.lit("PMC"), F.lit("BCA"), F.lit(None).cast("string"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    table = star.read(spark, sf, "part").select(F.get(_kinds(), (F.col("p_size") % 5).cast("int")).alias("own"), F.get(_kinds(), (F.col("p_partkey") % 5).cast("int")).alias("other")).distinct()
    return table.withColumn("e", resolve.reference_evidence(F.col("own"), F.col("other"), F.array(F.lit("PAU"), F.lit("TAB")))).select("own", "other", "e.decision", "e.confidence")


add("reference_evidence", evidence, """with t as (select distinct ['PAU','CAU','PMC','BCA',null][p_size % 5 + 1] as own, ['PAU','CAU','PMC','BCA',null][p_partkey % 5 + 1] as other from part)
select own, other, case when own is null and other is null then 'NEUTRAL' when own is null then 'SUPPORT' when other is null then case when own = 'PAU' then 'NEUTRAL' else 'PREVENT' end
 when own = other or (own in ('PAU','CAU') and other in ('PAU','CAU')) then 'SUPPORT' else 'PREVENT' end as decision,
 case when own is null and other is null then 0::double when own is null then 0.65::double when other is null then case when own = 'PAU' then 0.6::double else 0.75::double end
 when own = other then 0.95::double when own in ('PAU','CAU') and other in ('PAU','CAU') then 0.85::double when own in ('PAU','CAU') and other = 'PMC' or own = 'PMC' and other in ('PAU','CAU') then 0.99::double else 0.85::double end as confidence from t""")


def cascade(spark: SparkSession, sf: str) -> DataFrame:
    part = star.read(spark, sf, "part").select((0.70 + F.col("p_size") % 31 / 100).cast("double").alias("score"), F.concat(F.lit("AB"), (F.col("p_size") % 7).cast("string")).alias("model"), F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("AB"), (F.col("p_size") % 5).cast("string"))).alias("canonical_model"), F.get(_kinds(), (F.col("p_partkey") % 5).cast("int")).alias("own"), F.col("p_retailprice").cast("int").alias("y")).withColumn("score", F.round("score", 2))
    e = resolve.reference_evidence(F.col("own"), F.lit("PAU"), F.array())
    t = resolve.temporal_evidence(F.lit(2018), F.lit(2020), F.col("y") % 8 + 2010, F.col("y") % 8 + 2012)
    return part.select("score", "model", "canonical_model", "own", "y", resolve.decide(F.col("score"), F.col("model"), F.col("canonical_model"), e, t).alias("decision")).distinct()


add("decision_cascade", cascade, """with t as (select distinct round(0.70::double + p_size % 31 / 100.0::double, 2) as score, 'AB' || p_size % 7 as model, case when p_partkey % 11 <> 0 then 'AB' || p_size % 5 end as canonical_model, ['PAU','CAU','PMC','BCA',null][p_partkey % 5 + 1] as own, cast(trunc(p_retailprice) as int) as y, p_size % 7 as a, p_size % 5 as b from part),
e as (select *, y % 8 + 2010 as x0, y % 8 + 2012 as x1 from t), f as (select *, not (2020 < x0 or x1 < 2018) as fits from e)
select distinct score, model, canonical_model, own, y, case when canonical_model is null then 'NEW' when a > 0 and b > 0 and abs(a - b)::double / least(a, b) > 0.15 then 'PRESERVE' when score >= 0.99 then 'REGULARIZE' when own = 'PMC' then 'PRESERVE'
 when score >= 0.90 and (own in ('PAU', 'CAU') or own is null) and fits then 'REGULARIZE' else 'REVIEW' end as decision from f""")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of pairs, the sets of makes being made from classes of the facts."""
    facts = star.registrations(spark, sf, "make", "model", "vehicle_class")
    of = facts.groupBy("make").agg(F.count_if(F.col("vehicle_class") == "BUILDING").alias("p"), F.count_if(F.col("vehicle_class") == "MACHINERY").alias("m"), F.count_if(F.col("vehicle_class") == "FURNITURE").alias("s"))
    pairs = facts.select("make", "model").distinct().join(of, "make")
    kind = resolve.classify(F.col("model"), F.lit(None).cast("string"), F.col("p") % 2 == 0, F.col("m") % 2 == 0, F.col("s") % 2 == 0)
    return pairs.withColumn("k", kind).select("make", "model", "k.kind", "k.confidence")


_moto = "regexp_matches(upper(model), 'CBR|GSX|NINJA|R1250|R1200|FZ|MT-|YZF|ZX|VFR|HAYABUSA|SUPER|STREET|^[A-Z]{2,4}[0-9]{3,4}$')"
_pass = "regexp_matches(upper(model), '^[A-Z]{3,8}$|^[A-Z]{1,2}-?[0-9]{1,3}[A-Z]{0,2}$')"
add("vehicle_kind", classified, f"""with {REG}, o as (select make, count(*) filter (vehicle_class = 'BUILDING') % 2 = 0 as p, count(*) filter (vehicle_class = 'MACHINERY') % 2 = 0 as m, count(*) filter (vehicle_class = 'FURNITURE') % 2 = 0 as s from reg group by make), t as (select distinct make, model from reg)
select make, model, case when p and m and {_moto} then 'MOTORCYCLE' when p then 'PAU/CAU' when m then 'MOTORCYCLE' when s then 'SPECIALIZED' when {_moto} then 'MOTORCYCLE' when {_pass} then 'PAU/CAU' else 'UNKNOWN' end as kind,
 case when p and m and {_moto} then 0.80::double when p and {_pass} then 0.85::double when p then 0.70::double when m or s then 0.85::double when {_moto} then 0.70::double when {_pass} then 0.60::double else 0.30::double end as confidence from t join o using (make)""")
_ref = lambda s, d: resolve.reference_keys(star.read(s, d, "part").select(F.col("p_brand").alias("make"), F.concat("p_name", F.lit(" "), F.when(F.col("p_size") % 3 == 0, "Minivan").when(F.col("p_size") % 3 == 1, "Sedan Coupe").otherwise("4x4")).alias("model")))
_ref_sql = "(select distinct p_brand as make, p_name || ' ' || case p_size % 3 when 0 then 'Minivan' when 1 then 'Sedan Coupe' else '4x4' end as model, upper(substr(p_brand, 1, 5)) as ref_make, upper(substr(split_part(p_name, ' ', 1), 1, 5)) as ref_model, case p_size % 3 when 0 then 'MINIVAN' when 1 then 'SEDAN' end as ref_type from part)"
add("reference_keys", lambda s, d: _ref(s, d).distinct(), f"select * from {_ref_sql}")
add("reference_stats", lambda s, d: profile.reference_stats(_ref(s, d).distinct()), f"select count(distinct make) as makes, count(distinct model) as models, count(distinct ref_type) as types, count(*) as n from {_ref_sql}")


def corrected(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.createDataFrame([("brand#11", None), ("BRAND#12", None)], "from_make string, x string").drop("x")
    models = star.read(spark, sf, "part").select(F.col("p_name").alias("from_model")).distinct()
    c = c.crossJoin(models).withColumns({"to_make": F.lit("Brand#99"), "to_model": F.concat(F.lit("new "), "from_model")})
    return resolve.correct(star.registrations(spark, sf, "year", "make", "model"), c).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"))


add("apply_corrections", corrected, f"with {REG} select case when make in ('Brand#11', 'Brand#12') then 'Brand#99' else make end as make, case when make in ('Brand#11', 'Brand#12') then 'new ' || model else model end as model, count(*) as n from reg group by 1, 2")

# ---- profiles
add("availability", lambda s, d: profile.availability(R("year", "vehicle_type", "fuel_type", "model_year")(s, d), "vehicle_type", "fuel_type", "model_year"), f"with {REG} select year, count(*) as n, count(vehicle_type) as with_vehicle_type, count(distinct vehicle_type) as distinct_vehicle_type, count(fuel_type) as with_fuel_type, count(distinct fuel_type) as distinct_fuel_type, count(model_year) as with_model_year, count(distinct model_year) as distinct_model_year from reg group by year")
add("fingerprint", lambda s, d: profile.fingerprint(R("year", "make", "model", "vehicle_class", "fuel_type", "net_mass", "cylinder_count", "displacement", "model_year")(s, d), 5), f"with {REG} select make, model, vehicle_class, fuel_type, count(*) as n, round(avg(net_mass), 1) as mass, round(avg(cylinder_count), 1) as cylinders, round(avg(displacement), 1) as displacement, min(model_year) as from_model_year, max(model_year) as to_model_year from reg group by all having n > 5")
add("fingerprint_like", lambda s, d: profile.fingerprint(R("year", "make", "model", "vehicle_class", "fuel_type", "net_mass", "cylinder_count", "displacement", "model_year")(s, d), 1, "%a%").select("make", "model", "vehicle_class", "fuel_type", "n"), f"with {REG} select make, model, vehicle_class, fuel_type, count(*) as n from reg where model like '%a%' group by all having n > 1")
add("alnum_by_class", lambda s, d: profile.alphanumeric_by_class(star.registrations(s, d, "vehicle_class", "make").withColumnRenamed("make", "model")), f"with {REG} select vehicle_class, count(*) filter (regexp_matches(make, '[0-9]')) as with_digits, count(*) filter (not regexp_matches(make, '[0-9]')) as without_digits from (select distinct vehicle_class, make from reg) group by 1")
add("year_model_hist", lambda s, d: profile.year_histogram(R("year", "model_year")(s, d), 100, 30), f"with {REG} select year, model_year, count(*) as n from reg group by all having n > 100 order by n desc, year, model_year nulls first limit 30")
add("model_year_range", lambda s, d: profile.model_year_range(R("year", "make", "model", "model_year")(s, d)), f"with {REG} select make, model, min(model_year) as low, max(model_year) as high, count(distinct model_year) as distinct_years, count(*) as n from reg group by all")
add("age_distribution", lambda s, d: profile.age_distribution(R("year", "model_year")(s, d)), f"with {REG} select year - model_year as age, count(*) as n, round(count(*)::double * 100 / (select count(model_year) from reg)::double, 2) as share from reg where model_year is not null group by 1 having age between -1 and 10")
add("first_last_seen", lambda s, d: profile.first_last_seen(_few(s, d), 1995), f"with {REG} select make, model, min(year) as first_year, max(year) as last_year, count(*) as n from reg group by all having first_year >= 1995")
add("model_evolution", lambda s, d: profile.model_evolution(R("year", "make", "model", "model_year")(s, d), "Brand#11"), f"with {REG} select model, year, model_year, count(*) as n from reg where make = 'Brand#11' group by all")
add("future_model_years", lambda s, d: profile.future_model_years(R("year", "model_year")(s, d)), f"with {REG} select year, model_year, count(*) as n from reg where model_year > year group by all")
add("class_list_per_pair", lambda s, d: profile.classes_of_pairs(R("year", "make", "model", "vehicle_class")(s, d)), f"with {REG} select make, model, string_agg(distinct vehicle_class, ',' order by vehicle_class) as classes, min(year) as from_year, max(year) as to_year from reg group by all")
add("minus_known", lambda s, d: (lambda f: f.where("year >= 2000").select("make", "model_year").subtract(f.where("year < 1997").select("make", "model_year")).where("model_year is not null"))(R("year", "make", "model_year")(s, d).distinct()), f"with {REG} select distinct make, model_year from reg where year >= 2000 and model_year is not null except select make, model_year from reg where year < 1997")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of fuel R in Europe by year, with zeroes for the years asked for that have none."""
    spec = FilterSpec(years=ALL_YEARS, regions=("EUROPE",), fuels=("R",))
    return series.zero_fill(points(spark, sf, spec), ALL_YEARS)


add("flagship", flagship, f"with {REG} select cast(y as int) as year, coalesce(value, 0) as value from unnest([1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001]) as t(y) left join (select year, count(*)::double as value from reg where admin_region = 'EUROPE' and fuel_type = 'R' group by year) p on p.year = y")

from . import intake  # noqa: E402, F401  (registers its queries too)
