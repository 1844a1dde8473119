"""The two fact families and a mapping, derived from the order tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import AGE_GROUPS, EXPERIENCE, Years
from ..functions.text import rounded

#: Curated and uncurated years of the order tables.
YEARS = Years((1995, 1996, 1997, 1998, 1999), (2000, 2001), 1997)
#: Columns that a dimension table is joined for; each foreign key has exactly one match, so that a table whose columns are not read need not be joined.
_PART = {"vehicle_type", "make", "model", "model_year", "displacement", "displacement_int", "cylinder_count", "max_axles"}
_NATION, _REGION = {"mrc"}, {"admin_region"}
_CUSTOMER = {"vehicle_class", "max_axles"} | _NATION | _REGION


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registrations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The registration facts, or some of their columns: only the tables that these come from are joined."""
    need = set(columns) or _PART | _CUSTOMER | {"rest"}
    t = lambda name: read(spark, sf_dir, name)
    orders = t("orders")  # customers meet orders before there are lines: lines are shuffled once less, and without names of places
    if need & _CUSTOMER:
        orders = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if need & _PART:
        df = df.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    if need & (_NATION | _REGION):
        df = df.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if need & _REGION:
        df = df.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    year = F.year("o_orderdate")
    mass, size = F.col("l_quantity") * 100, F.expr("nullif(p_size % 10, 0) * 250").cast("double")
    every = {
        "year": year, "sequence": F.concat_ws("_", "l_orderkey", "l_linenumber"), "vehicle_class": F.col("c_mktsegment"), "vehicle_type": F.when(year < 2000, F.col("p_type")),
        "make": F.col("p_brand"), "model": F.col("p_name"), "model_year": F.when(F.col("p_size") % 17 != 0, year - F.col("p_size") % 20 + 1).cast("int"),
        "net_mass": mass, "net_mass_int": rounded(mass), "displacement": size, "displacement_int": rounded(size), "cylinder_count": (F.col("p_size") % 8 + 1).cast("int"),
        "max_axles": F.when(F.col("c_mktsegment") == "MACHINERY", 2 + F.col("p_size") % 6).cast("int"), "color": F.col("o_orderpriority"),
        "fuel_type": F.when(year.between(1997, 1999), F.col("l_returnflag")), "admin_region": F.col("r_name"), "mrc": F.col("n_name"), "municipality": F.col("l_suppkey").cast("string"),
    }
    return df.select(*[c.alias(n) for n, c in every.items() if not columns or n in columns])


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence facts."""
    t = lambda name: read(spark, sf_dir, name)
    df = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    bit = lambda k: F.expr(f"(o_orderkey div {1 << k}) % 2 = 1")
    flags = ("learner_123", "learner_5", "learner_6a6r", "driver_1234", "driver_5", "driver_6abce", "driver_6d", "driver_8", "probationary")
    return df.select(
        F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("sequence"), pick(AGE_GROUPS, F.floor((F.col("c_acctbal") + 1000) / 1400)).alias("age_group"),
        F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M").alias("gender"), F.when(F.col("o_orderstatus") == "F", "APPRENTI").when(F.col("o_orderstatus") == "P", "PROBATOIRE").otherwise("RÉGULIER").alias("licence_type"),
        F.col("r_name").alias("admin_region"), F.col("n_name").alias("mrc"), *[bit(k).alias(f) for k, f in enumerate(flags)],
        *[pick(EXPERIENCE, (F.col("o_orderkey") + k) % 5).alias(f) for k, f in enumerate(("exp_1234", "exp_5", "exp_6abce", "exp_global"))],
    )


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping by rule: uncurated pairs of a make with an even number belong to the make before."""
    facts = registrations(spark, sf_dir, "year", "make", "model", "model_year").where(F.col("year").isin(*YEARS.uncurated))
    number = F.substring("make", 7, 9).cast("int")
    moved = facts.where(number % 2 == 0)
    to = F.concat(F.lit("Brand#"), (number - 1).cast("string"))
    common = [F.count(F.lit(1)).alias("record_count"), F.min("year").alias("year_start"), F.max("year").alias("year_end")]
    none = F.lit(None).cast("string")
    kind = F.when(F.length("model") % 3 != 0, F.when(number % 4 == 0, "PROMO").otherwise("ECONOMY"))
    fuel = F.when(F.col("model_year") % 3 == 0, "A").when(F.col("model_year") % 3 == 1, "N")
    keys = [F.col("make").alias("uncurated_make"), F.col("model").alias("uncurated_model")]
    whole = moved.groupBy("make", "model").agg(*common).select(*keys, F.lit(None).cast("int").alias("model_year"), to.alias("canonical_make"), F.col("model").alias("canonical_model"), none.alias("fuel_type"), kind.alias("vehicle_type"), "record_count", "year_start", "year_end")
    yearly = moved.where("model_year is not null").groupBy("make", "model", "model_year").agg(*common).select(*keys, "model_year", to.alias("canonical_make"), F.col("model").alias("canonical_model"), fuel.alias("fuel_type"), none.alias("vehicle_type"), "record_count", "year_start", "year_end")
    return whole.unionByName(yearly)


# The same rules as SQL, for the oracle.
_AGES = "[" + ", ".join(f"'{x}'" for x in AGE_GROUPS) + "]"
_EXPERIENCE = "[" + ", ".join(f"'{x}'" for x in EXPERIENCE) + "]"
_FLAGS = ", ".join(f"(o_orderkey // {1 << k}) % 2 = 1 as {f}" for k, f in enumerate(("learner_123", "learner_5", "learner_6a6r", "driver_1234", "driver_5", "driver_6abce", "driver_6d", "driver_8", "probationary")))
_EXPS = ", ".join(f"{_EXPERIENCE}[cast((o_orderkey + {k}) % 5 as int) + 1] as {f}" for k, f in enumerate(("exp_1234", "exp_5", "exp_6abce", "exp_global")))
REG = """reg as (select y as year, l_orderkey || '_' || l_linenumber as sequence, c_mktsegment as vehicle_class, case when y < 2000 then p_type end as vehicle_type,
 p_brand as make, p_name as model, cast(case when p_size % 17 <> 0 then y - p_size % 20 + 1 end as int) as model_year, l_quantity * 100 as net_mass,
 cast(nullif(p_size % 10, 0) * 250 as double) as displacement, cast(p_size % 8 + 1 as int) as cylinder_count,
 cast(case when c_mktsegment = 'MACHINERY' then 2 + p_size % 6 end as int) as max_axles, o_orderpriority as color,
 case when y between 1997 and 1999 then l_returnflag end as fuel_type, r_name as admin_region, n_name as mrc, cast(l_suppkey as varchar) as municipality
 from (select *, cast(year(o_orderdate) as int) as y from orders) join lineitem on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey)"""
LIC = f"""lic as (select cast(year(o_orderdate) as int) as year, cast(o_orderkey as varchar) as sequence, {_AGES}[cast(floor((c_acctbal + 1000) / 1400) as int) + 1] as age_group,
 case when o_custkey % 2 = 0 then 'F' else 'M' end as gender, case o_orderstatus when 'F' then 'APPRENTI' when 'P' then 'PROBATOIRE' else 'RÉGULIER' end as licence_type,
 r_name as admin_region, n_name as mrc, {_FLAGS}, {_EXPS}
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
MAP = REG + """, moved as (select *, cast(substr(make, 7) as int) as k from reg where year in (2000, 2001) and cast(substr(make, 7) as int) % 2 = 0),
map as (select make as uncurated_make, model as uncurated_model, cast(null as int) as model_year, 'Brand#' || (k - 1) as canonical_make, model as canonical_model, cast(null as varchar) as fuel_type,
 case when length(model) % 3 <> 0 then case when k % 4 = 0 then 'PROMO' else 'ECONOMY' end end as vehicle_type, count(*) as record_count, min(year) as year_start, max(year) as year_end
 from moved group by make, model, k
 union all select make, model, model_year, 'Brand#' || (k - 1), model, case model_year % 3 when 0 then 'A' when 1 then 'N' end, null, count(*), min(year), max(year)
 from moved where model_year is not null group by make, model, k, model_year)"""
