"""Queries over the sources: tables written in the layouts of the source files, read and stored again, beside the SQL of what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dims, naming
from ..operators import resolve
from ..operators.filters import EXPERIENCE_COLUMNS, FilterSpec, apply
from ..operators.metrics import Metric, query
from ..sources import imports, readers, sinks, store
from . import kept, star
from .catalog import ORACLES, chart, sql_chart
from .catalog import add as registered
from .star import LIC, MAP, REG, YEARS

#: The order tables' years as years of files that have fuel types.
LATER = 25


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Registers a query that deletes the folders it has worked in."""
    registered(name, lambda spark, sf: store.tidied(spark, lambda: query(spark, sf)), sql)


def in_bytes(value: Column, encoding: str) -> Column:
    """A line whose bytes are in an encoding: the text sink writes them as they are."""
    return value if encoding == "utf-8" else F.encode(value, encoding).cast("string")


def moved(spark: SparkSession, place: str, path: str) -> str:
    """The only file of a folder under a name of its own, which is what a source delivers."""
    folder, system = store._folder(spark, place)
    part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
    system.mkdirs(store._folder(spark, path)[0].getParent())
    system.rename(part, store._folder(spark, path)[0])
    return path


def single_file(spark: SparkSession, lines: DataFrame, path: str, encoding: str = "utf-8") -> str:
    """Writes lines (column ``value``) as one file."""
    lines.coalesce(1).select(in_bytes(F.col("value"), encoding).alias("value")).write.text(f"{path}.parts")
    return moved(spark, f"{path}.parts", path)


def delivered(spark: SparkSession, rows: DataFrame, columns: tuple[str, ...], year: str, folder: str, sep: str = ",", encoding: str = "utf-8", extra: str | None = None) -> list[str]:
    """A source for each year: a folder of compressed parts, the first with the header; values that hold the separator or an accent are quoted, ``extra`` is a line more.

    The tasks that make the lines write them, each to its years: lines are not dealt by year first.
    """
    quoted = lambda c: F.when(F.contains(c, F.lit(sep)) | F.contains(c, F.lit("é")) | F.contains(c, F.lit("è")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    texts = rows.select(F.col(year).alias("_y"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    lines = texts.select(F.col("_y").alias("y"), in_bytes(F.concat_ws(sep, *[quoted(F.col(c)) for c in columns]), encoding).alias("value"))
    place = f"{folder}/parts"
    lines.write.partitionBy("y").option("compression", "gzip").text(place)
    parts, system = store._folder(spark, place)
    years = sorted(int(x.getPath().getName()[2:]) for x in system.listStatus(parts) if x.getPath().getName().startswith("y="))  # by their folders: no line is read
    heads = [(y, "\n".join(x for x in (sep.join(columns), extra) if x)) for y in years]
    spark.createDataFrame(heads, "y int, value string").coalesce(1).write.partitionBy("y").text(f"{folder}/heads")
    out = [f"{folder}/in/file_{y}.csv" for y in years]
    for y, path in zip(years, out, strict=True):
        system.mkdirs(store._folder(spark, path)[0].getParent())
        system.rename(store._folder(spark, f"{place}/y={y}")[0], store._folder(spark, path)[0])
        moved(spark, f"{folder}/heads/y={y}", f"{path}/a.txt")  # the first by name
    return out


def with_code(name: Column, code: Column) -> Column:
    return F.concat(F.lit("Région "), name, F.lit(" ("), code, F.lit(")"))


#: What makes a row of the order tables the only one of its kind.
_KEY = ("sequence", "municipality", "make", "model", "net_mass_int", "model_year", "displacement_int", "cylinder_count", "vehicle_type")


def vehicle_files(spark: SparkSession, sf: str, folder: str, sep: str = ",", encoding: str = "utf-8", extra: str | None = None) -> list[str]:
    facts = star.registrations(spark, sf)
    values = {
        "AN": F.col("year") + LATER, "NOSEQ_VEH": F.concat_ws("-", *[F.col(c).cast("string") for c in _KEY]), "CLAS": F.col("vehicle_class"), "TYP_VEH_CATEG_USA": F.col("vehicle_type"), "MARQ_VEH": F.col("make"), "MODEL_VEH": F.col("model"),
        "ANNEE_MOD": F.col("model_year"), "MASSE_NETTE": F.col("net_mass"), "NB_CYL": F.col("cylinder_count"), "CYL_VEH": F.col("displacement"), "NB_ESIEU_MAX": F.col("max_axles"), "COUL_ORIG": F.col("color"),
        "TYP_CARBU": F.col("fuel_type"), "REG_ADM": with_code(F.lit("du Nord"), F.col("admin_region")), "MRC": with_code(F.lit("de l'Est"), F.col("mrc")), "CG_FIXE": F.col("municipality"),
    }
    return delivered(spark, facts.select(*[c.alias(n) for n, c in values.items()]), readers.VEHICLE_COLUMNS, "AN", folder, sep, encoding, extra)


_STORED = ("year", "sequence", "vehicle_class", "vehicle_type", "make", "model", "model_year", "net_mass", "displacement", "cylinder_count", "max_axles", "color", "fuel_type", "admin_region", "mrc", "municipality")
_KEY_SQL = "concat_ws('-', sequence, municipality, make, model, cast(net_mass as int), model_year, cast(displacement as int), cylinder_count, vehicle_type)"
_STORED_SQL = f"with {REG} select distinct year + {LATER} as year, {_KEY_SQL} as sequence, " + ", ".join(_STORED[2:]) + " from reg"


def imported(sep: str = ",", encoding: str = "utf-8") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        place = store.work_dir(spark)
        imports.import_files(spark, vehicle_files(spark, sf, place, sep, encoding), f"{place}/facts")
        return spark.read.parquet(f"{place}/facts").select(*_STORED)

    return run


add("import_vehicles", imported(), _STORED_SQL)
add("import_latin1", imported(";", "iso-8859-1"), _STORED_SQL)


def import_licences(spark: SparkSession, sf: str) -> DataFrame:
    place = store.work_dir(spark)
    facts = star.licences(spark, sf)
    flags, years = list(LICENCE_FLAGS), list(EXPERIENCE_COLUMNS)
    values = [F.col("year"), F.col("sequence"), F.col("age_group"), F.col("gender"), with_code(F.lit("A"), F.col("mrc")), with_code(F.lit("B (b)"), F.col("admin_region")), F.col("licence_type")]
    values += [F.when(F.col(c), "OUI").otherwise("NON") for c in flags] + [F.col(c) for c in years]
    rows = facts.select(*[c.alias(n) for n, c in zip(readers.LICENCE_COLUMNS, values, strict=True)])
    imports.import_files(spark, delivered(spark, rows, readers.LICENCE_COLUMNS, "AN", place), f"{place}/facts", family="licences")
    return spark.read.parquet(f"{place}/facts").select(*facts.columns)


LICENCE_FLAGS = ("learner_123", "learner_5", "learner_6a6r", "driver_1234", "driver_5", "driver_6abce", "driver_6d", "driver_8", "probationary")
add("import_licences", import_licences, f"with {LIC} select * from lic")


def import_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two imports of the same files, each with a line of too few fields and a blank one: years are replaced, the log has both."""
    place = store.work_dir(spark)
    files = vehicle_files(spark, sf, place, extra="2020,short\n \n")
    for _ in range(2):
        done = imports.import_files(spark, files, f"{place}/facts", f"{place}/log")
    stored = spark.read.parquet(f"{place}/facts").groupBy("year").agg(F.count(F.lit(1)).alias("stored"))
    dropped = spark.createDataFrame([(r.year, r.dropped) for r in done], "year int, dropped int")
    return spark.read.parquet(f"{place}/log").groupBy("file_name", "year", "record_count", "status").agg(F.count(F.lit(1)).alias("imports")).join(stored, "year").join(dropped, "year")


add("import_log", import_log, f"with {REG} select 'file_' || (year + {LATER}) || '.csv' as file_name, year + {LATER} as year, count(distinct {_KEY_SQL}) as record_count, 'partial' as status, 2::bigint as imports, count(distinct {_KEY_SQL}) as stored, 1 as dropped from reg group by year")


def delete_year(spark: SparkSession, sf: str) -> DataFrame:
    """Two fact tables and their log without a year."""
    place = store.work_dir(spark)
    paths = [f"{place}/vehicles", f"{place}/licences"]
    for path, facts in zip(paths, (star.registrations(spark, sf, "year", "make"), star.licences(spark, sf).select("year", "gender")), strict=True):
        store.write_years(facts, path)
    for y in (1996, 1997):
        store.log_import(spark, f"{place}/log", f"f_{y}.csv", y, y, 0, "licences")
    store.delete_year(spark, 1996, paths, f"{place}/log")
    each = [spark.read.parquet(p).groupBy("year").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("family"), "year", "n") for k, p in zip(("vehicles", "licences"), paths, strict=True)]
    log = spark.read.parquet(f"{place}/log").select(F.col("status"), "year", F.col("record_count"))
    return each[0].union(each[1]).union(log)


add("delete_year", delete_year, f"with {REG}, {LIC} select 'vehicles' as family, year, count(*) as n from reg where year <> 1996 group by year union all select 'licences', year, count(*) from lic where year <> 1996 group by year union all select 'completed', 1997, 1997")


def package(merge: bool) -> Callable[[SparkSession, str], DataFrame]:
    """A package of licences taken into a store that has registrations, or of both families into one that has registrations of other years."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        place = store.work_dir(spark)
        facts, licences = star.registrations(spark, sf, "year", "sequence", "make"), star.licences(spark, sf).select("year", "sequence", "gender")
        places = lambda n: spark.createDataFrame([(n, n)], "code string, name string")
        store.write_years(facts, f"{place}/store/registrations")
        places("here").write.parquet(f"{place}/store/places")
        tables = {"licences": licences, "places": places("there")} | ({} if merge else {"registrations": facts.where("year >= 1997")})
        store.export_package(spark, tables, f"{place}/package")
        how = store.import_package(spark, f"{place}/package", f"{place}/store", None if merge else "replace")
        counted = [spark.read.parquet(f"{place}/store/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("registrations", "licences", "places")]
        return counted[0].union(counted[1]).union(counted[2]).withColumn("mode", F.lit(how))

    return run


add("package_merge", package(True), f"with {REG}, {LIC} select 'registrations' as name, count(*) as n, 'merge' as mode from reg union all select 'licences', count(*), 'merge' from lic union all select 'places', 2, 'merge'")
add("package_replace", package(False), f"with {REG}, {LIC} select 'registrations' as name, count(*) as n, 'replace' as mode from reg where year >= 1997 union all select 'licences', count(*), 'replace' from lic union all select 'places', 1, 'replace'")


def package_rows(merge: bool) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a store after ``package``, by content."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        place = store.work_dir(spark)
        facts, licences = star.registrations(spark, sf, "year", "sequence", "make"), star.licences(spark, sf).select("year", "sequence", "gender")
        store.write_years(facts.where("year < 1999"), f"{place}/store/registrations")
        tables = {"licences": licences} | ({} if merge else {"registrations": facts.where("year >= 1997")})
        store.export_package(spark, tables, f"{place}/package")
        store.import_package(spark, f"{place}/package", f"{place}/store", None if merge else "replace")
        r, l = (spark.read.parquet(f"{place}/store/{n}") for n in ("registrations", "licences"))
        return r.select(F.lit("registrations").alias("name"), "year", "sequence", F.col("make").alias("value")).union(l.select(F.lit("licences"), "year", "sequence", "gender"))

    return run


for _name, _merge, _kept in (("package_merge_rows", True, "year < 1999"), ("package_replace_rows", False, "year >= 1997")):
    add(_name, package_rows(_merge), f"with {REG}, {LIC} select 'registrations' as name, year, sequence, make as value from reg where {_kept} union all select 'licences', year, sequence, gender from lic")


def upserted_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in buckets, of which a batch changes one make's rows and adds a row."""
    path = f"{store.work_dir(spark)}/facts"
    facts = star.registrations(spark, sf).select("year", F.concat_ws("-", *[F.col(c).cast("string") for c in _KEY]).alias("sequence"), "make", "color")
    store.upsert_buckets(spark, path, facts, buckets=8)
    changed = facts.where("make = 'Brand#11' and year <= 1996").withColumn("make", F.lit("changed"))
    store.upsert_buckets(spark, path, changed.union(spark.createDataFrame([(1980, "new", "changed", "x")], facts.schema)), buckets=8)
    return store.read_buckets(spark, path).groupBy("year", "make").agg(F.count(F.lit(1)).alias("n"))


add("upsert_buckets", upserted_buckets, f"with {REG} select year, case when make = 'Brand#11' and year <= 1996 then 'changed' else make end as make, count(distinct {_KEY_SQL}) as n from reg group by all union all select 1980, 'changed', 1")


def import_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """All files in one job: what is stored, what is rejected and why; a file with another header does not stop the others."""
    place = store.work_dir(spark)
    files = vehicle_files(spark, sf, place, extra="2020,short\n \n")
    broken = single_file(spark, spark.createDataFrame([("a,b",), ("1,é",)], "value string"), f"{place}/in/file_1990.csv")
    done = imports.import_all(spark, [*files, broken, f"{place}/in/file_1989.csv"], f"{place}/facts", f"{place}/rejects", f"{place}/log")
    stored = spark.read.parquet(f"{place}/facts").groupBy("year").agg(F.count(F.lit(1)).alias("stored"))
    bad = spark.read.parquet(f"{place}/rejects").groupBy("year", "reason", "line").agg(F.count(F.lit(1)).alias("rejected"))
    log = spark.read.parquet(f"{place}/log").select("year", "record_count", "status")
    return stored.join(bad, "year").join(log, "year").withColumn("failed", F.lit(len(done.failed)))


add("import_rejects", import_rejects, f"with {REG} select year + {LATER} as year, count(distinct {_KEY_SQL}) as stored, '2 fields in place of ' || case when year + {LATER} >= 2017 then 16 else 15 end as reason, '2020,short' as line, 1 as rejected, count(distinct {_KEY_SQL}) as record_count, 'partial' as status, 2 as failed from reg group by year")


def later_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Facts under the names of the later layout, damaged, written in the yearly layout and read back."""
    place = store.work_dir(spark)
    facts = star.registrations(spark, sf, "year", "sequence", "make", "model", "model_year", "municipality")
    region = F.concat(F.lit("("), (F.col("municipality").cast("int") % 17 + 1).cast("string"), F.lit(")"))
    period = F.concat((F.col("year") + LATER).cast("string"), F.lit("03"))
    raw = facts.select(period.alias("AnnÈe civile / mois"), F.col("make").alias("Marque"), F.concat(F.col("sequence"), F.lit(" "), F.col("model")).alias("ModËle du vÈhicule"), F.col("model_year").cast("string").alias("Année de fabrication"), region.alias("Région admin (code)"), F.concat(F.lit("VillÃ© "), "municipality").alias("Municipalité"))
    names = star.read(spark, sf, "supplier").select(F.concat(F.lit("ville "), "s_suppkey").alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("code"))
    order = [F.col(c) for c in ("model", "make", "model_year", "region", "municipality")]  # a struct of them would carry each twice
    rows = readers.normalise(imports.later_layout(raw), names, order, f"{place}/sorted")
    imports.write_yearly(rows, f"{place}/out")
    back = spark.read.option("header", True).csv(f"{place}/out")
    return back.select(F.col("AN").cast("int").alias("year"), "NOSEQ_VEH", F.col("MARQ_VEH").alias("make"), F.col("MODEL_VEH").alias("model"), F.col("ANNEE_MOD").cast("int").alias("model_year"), F.substring("REG_ADM", -4, 4).alias("region"), "CG_FIXE")


add("normalise_later_layout", later_layout, f"""with {REG}, r as (select *, year + {LATER} as y, sequence || ' ' || model as m from reg)
select y as year, y || '_' || lpad(cast(row_number() over (partition by y order by m, make, model_year nulls first, '(' || (cast(municipality as int) % 17 + 1) || ')', municipality) as varchar), 10, '0') as "NOSEQ_VEH", make, m as model, model_year,
 '(' || lpad(cast(cast(municipality as int) % 17 + 1 as varchar), 2, '0') || ')' as region, lpad(municipality, 5, '0') as "CG_FIXE" from r""")


def places_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as places in a fixed-width file."""
    place = store.work_dir(spark)
    key = F.col("s_suppkey").cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    values = {"kind": F.lit("1"), "code": F.lpad(key.cast("string"), 5, "0"), "name": F.concat("s_name", F.lit(" Ã©")), "mrc": F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), "region": two(key % 17 + 1), "population": (key * 31).cast("string"), "lat": F.concat(F.lit("45"), two(key % 60)), "lon": F.concat(F.lit("73"), two(key % 30)), "land": (key * 1500).cast("string"), "total": (key * 2500).cast("string")}
    line, at = [], 0
    for name, (start, end) in sorted(readers.PLACES.items(), key=lambda x: x[1]):
        line += [F.lit(" " * (start - at)), F.rpad(values[name], end - start, " ")]
        at = end
    lines = star.read(spark, sf, "supplier").select(F.rpad(F.concat(*line), 950, " ").alias("value")).union(spark.createDataFrame([("X header",)], "value string"))
    return readers.places(spark, single_file(spark, lines, f"{place}/places.dat", "iso-8859-1")).select("code", "name", "parent_code", "region_code", "population", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "area_total", "area_land")


add("places_fixed_width", places_fixed_width, """select lpad(cast(s_suppkey as varchar), 5, '0') as code, s_name || ' é' as name, lpad(cast(s_nationkey as varchar), 3, '0') as parent_code, lpad(cast(s_suppkey % 17 + 1 as varchar), 2, '0') as region_code, cast(s_suppkey * 31 as int) as population,
 round(45 + (s_suppkey % 60)::double / 60, 6) as latitude, round(-(73 + (s_suppkey % 30)::double / 60), 6) as longitude, s_suppkey * 2.5::double as area_total, s_suppkey * 1.5::double as area_land from supplier""")


def corrections_table(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections read from a table in a text and applied to the facts."""
    place = store.work_dir(spark)
    pairs = star.read(spark, sf, "part").select("p_brand", "p_name").distinct().where("p_brand in ('Brand#11', 'Brand#22')")
    sure = F.when(F.col("p_brand") == "Brand#11", "95").otherwise("60")
    row = F.concat(F.lit("| "), F.lower("p_brand"), F.lit(" | "), "p_name", F.lit(" | → | Brand#99 | x "), "p_name", F.lit(" | "), sure, F.lit("% |"))
    lines = spark.createDataFrame([("| from | | to |",), ("text",)], "value string").union(pairs.select(row))
    lines.write.text(f"{place}/report")
    table = readers.corrections(spark, f"{place}/report", 90)
    return resolve.correct(star.registrations(spark, sf, "make", "model"), table).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"))


add("corrections_table", corrections_table, f"with {REG} select case when make = 'Brand#11' then 'Brand#99' else make end as make, case when make = 'Brand#11' then 'x ' || model else model end as model, count(*) as n from reg group by 1, 2")


def series_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two series written to CSV and read back."""
    place = store.work_dir(spark)
    facts = star.registrations(spark, sf, "year", "fuel_type")
    sinks.all_series_csv({"All": query(facts, FilterSpec(), Metric(), YEARS), "R": query(facts, FilterSpec(fuels=("R",)), Metric(), YEARS)}, f"{place}/series")
    return spark.read.option("header", True).schema("Series string, Year int, Value double").csv(f"{place}/series").select(F.col("Series").alias("series"), F.col("Year").alias("year"), F.col("Value").alias("value"))


add("series_files", series_files, f"with {REG} select 'All' as series, year, count(*)::double as value from reg group by year union all select 'R', year, count(*)::double from reg where fuel_type = 'R' group by year")


def codes_file(spark: SparkSession, sf: str) -> DataFrame:
    """A code list as JSON, read back."""
    said = sinks.codes_json(star.read(spark, sf, "nation").withColumn("code", F.col("n_nationkey").cast("string")), "code", "n_name")
    return spark.createDataFrame([(said,)], "j string").select(F.explode(F.from_json("j", "map<string,string>")).alias("code", "name"))


add("codes_json", codes_file, "select cast(n_nationkey as varchar) as code, n_name as name from nation")


def reference_file(spark: SparkSession, sf: str) -> DataFrame:
    """A reference table in CSV, read and given its keys."""
    place = store.work_dir(spark)
    names = ("MAKE", "MODEL", "MYR", "OL", "OW", "OH", "WB", "CW", "A", "B", "C", "D", "E", "F", "G", "TWF", "TWR", "WD")
    rows = star.read(spark, sf, "part").select(F.col("p_brand"), F.concat("p_name", F.lit(" Sedan")), (F.col("p_size") + 1990).cast("string"), *[F.col("p_size").cast("double").cast("string").alias(f"x{k}") for k in range(14)], F.lit("4x2"))
    single_file(spark, spark.createDataFrame([(",".join(names),)], "value string").coalesce(1).union(rows.select(F.concat_ws(",", *rows.columns))), f"{place}/reference.csv")
    return resolve.reference_keys(readers.reference_csv(spark, f"{place}/reference.csv")).groupBy("ref_make", "ref_model", "ref_type", "myr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("twr"), 2).alias("twr"))


add("reference_file", reference_file, "select upper(substr(p_brand, 1, 5)) as ref_make, upper(substr(split_part(p_name || ' Sedan', ' ', 1), 1, 5)) as ref_model, 'SEDAN' as ref_type, cast(p_size + 1990 as int) as myr, count(*) as n, round(sum(p_size)::double, 2) as twr from part group by all")
add("place_mojibake", lambda s, d: star.read(s, d, "nation").select("n_nationkey", tx.repair_mojibake(F.replace(F.replace("n_name", F.lit("A"), F.lit("Ã¢")), F.lit("I"), F.lit("Ã®")), tx.PLACE_MOJIBAKE).alias("place"), tx.repair_mojibake(F.replace(F.replace("n_name", F.lit("A"), F.lit("Ã»")), F.lit("I"), F.lit("È")), tx.SCRIPT_MOJIBAKE).alias("script")), "select n_nationkey, replace(replace(n_name, 'A', 'â'), 'I', 'î') as place, replace(replace(n_name, 'A', 'û'), 'I', 'é') as script from nation")

# ---- makes and models with what the mapping puts beside them
_hop = "a as (select unnest([{makes}]) as make), b as (select make from a union select canonical_make from map where uncurated_make in (select make from a)), c as (select make from b union select uncurated_make from map where canonical_make in (select make from b))"
_wide = _hop.format(makes="'Brand#11', 'Brand#22'")
add("make_filter_expanded", chart(FilterSpec(makes=("Brand#11", "Brand#22"), regularize=True)), sql_chart("count(*)", "make in (select make from c)", ctes=f"{MAP}, {_wide}"))
add("curated_gate", chart(FilterSpec(makes=("Brand#11", "Brand#22"), regularize=True, curated_only=True)), sql_chart("count(*)", "make in ('Brand#11', 'Brand#22') and year between 1995 and 1999"))


def model_filter(makes: tuple[str, ...] | None, coupling: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Rows by year, make and model under a filter on all models of a make that is mapped and of one that others are mapped to."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        facts = star.registrations(spark, sf, "year", "make", "model")
        pairs = tuple((r.make, r.model) for r in facts.where("make in ('Brand#12', 'Brand#21')").select("make", "model").distinct().collect())
        spec = FilterSpec(makes=makes, models=pairs, regularize=True, coupling=coupling)
        return apply(facts, spec, YEARS, star.mapping(spark, sf)).groupBy("year", "make", "model").agg(F.count(F.lit(1)).alias("n"))

    return run


def sql_models(makes: str | None, coupling: bool) -> str:
    wide = _hop.format(makes=makes) if makes else ""
    first = "(uncurated_make, uncurated_model) in (select (make, model) from n0)" + (" and uncurated_make in (select make from c)" if makes else "")
    second = "(canonical_make, canonical_model) in (select (make, model) from n1)" + (" and canonical_make in (select make from m1)" if makes else "")
    more = ", m1 as (select make from c union select canonical_make from h1)" if makes else ""
    makes_sql = "select make from m1 union select uncurated_make from h2" if makes else "select uncurated_make from h2"
    limit = f" and make in ({makes_sql})" if makes or coupling else ""
    return f"""with {MAP}{', ' + wide if wide else ''}, n0 as (select distinct make, model from reg where make in ('Brand#12', 'Brand#21')), h1 as (select * from map where {first}),
n1 as (select make, model from n0 union select canonical_make, canonical_model from h1){more}, h2 as (select * from map where {second}), n2 as (select make, model from n1 union select uncurated_make, uncurated_model from h2)
select year, make, model, count(*) as n from reg where (make, model) in (select (make, model) from n2){limit} group by all"""


add("model_filter_expanded", model_filter(("Brand#12", "Brand#21"), True), sql_models("'Brand#12', 'Brand#21'", True))
add("model_filter_coupled", model_filter(None, True), sql_models(None, True))
add("model_filter_uncoupled", model_filter(None, False), sql_models(None, False))
_three = lambda s, d: star.registrations(s, d, "year", "make", "model").where("not (year < 2000 and make in ('Brand#13', 'Brand#24'))")
_badge = "count(*) filter (year between 1995 and 1999) as curated, count(*) filter (year in (2000, 2001)) as n"
_left = f"{MAP}, f as (select * from reg where not (year < 2000 and make in ('Brand#13', 'Brand#24')))"
add("curated_makes", lambda s, d: dims.curated_makes(_three(s, d), star.mapping(s, d), YEARS), f"""with {_left}, c as (select make, {_badge} from f group by make), t as (select uncurated_make as make, min(canonical_make) as dest, sum(record_count)::bigint as m from map where uncurated_make <> canonical_make group by 1)
select make, case when dest is not null then make || ' → ' || dest || ' (' || m || ' records)' else make end as display_name from c left join t using (make) where curated > 0""")
add("curated_models", lambda s, d: dims.curated_models(_three(s, d), star.mapping(s, d), YEARS), f"""with {_left}, c as (select make, model, {_badge} from f group by all)
select make, model, model || ' (' || make || ')' as display_name from c where curated > 0 and (make, model) not in (select (uncurated_make, uncurated_model) from map where uncurated_make <> canonical_make or uncurated_model <> canonical_model)""")
for _name, _columns in {"licence_type": ("licence_type",), "age_group": ("age_group",), "gender": ("gender",), "experience": EXPERIENCE_COLUMNS}.items():
    add(f"dim_{_name}_in_order", (lambda c: lambda s, d: dims.in_order(star.licences(s, d), *c))(_columns), f"with {LIC} select cast(row_number() over (order by value) as int) as place, value from (" + " union ".join(f"select distinct {c} as value from lic where {c} is not null" for c in _columns) + ")")
_fuel_names = lambda s, d: star.read(s, d, "nation").select(F.when(F.col("n_nationkey") == 3, "U").when(F.col("n_nationkey") == 5, "NS").otherwise(F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("description"))
add("fuels_unknown_last", lambda s, d: dims.fuels(_fuel_names(s, d)), "with t as (select case n_nationkey when 3 then 'U' when 5 then 'NS' else cast(n_nationkey as varchar) end as code, n_name as description from nation) select *, cast(row_number() over (order by code = 'U', description) as int) as place from t where code <> 'NS'")
add("vehicle_lists", lambda s, d: dims.all_lists(star.registrations(s, d), dims.VEHICLE_LISTS, YEARS), f"with {REG} " + " union all ".join(f"select '{c}' as category, cast({c} as varchar) as value, count(*) filter (year between 1995 and 1999) as curated, count(*) filter (year in (2000, 2001)) as uncurated from reg where {c} is not null group by {c}" for c in dims.VEHICLE_LISTS))
add("licence_lists", lambda s, d: dims.all_lists(star.licences(s, d), dims.LICENCE_LISTS, YEARS), f"with {LIC} " + " union all ".join(f"select '{c}' as category, cast({c} as varchar) as value, count(*) filter (year between 1995 and 1999) as curated, count(*) filter (year in (2000, 2001)) as uncurated from lic where {c} is not null group by {c}" for c in dims.LICENCE_LISTS))
add("sorted_points", lambda s, d: query(star.registrations(s, d, "year"), FilterSpec(years=(1999, 1993, 1996)), Metric(), YEARS).orderBy("year").withColumn("place", F.row_number().over(Window.orderBy("year"))), f"with {REG} select year, count(*)::double as value, cast(row_number() over (order by year) as int) as place from reg where year in (1993, 1996, 1999) group by year")
add("hygiene_for_vehicles", lambda s, d: query(star.registrations(s, d, "year", "fuel_type"), FilterSpec(fuels=("R",), genders=("F",), experience=()).for_vehicles(), Metric(), YEARS), f"with {REG} select year, count(*)::double as value from reg where fuel_type = 'R' group by year")
add("hygiene_for_licences", lambda s, d: query(star.licences(s, d), FilterSpec(genders=("F",), makes=("x",), age_ranges=((0, 1),)).for_licences(), Metric(), YEARS), f"with {LIC} select year, count(*)::double as value from lic where gender = 'F' group by year")

# ---- evidence and make-level standardisation
_spans = lambda s, d: star.read(s, d, "part").select((2010 + F.col("p_size") % 16).alias("a"), (2010 + F.col("p_size") % 16 + F.col("p_partkey") % 3).alias("b"), (2009 + F.col("p_partkey") % 14).alias("x"), (2009 + F.col("p_partkey") % 14 + F.col("p_size") % 4).alias("y")).distinct()
_spans_sql = "with t as (select distinct 2010 + p_size % 16 as a, 2010 + p_size % 16 + p_partkey % 3 as b, 2009 + p_partkey % 14 as x, 2009 + p_partkey % 14 + p_size % 4 as y from part)"
_abxy = ("a", "b", "x", "y")
add("temporal_evidence_short", lambda s, d: _spans(s, d).withColumn("e", resolve.span_evidence(*[F.col(c) for c in _abxy])).select(*_abxy, "e.*"), _spans_sql + " select *, case when not (b < x or y < a) then 'SUPPORT' else 'PREVENT' end as decision, case when not (b < x or y < a) then 0.9::double when a > y then 0.7::double else 0.8::double end as confidence from t")
add("model_year_evidence", lambda s, d: _spans(s, d).withColumn("e", resolve.model_year_evidence(*[F.col(c) for c in _abxy])).select(*_abxy, "e.*"), _spans_sql + " select *, not (b < x or y < a) or (a > y and a - y <= 2) as valid, case when not (b < x or y < a) then 0.9::double when a > y and a - y <= 2 then 0.7::double else 0.8::double end as confidence from t")


def reference_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Names as sets of words: those of a part, and a word of another, for each pair of sizes."""
    part = star.read(spark, sf, "part").select(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("u"), F.when(F.col("p_size") % 7 == 0, F.lit("")).when(F.col("p_size") % 2 == 0, F.concat(F.lit("x "), F.col("p_name"))).otherwise("zz").alias("v")).distinct()
    words = lambda c: F.array_remove(F.split(c, " "), "")
    return part.withColumn("e", resolve.set_evidence(words(F.col("u")), words(F.col("v")))).select("u", "v", "e.*").distinct()


add("set_evidence", reference_sets, """with t as (select distinct case when p_size % 5 = 0 then '' else p_name end as u, case when p_size % 7 = 0 then '' when p_size % 2 = 0 then 'x ' || p_name else 'zz' end as v from part)
select u, v, not (u <> '' and v = '') as valid, case when u = '' and v = '' then 0.5::double when v like 'x %' and u <> '' then 0.9::double when u <> '' and v = '' then 0.9::double when u = '' then 0.8::double else 0.6::double end as confidence from t""")
add("found_evidence", lambda s, d: star.read(s, d, "part").select(F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("T"), F.col("p_size") % 3)).alias("own"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("T"), F.col("p_partkey") % 3)).alias("other")).distinct().withColumn("e", resolve.found_evidence(F.col("own"), F.col("other"))).select("own", "other", "e.*"), """with t as (select distinct case when p_size % 3 > 0 then 'T' || p_size % 3 end as own, case when p_partkey % 3 > 0 then 'T' || p_partkey % 3 end as other from part)
select *, case when own is null and other is null then 'NEUTRAL' when own is null or own = other then 'SUPPORT' else 'PREVENT' end as decision, case when own is null and other is null then 0.5::double when own is null then 0.8::double else 0.9::double end as confidence from t""")


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """Makes of late years against those of early ones, with a reference table that knows some of them."""
    facts = star.registrations(spark, sf, "year", "make")
    late = facts.where("year >= 1999").select(F.col("year"), F.replace("make", F.lit("#"), F.lit("-")).alias("make"))
    early = facts.where("year < 1999 and not (make = 'Brand#13' and year >= 1993)")
    known = early.select(F.col("make").alias("canonical_make")).distinct()
    reference = known.where("canonical_make like '%1'").select(F.col("canonical_make").alias("ref_make"), F.lit("A").alias("ref_type")).union(late.where("make like '%2'").select("make", F.lit("B")).distinct())
    out = resolve.standardise_makes(late.select("make").distinct(), known, late.unionByName(early), reference)
    return out.select("make", "canonical_make", F.round("score", 6).alias("score"), F.col("by_type.decision").alias("by_type"), F.col("by_years.decision").alias("by_years"), "standardise", "reason")


add("standardise_makes_evidence", standardised, f"""with {REG}, late as (select year, replace(make, '#', '-') as make from reg where year >= 1999), early as (select year, make from reg where year < 1999 and not (make = 'Brand#13' and year >= 1993)),
u as (select make, min(year) as a, max(year) as b from late group by make), k as (select make as canonical_make, min(year) as x, max(year) as y from early group by make),
c as (select u.*, k.*, 1.0::double - levenshtein(upper(make), upper(canonical_make))::double / greatest(length(make), length(canonical_make))::double as s from u, k qualify row_number() over (partition by make order by s desc, canonical_make) = 1),
e as (select *, make like '%2' as own, canonical_make like '%1' as other, not (b < x or y < a) as meet from c)
select make, canonical_make, round(s, 6) as score, case when own then 'PREVENT' when other then 'SUPPORT' else 'NEUTRAL' end as by_type, case when meet then 'SUPPORT' else 'PREVENT' end as by_years,
 not (own or (not meet and a <= y)) as standardise, case when not meet and a <= y then 'years' when own then 'reference' else 'proposal' end as reason from e where s >= 0.4""")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in words, made of parts' names, and what is read from them."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("Classification: SpellingVariant. Confidence: 0.9", "This is a genuinely NEW model", "a truncation, confidence: 85", "Spelling variant here", "no idea")]), (F.col("p_size") % 5 + 1).cast("int"))
    return star.read(spark, sf, "part").select("p_partkey", resolve.parse_answer(F.concat(F.upper("p_name"), F.lit(" - "), said)).alias("a")).select("p_partkey", "a.*")


add("parse_answer", answers, "select p_partkey, ['spelling', 'new', 'truncation', 'spelling', 'uncertain'][p_size % 5 + 1] as kind, p_size % 5 in (0, 2, 3) as correct, [0.9::double, 0.7::double, 0.85::double, 0.7::double, 0.7::double][p_size % 5 + 1] as confidence from part")


def value_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly values as they are shown; a series has few points, which are named one by one."""
    facts = star.registrations(spark, sf, "year", "net_mass", "fuel_type")
    out = []
    for m in (Metric(), Metric("sum", "net_mass"), Metric("coverage", "fuel_type")):
        out += [(m.kind, r.year, naming.value_text(r.value, m)) for r in query(facts, FilterSpec(), m, YEARS).collect()]
    return spark.createDataFrame(out, "kind string, year int, label string")


add("value_labels", value_labels, f"""with {REG}, v as (select year, count(*) as n, sum(net_mass) as mass, count(fuel_type)::double / count(*) * 100 as share from reg group by year)
select 'count' as kind, year, format('{{:,}}', n) || ' vehicles' as label from v union all select 'sum', year, case when mass > 10000 then format('{{:.1f}} tonnes', mass / 1000) else format('{{:,}}', cast(floor(mass) as bigint)) || ' kg' end from v
union all select 'coverage', year, case when share < 0.1 then format('{{:.3f}}%', share) when share < 1 then format('{{:.2f}}%', share) when share < 10 then format('{{:.1f}}%', share) else format('{{:.0f}}%', share) end from v""")

# ---- aggregates kept by year, after two imports of which the second replaces two years
def kept_after_imports(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """The kept groups of facts whose years 1996 and 2000 were imported by half first, and then whole."""
    place = store.work_dir(spark)
    path, log = f"{place}/facts", f"{place}/log"
    half = facts.where(~F.col("year").isin(1996, 2000) | (F.length("model") % 2 == 0))
    for part in (half, facts.where(F.col("year").isin(1996, 2000))):
        store.write_years(part, path)
        store.log_imports(spark, log, [(f"f_{y}.csv", y, 0, 0) for y in sorted(r.year for r in part.select("year").distinct().collect())])
        kept.refresh(spark, lambda years: spark.read.parquet(path).where(F.col("year").isin(years)), spark.read.parquet(log), f"{place}/kept")
    return kept.groups(spark, f"{place}/kept")


_groups = lambda s, d: star.registrations(s, d, "year", *kept.GROUPS)
add("kept_hierarchy", lambda s, d: kept.hierarchy(kept_after_imports(s, _groups(s, d)), YEARS), ORACLES["canonical_hierarchy"])
add("kept_pairs", lambda s, d: kept.uncurated_pairs(kept_after_imports(s, _groups(s, d)), YEARS).withColumn("share", F.round("share", 8)), ORACLES["uncurated_pairs"])
add("kept_stats", lambda s, d: kept.detailed_stats(kept_after_imports(s, _groups(s, d)), star.mapping(s, d), YEARS), ORACLES["detailed_stats"])
