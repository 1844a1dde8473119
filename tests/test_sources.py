import json

import pytest
from pyspark.sql import functions as F

from cohortline.functions.codes import LICENCES, REGISTRATIONS
from cohortline.functions.codes import Years
from cohortline.plans import cache
from cohortline.sources import imports, readers, sinks, store
from cohortline.streaming import incremental

HEAD = ",".join(readers.VEHICLE_COLUMNS)
ROWS = [
    '2020,2020_1,PAU,AU,HONDA,CIVIC,2015,1250.5,4,1798,,ROU,E,"Montréal (06)","Montréal (66 )",66023',
    "2020,,PAU,,HONDA,CIVIC,x,,,,3,,,MontrÃ©al (06),,",
    "2020,short",
    "",
]


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_vehicle_file(spark, tmp_path, encoding):
    rows = [r for r in ROWS if encoding == "utf-8" or "Ã" not in r]
    path = put(tmp_path / "v_2020.csv", "\n".join([HEAD, *rows]), encoding)
    got = readers.vehicles(spark, path, 2020)
    assert dict(got.dtypes) == {k: v for k, v in (x.split() for x in REGISTRATIONS.split(", "))}
    first = got.where("sequence = '2020_1'").first()
    assert (first.model_year, first.net_mass, first.net_mass_int, first.admin_region, first.mrc, first.municipality) == (2015, 1250.5, 1251, "06", "66", "66023")
    if encoding == "utf-8":
        other = got.where("sequence = '2020_UNKNOWN'").first()
        assert (other.model_year, other.vehicle_type, other.max_axles, other.admin_region) == (None, None, 3, "06")
    assert got.count() == len([r for r in rows if r.count(",") == 15])
    assert readers.dropped_lines(spark, path, readers.VEHICLE_COLUMNS, True) == 1


def test_refused_files(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.vehicles(spark, put(tmp_path / "a.csv", HEAD), 2020)
    with pytest.raises(readers.SourceError):
        readers.vehicles(spark, put(tmp_path / "b.csv", "a,b,c\n1,2,é"), 2020)
    with pytest.raises(readers.SourceError):
        readers.vehicles(spark, put(tmp_path / "c.csv", f"{HEAD}\n" + ROWS[0].replace("é", "e")), 2020)
    with pytest.raises(readers.SourceError):
        readers.vehicles(spark, put(tmp_path / "d.csv", f"{HEAD}\n{ROWS[0]}"), 2015)  # fuel before it existed


def test_licence_file(spark, tmp_path):
    row = '2021,7,16-19,F,Laval (65),Laval (13),RÉGULIER,OUI,NON,,OUI,NON,NON,NON,NON,OUI,Absente,"2 à 5 ans",,10 ans ou plus'
    got = readers.licences(spark, put(tmp_path / "l.csv", ";".join(readers.LICENCE_COLUMNS) + "\n" + row.replace('"', "").replace(",", ";"), "iso-8859-1"), 2021)
    assert dict(got.dtypes) == {k: v for k, v in (x.split() for x in LICENCES.split(", "))}
    r = got.first()
    assert (r.admin_region, r.licence_type, r.learner_123, r.driver_1234, r.probationary, r.exp_5, r.exp_6abce) == ("13", "RÉGULIER", True, True, True, "2 à 5 ans", None)


def test_fields_keep_their_digits(spark):
    lines = spark.createDataFrame([("1020,2020_10, x ,3",), ('1,"a,b",2,3',)], "value string")
    got = [list(r[0]) for r in lines.select(readers.fields(F.col("value"), ",")).collect()]
    assert got == [["1020", "2020_10", "x", "3"], ["1", "a,b", "2", "3"]]


def test_long_lines_of_quoted_fields_and_control_characters(spark, tmp_path):
    lines = spark.createDataFrame([(",".join(['"a,b"', ' "c" '] * 20000),), ('"a,\u0001b",2, 3',)], "value string")
    got = [list(r[0]) for r in lines.select(readers.fields(F.col("value"), ",")).collect()]
    assert got == [["a,b", "c"] * 20000, ["a,\u0001b", "2", "3"]]
    path = put(tmp_path / "c.txt", "a\u0001b,1\n")
    assert [r.value for r in readers.read_lines(spark, path, "utf-8").collect()] == ["a\u0001b,1"]  # the line is whole


def test_windows_encoding_and_delimiter(spark, tmp_path):
    assert readers.decode("é".encode(), True) == "utf-8"
    assert readers.decode("é".encode("iso-8859-1"), True) == "iso-8859-1"
    assert readers.decode("aé".encode()[:-1] , False) == "utf-8"
    path = put(tmp_path / "w.txt", "œuf\nx", "cp1252")
    assert [r.value for r in readers.read_lines(spark, path, "cp1252").collect()] == ["œuf", "x"]
    assert readers.delimiter('a;"b,c,d";e') == ";" and readers.delimiter("a,b") == ","


def test_places(spark, tmp_path):
    line = list(" " * 900)
    for name, value in {"kind": "1", "code": "66023", "name": "Montréal", "mrc": "660", "region": "06", "population": "01762949", "lat": "4530", "lon": "7336", "land": "0000364740", "total": "0000431500"}.items():
        a, b = readers.PLACES[name]
        line[a:b] = list(value.ljust(b - a))
    path = put(tmp_path / "d001", "".join(line) + "\nshort\n0" + "".join(line)[1:], "iso-8859-1")
    r = readers.places(spark, path).collect()
    assert len(r) == 1
    assert (r[0].code, r[0].name, r[0].population, r[0].latitude, r[0].longitude, r[0].area_total) == ("66023", "Montréal", 1762949, 45.5, pytest.approx(-73.6), 431.5)


def test_later_layout(spark, tmp_path):
    rows = spark.createDataFrame([("202301", "HONDA", "CIVIC", "2020", "Outaouais (7)", "Gatineau"), ("2023", "KIA", "RIO", "2021", "x", "nowhere")], "period string, make string, model string, model_year string, region string, municipality string")
    names = spark.createDataFrame([("GATINEAU", "81017")], "name string, code string")
    got = {r.MARQ_VEH: r for r in readers.normalise(rows, names, F.col("make"), str(tmp_path / "sorted")).collect()}
    assert (got["HONDA"].AN, got["HONDA"].NOSEQ_VEH, got["HONDA"].REG_ADM, got["HONDA"].CG_FIXE) == (2023, "2023_0000000001", "Outaouais (07)", "81017")
    assert got["KIA"].CG_FIXE is None and list(got["KIA"].asDict()) == list(readers.VEHICLE_COLUMNS)


def test_corrections_and_reports(spark, tmp_path):
    path = put(tmp_path / "r.md", "# title\n| A | B | → | C | D | 95% |\n| E | F | → | G | H | 60% |\n")
    got = readers.corrections(spark, path, 70)
    assert [tuple(r) for r in got.collect()] == [("A", "B", "C", "D", 95)]
    assert sinks.correction_script(got, "t") == "UPDATE t SET make = 'C', model = 'D' WHERE UPPER(make) = 'A' AND UPPER(model) = 'B';"
    assert sinks.markdown(got.select("from_make")) == "| from_make |\n| --- |\n| A |"
    assert json.loads(sinks.codes_json(got, "from_make", "to_make")) == {"A": "C"}
    points = spark.createDataFrame([(2021, 2.0), (2020, 1.0)], "year int, value double")
    sinks.series_csv(points, str(tmp_path / "s"), "all")
    sinks.all_series_csv({"a": points, "b": points}, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("all", "2020", "1.0"), ("all", "2021", "2.0")]
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 4


def test_store(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "year int, sequence string, make string"
    store.write_years(spark.createDataFrame([(2020, "1", "A"), (2021, "1", "B")], schema), path)
    store.write_years(spark.createDataFrame([(2021, "2", "C")], schema), path)
    assert {(r.year, r.make) for r in spark.read.parquet(path).collect()} == {(2020, "A"), (2021, "C")}
    store.delete_years(spark, path, (2020,))
    assert {r.year for r in store.years_in(spark, path).collect()} == {2021}
    old = spark.createDataFrame([(2020, "1", "A"), (2020, "2", "B")], schema)
    new = spark.createDataFrame([(2020, "2", "X", 1), (2020, "2", "Y", 2), (2020, "3", "Z", 1)], schema + ", n int")
    assert {(r.sequence, r.make) for r in store.upsert(old, new, ordinal="n").collect()} == {("1", "A"), ("2", "Y"), ("3", "Z")}
    store.log_import(spark, str(tmp_path / "log"), "f.csv", 2020, 3, 1)
    assert spark.read.parquet(str(tmp_path / "log")).first().status == "partial"


def test_years_are_written_by_as_many_tasks_as_their_files_ask_for(spark, tmp_path):
    spark.range(20000).select((F.col("id") % 2 + 2000).cast("int").alias("year"), F.lit("a").alias("make")).withColumn("k", F.rand(1)).write.parquet(str(tmp_path / "in"))
    facts = spark.read.parquet(str(tmp_path / "in"))
    store.write_years(facts.select("year", "k"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "year=2000").glob("part-*"))) > 1  # however small a row is in a shuffle
    size = sum(x.stat().st_size for x in (tmp_path / "in").glob("part-*.parquet"))
    assert store.tasks_for(facts, 1000) == -(-size // 1000) > 4 and store.tasks_for(spark.range(5)) == 0


def test_packages(spark, tmp_path):
    path = str(tmp_path / "p")
    facts = spark.createDataFrame([(2020, "1"), (2022, "2")], "year int, sequence string")
    said = store.export_package(spark, {"registrations": facts}, path)
    assert (said["registrations"]["rows"], said["registrations"]["from_year"]) == (2, 2020)
    assert store.validate_package(spark, path, ("registrations", "licences")) == ["licences is missing"]
    facts.limit(1).write.mode("overwrite").parquet(f"{path}/registrations")
    assert store.validate_package(spark, path) == ["registrations has other rows"]
    assert [store.default_mode(a, b) for a, b in ((set(), {"v"}), ({"v"}, {"l"}), ({"v"}, {"v"}))] == ["replace", "merge", "refuse"]
    assert store.merge(facts, facts, ["year", "sequence"]).count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a_2020.csv", "sequence,make\n1,A\n2,B\n")
    rows = incremental.arrivals(spark, str(tmp_path / "in"), "sequence string, make string")
    incremental.store_arrivals(rows, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    incremental.upsert_arrivals(rows, str(tmp_path / "up"), str(tmp_path / "c2"), ["year", "sequence"]).awaitTermination(60)
    put(tmp_path / "in" / "b_2020.csv", "sequence,make\n2,C\n3,D\n")
    incremental.upsert_arrivals(rows, str(tmp_path / "up"), str(tmp_path / "c2"), ["year", "sequence"]).awaitTermination(60)
    assert {(r.year, r.sequence, r.make) for r in spark.read.parquet(str(tmp_path / "up")).collect()} == {(2020, "1", "A"), (2020, "2", "C"), (2020, "3", "D")}
    timed = rows.withColumn("t", F.current_timestamp())
    assert incremental.running_counts(timed, "t", "1 hour", "10 minutes", "make").isStreaming


def test_import_of_several_years(spark, tmp_path):
    old = ",".join(readers.vehicle_columns(2016))
    a = put(tmp_path / "v_2020.csv", "\n".join([HEAD, *ROWS, ROWS[0]]))
    b = put(tmp_path / "v_2016.csv", old + '\n2016,2016_1,PAU,AU,KIA,RIO,2015,1000,4,1400,,BLE,"Québec (03)",,1')
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    done = imports.import_files(spark, [a, b], table, log)
    assert [(r.year, r.stored, r.dropped) for r in done] == [(2016, 1, 0), (2020, 2, 1)]
    imports.import_files(spark, [a], table, log)
    assert {(r.year, r["count"]) for r in spark.read.parquet(table).groupBy("year").count().collect()} == {(2016, 1), (2020, 2)}
    assert sorted(r.status for r in spark.read.parquet(log).collect()) == ["partial", "partial", "success"]
    with pytest.raises(readers.SourceError):
        imports.year_of("/2020/none.csv")


def test_later_files_to_the_yearly_layout(spark, tmp_path):
    raw = spark.createDataFrame([("202301", "KIA", "Laval (13)")], "`Année civile / mois` string, Marque string, `Région admin (code)` string")
    rows = readers.normalise(imports.later_layout(raw), spark.createDataFrame([], "name string, code string"), F.col("make"), str(tmp_path / "sorted"))
    imports.write_yearly(rows, str(tmp_path / "o"))
    text = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert text[0].startswith('"AN","NOSEQ_VEH"') or text[0].startswith("AN,NOSEQ_VEH")
    assert '"2023","2023_0000000001"' in text[1] and "Laval (13)" in text[1]


def test_families_and_kept_results(spark, tmp_path):
    path = str(tmp_path / "p")
    facts = spark.createDataFrame([(2020, "1")], "year int, sequence string")
    store.export_package(spark, {"registrations": facts, "licences": facts.limit(0)}, path)
    assert imports.families(spark, path) == {"registrations"}
    made = []

    def make():
        made.append(1)
        return facts

    key = cache.key_of(Years(), "hierarchy")
    assert key != cache.key_of(Years((2011,), (2023,)), "hierarchy")
    for _ in range(2):
        assert cache.kept(spark, str(tmp_path / "c"), key, make).count() == 1
    cache.forget(spark, str(tmp_path / "c"), key)
    cache.kept(spark, str(tmp_path / "c"), key, make)
    assert len(made) == 2


def test_package_is_taken_in_or_refused(spark, tmp_path):
    facts = spark.createDataFrame([(2020, "1"), (2022, "2")], "year int, sequence string")
    package, here = str(tmp_path / "p"), str(tmp_path / "s")
    store.export_package(spark, {"registrations": facts}, package)
    assert store.import_package(spark, package, here) == "replace"  # nothing is here
    assert store.families_in(spark, here) == {"registrations"} and spark.read.parquet(f"{here}/registrations").count() == 2
    with pytest.raises(ValueError):
        store.import_package(spark, package, here)
    with pytest.raises(ValueError):
        store.import_package(spark, package, here, "merge")
    assert store.import_package(spark, package, here, "replace") == "replace"
    facts.limit(1).write.mode("overwrite").parquet(f"{package}/registrations")  # not what the manifest says
    with pytest.raises(ValueError):
        store.import_package(spark, package, here, "replace")
    assert "licences is missing" in store.lacking(spark, here) and "registrations has no make" in store.lacking(spark, here)


def test_years_and_tables_are_deleted(spark, tmp_path):
    facts = spark.createDataFrame([(2020, "1"), (2022, "2")], "year int, sequence string")
    paths, log = [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "log")
    for path in paths:
        store.write_years(facts, path)
    for year, bad in ((2020, 0), (2022, 3)):
        store.log_import(spark, log, "f", year, 1, bad, "licences")
    store.delete_year(spark, 2020, paths, log)
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1]
    assert [(r.year, r.status) for r in spark.read.parquet(log).collect()] == [(2022, "completed_with_errors")]
    store.delete_all(spark, [*paths, log])
    assert not any(store.exists(spark, p) for p in [*paths, log])


def test_numbers_are_those_of_one_sort(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 3).cast("int").alias("g"), F.hash("id").alias("v")).union(spark.createDataFrame([(None, 1), (None, 2)], "g int, v int")).repartition(7)
    got = readers.numbered(rows, "g", F.col("v"), str(tmp_path / "n")).collect()
    for g in (0, 1, 2, None):
        own = sorted((r.v, r._n) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and own
    assert len(got) == 5002


def test_an_order_of_several_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", None), (1, "a", "x"), (1, "a", None), (2, None, "y")], "g int, v string, w string")
    got = readers.numbered(rows, "g", [F.col("v"), F.col("w")], str(tmp_path / "n")).collect()
    assert {(r.g, r.v, r.w): r._n for r in got} == {(1, "a", None): 1, (1, "a", "x"): 2, (1, "b", None): 3, (2, None, "y"): 1}
    assert spark.read.parquet(str(tmp_path / "n")).columns == ["g", "v", "w", "_part", "_at"]
