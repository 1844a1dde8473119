import json

import pytest
from pyspark.sql import functions as F

from cohortline.plans import catalog
from cohortline.sources import imports, readers, store

HEAD = ",".join(readers.VEHICLE_COLUMNS)


def line(year, k, make="HONDA"):
    return f"{year},{year}_{k},PAU,AU,{make},CIVIC,2015,1250.5,4,1798,,ROU,E,Montréal (06),Montréal (66),66023"


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_a_small_batch_rewrites_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    facts = spark.range(4000).select((F.col("id") % 4 + 2000).cast("int").alias("year"), F.col("id").cast("string").alias("sequence"), F.lit("a").alias("make"))
    store.upsert_buckets(spark, path, facts)
    before = store.bucket_versions(spark, path)
    assert len(before) == 4 * 64
    batch = facts.where("year = 2001 and cast(sequence as int) < 400").withColumn("make", F.lit("b"))
    touched = store.upsert_buckets(spark, path, batch.union(batch))
    after = store.bucket_versions(spark, path)
    assert len(touched) <= 100 and {k for k in after if after[k] != before.get(k)} == set(touched) and {y for y, _ in touched} == {2001}
    assert sorted(map(tuple, store.read_buckets(spark, path).groupBy("make").count().collect())) == [("a", 3900), ("b", 100)]
    assert store.read_buckets(spark, path, years=(2002,)).count() == 1000
    assert store.vacuum_buckets(spark, path) == len(touched) and store.read_buckets(spark, path).count() == 4000
    assert store.upsert_buckets(spark, path, batch.limit(0)) == []


def test_an_upsert_keeps_no_second_copy_of_its_rows(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "year int, sequence string, make string, k int"
    monkeypatch.setattr(store, "written", None)  # a checkpoint of all rows
    rows = [(2000, str(i), "a", 1) for i in range(50)]
    assert len(store.upsert_buckets(spark, path, spark.createDataFrame(rows + [(2000, "7", "b", 2)], schema), buckets=4, ordinal="k")) == 4
    store.upsert_buckets(spark, path, spark.createDataFrame([(2000, "8", "c", 1), (2000, "8", "d", 0), (2001, "x", "e", 0)], schema), buckets=4, ordinal="k")
    got = {(r.year, r.sequence): r.make for r in store.read_buckets(spark, path).collect()}
    assert len(got) == store.read_buckets(spark, path).count() == 51
    assert {k: v for k, v in got.items() if v != "a"} == {(2000, "7"): "b", (2000, "8"): "c", (2001, "x"): "e"}
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == ["data", "manifests"]


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.upsert_buckets(spark, path, spark.createDataFrame([(2000, "1", "a", 1), (2000, "1", "z", 2)], "year int, sequence string, make string, k int"), ordinal="k")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        store.upsert_buckets(spark, path, spark.createDataFrame([(2000, "1", "b")], "year int, sequence string, make string"))
    assert [tuple(r) for r in store.read_buckets(spark, path).collect()] == [(2000, "1", "z")]


def test_one_changed_value_is_refused(spark, tmp_path):
    facts = spark.createDataFrame([(2000, "1", "a", 1.5), (2001, "2", "b", None)], "year int, sequence string, make string, net_mass double")
    store.export_package(spark, {"registrations": facts}, str(tmp_path / "p"))
    assert store.validate_package(spark, str(tmp_path / "p")) == []
    facts.withColumn("net_mass", F.lit(1.5)).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "p/registrations"))
    assert store.validate_package(spark, str(tmp_path / "p")) == ["registrations has other values in 2001"]
    with pytest.raises(ValueError, match="other values in 2001"):
        store.import_package(spark, str(tmp_path / "p"), str(tmp_path / "s"))


def test_structure_is_asked_for(spark, tmp_path):
    facts = spark.createDataFrame([(2000, "1")], "year int, sequence string")
    store.export_package(spark, {"registrations": facts}, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="licences is missing"):
        store.import_package(spark, str(tmp_path / "p"), str(tmp_path / "s"), whole=True)
    assert store.import_package(spark, str(tmp_path / "p"), str(tmp_path / "s")) == "replace"


def test_a_replacement_that_fails_leaves_the_store(spark, tmp_path, monkeypatch):
    facts = spark.createDataFrame([(2000, "1")], "year int, sequence string")
    store.export_package(spark, {"registrations": facts, "places": facts.select("sequence")}, str(tmp_path / "p"))
    store.write_years(facts.withColumn("sequence", F.lit("here")), str(tmp_path / "s/registrations"))

    def broken(*_):
        raise OSError("no space left")

    monkeypatch.setattr(store, "swap", broken)
    with pytest.raises(OSError, match="space"):
        store.import_package(spark, str(tmp_path / "p"), str(tmp_path / "s"), "replace")
    assert [r.sequence for r in spark.read.parquet(str(tmp_path / "s/registrations")).collect()] == ["here"]
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["registrations"]


def test_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(2000, "1", None), (2000, "2", "x"), (None, "3", "y")], "year int, a string, b string")
    assert store.digests(df) == store.digests(df.select("b", "year", "a").repartition(3)) and json.dumps(store.digests(df))
    assert store.digests(df.union(df))["2000"] != store.digests(df)["2000"]


def test_files_of_all_dialects_in_one_job(spark, tmp_path):
    first = put(tmp_path / "a 2020.csv", "\n".join([HEAD, line(2020, 1), line(2020, 1), "short", line(2020, 2)]))
    second = put(tmp_path / "b_2021.csv", "\n".join([HEAD, line(2021, 1), line(2021, 2, "Š€")]).replace(",", ";"), "cp1252")
    old = put(tmp_path / "a_2021.csv", "\n".join([HEAD, line(2021, 9)]))
    bad = put(tmp_path / "c_2022.csv", "x,y\n1,é")
    table, rejects, log = (str(tmp_path / n) for n in ("t", "r", "l"))
    done = imports.import_all(spark, [first, second, old, bad, str(tmp_path / "none_2019.csv"), "noyear.csv"], table, rejects, log)
    assert [(r.year, r.stored, r.dropped) for r in done.results] == [(2020, 2, 1), (2021, 2, 0)]
    assert {p.rsplit("/", 1)[-1] for p, _ in done.failed} == {"a_2021.csv", "c_2022.csv", "none_2019.csv", "noyear.csv"}
    assert [(r.year, r.reason, r.line) for r in spark.read.parquet(rejects).collect()] == [(2020, "1 fields in place of 16", "short")]
    assert sorted((r.year, r.status) for r in spark.read.parquet(log).collect()) == [(2020, "partial"), (2021, "success")]
    one = {tuple(r) for r in spark.read.parquet(table).where("year = 2020").select("sequence", "make", "net_mass").collect()}
    imports.import_files(spark, [first], str(tmp_path / "u"))
    assert one == {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).select("sequence", "make", "net_mass").collect()}
    assert imports.import_all(spark, [bad], table).results == []


def test_queries_leave_no_work_folders(spark, sf_dir, monkeypatch):
    made = []
    work_dir = store.work_dir
    monkeypatch.setattr(store, "work_dir", lambda s: (made.append(work_dir(s)), made[-1])[1])
    assert catalog.QUERIES["series_files"](spark, sf_dir).count() and made
    assert not any(store.exists(spark, p) for p in made)
