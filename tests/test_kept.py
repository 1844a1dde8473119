import pytest

from cohortline.functions.codes import Years
from cohortline.operators import mapping
from cohortline.plans import kept
from cohortline.sources import store

YEARS = Years((2000, 2001), (2002, 2003), 2000)
SCHEMA = "year int, make string, model string, model_year int, fuel_type string, vehicle_type string"


def facts_of(spark, years):
    return spark.createDataFrame([(y, m, "x", y - 3, None if y % 2 else "E", "PAU") for y in years for m in ("A", "B", None, "A") if (y, m) != (2001, "B")], SCHEMA)


def test_only_changed_years_are_read(spark, tmp_path, monkeypatch):
    path, log, place = (str(tmp_path / n) for n in ("facts", "log", "kept"))
    store.write_years(facts_of(spark, range(2000, 2004)), path)
    store.log_imports(spark, log, [(f"{y}.csv", y, 4, 0) for y in range(2000, 2004)])
    seen = []

    def facts(years):
        df = spark.read.parquet(path).where(f"year in ({', '.join(map(str, years))})")
        seen.append({y for y in range(2000, 2004) for f in df.inputFiles() if f"year={y}/" in f} & set(years))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan
        return df

    refresh = lambda: kept.refresh(spark, facts, spark.read.parquet(log), place)
    assert refresh() == [2000, 2001, 2002, 2003] and refresh() == []
    store.write_years(facts_of(spark, [2002, 2002, 2002]), path)
    store.log_import(spark, log, "2002.csv", 2002, 12, 0)
    assert refresh() == [2002] and seen[-1] == {2002}
    now, groups = spark.read.parquet(path), kept.groups(spark, place)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(kept.hierarchy(groups, YEARS), mapping.hierarchy(now, YEARS))
    assert same(kept.uncurated_pairs(groups, YEARS), mapping.uncurated_pairs(now, YEARS))

    monkeypatch.setattr(kept, "note", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed: done again by the next
    store.write_years(facts_of(spark, [2003, 2003]), path)
    store.log_import(spark, log, "2003.csv", 2003, 8, 0)
    with pytest.raises(KeyboardInterrupt):
        refresh()
    monkeypatch.undo()
    assert refresh() == [2003]
    assert same(kept.uncurated_pairs(kept.groups(spark, place), YEARS), mapping.uncurated_pairs(spark.read.parquet(path), YEARS))

    store.delete_year(spark, 2000, [path], log)
    assert refresh() == [] and sorted(r.year for r in kept.groups(spark, place).select("year").distinct().collect()) == [2001, 2002, 2003]
