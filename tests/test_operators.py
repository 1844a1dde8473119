import pytest
from pyspark.sql import functions as F

from cohortline.functions.codes import MAPPING, Years
from cohortline.operators import dims, mapping, naming, resolve
from cohortline.operators.filters import FilterSpec, apply
from cohortline.operators.metrics import Metric, percentage, percentage_one_scan, query

CONFIG = Years((2021, 2022), (2023,), 2017)
FACTS = "year int, make string, model string, model_year int, fuel_type string, vehicle_type string, net_mass double, max_axles int"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (2021, "HONDA", "CIVIC", 2015, "E", "AU", 1200.0, None), (2021, "HONDA", "CIVIC", 2016, "E", "AU", 1300.0, 2), (2022, "HONDA", "CIVIC", 2015, "L", "AU", None, None),
        (2022, "VOLVO", "X60", None, None, "AU", 1800.0, 7), (2023, "HOND", "CIVIC", 2015, None, None, 1250.0, None), (2023, "HOND", "CIVIC", 2022, None, None, 1250.0, None), (2023, "HONDA", "CIVIC", 2015, None, None, 1200.0, None), (2023, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, FACTS)


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("HOND", "CIVIC", None, "HONDA", "CIVIC", None, "AU", 2, 2023, 2023), ("HOND", "CIVIC", 2015, "HONDA", "CIVIC", "E", None, 1, 2023, 2023)]
    return spark.createDataFrame(rows, MAPPING)


def by_year(df):
    return {r.year: r.value for r in df.collect()}


def test_empty_filters_take_nothing_or_all(spark, facts):
    assert apply(facts, FilterSpec(makes=()), CONFIG).count() == 0
    assert apply(facts, FilterSpec(makes=(), lenient=True), CONFIG).count() == 8
    assert apply(facts, FilterSpec(years=(2023,), curated_only=True), CONFIG).count() == 0
    assert apply(facts, FilterSpec(curated_only=True), CONFIG).count() == 4


def test_pairs_and_ages(spark, facts):
    assert apply(facts, FilterSpec(models=(("HOND", "CIVIC"),)), CONFIG).count() == 2
    assert by_year(query(facts, FilterSpec(age_ranges=((6, 10),)), Metric(), CONFIG)) == {2021: 1.0, 2022: 1.0, 2023: 2.0}
    assert by_year(query(facts, FilterSpec(age_ranges=((8, None),)), Metric(), CONFIG)) == {2023: 2.0}


def test_regularized_filters(spark, facts, rules):
    assert by_year(query(facts, FilterSpec(types=("AU",), regularize=True), Metric(), CONFIG, rules)) == {2021: 2.0, 2022: 2.0, 2023: 2.0}
    assert by_year(query(facts, FilterSpec(fuels=("E",), regularize=True), Metric(), CONFIG, rules)) == {2021: 2.0, 2023: 1.0}
    with pytest.raises(ValueError):
        apply(facts, FilterSpec(types=("AU",), regularize=True), CONFIG)


def test_metrics(spark, facts):
    assert by_year(query(facts, FilterSpec(), Metric("median", "net_mass"), CONFIG)) == {2021: 1250.0, 2022: 1800.0, 2023: 1250.0}
    assert by_year(query(facts, FilterSpec(), Metric("coverage", "fuel_type"), CONFIG)) == {2021: 100.0, 2022: 50.0, 2023: 0.0}
    assert by_year(query(facts, FilterSpec(), Metric("missing", "fuel_type"), CONFIG)) == {2021: 0.0, 2022: 1.0, 2023: 4.0}
    assert by_year(query(facts, FilterSpec(), Metric("average", "age"), CONFIG)) == {2021: 5.5, 2022: 7.0, 2023: pytest.approx(17 / 3)}
    assert by_year(query(facts, FilterSpec(), Metric("sum"), CONFIG))[2023] == 4.0


def test_percentage_both_ways(spark, facts):
    spec = FilterSpec(fuels=("E",), makes=("HONDA", "VOLVO"))
    base = query(facts, spec.without("fuels"), Metric(), CONFIG)
    two = by_year(percentage(query(facts, spec, Metric(), CONFIG), base))
    assert two == by_year(percentage_one_scan(facts, spec, ("fuels",), CONFIG)) == {2021: 100.0}
    assert by_year(percentage(base, base.where("year = 0"))) == {2021: 0.0, 2022: 0.0, 2023: 0.0}


def test_plan_prunes_and_does_not_multiply(spark, facts, rules):
    doubled = rules.union(rules)
    assert apply(facts, FilterSpec(types=("AU",), regularize=True), CONFIG, doubled).count() == 6


def test_pairs_and_status(spark, facts, rules):
    pairs = {(r.make, r.model): (r.n, r.is_exact_match) for r in mapping.uncurated_pairs(facts, CONFIG).collect()}
    assert pairs == {("HOND", "CIVIC"): (2, False), ("HONDA", "CIVIC"): (1, True)}
    status = {r.make: r.status for r in mapping.status(facts, rules, CONFIG).collect()}
    assert status == {"HOND": "partial", "HONDA": "unassigned"}
    full = rules.union(spark.createDataFrame([("HOND", "CIVIC", 2022, "HONDA", "CIVIC", "L", None, 1, 2023, 2023)], MAPPING))
    assert {r.make: r.status for r in mapping.status(facts, full, CONFIG).collect()}["HOND"] == "complete"


def test_expansion_is_two_hops(spark):
    rows = [(a, "M", None, b, "M", None, None, 1, 1, 1) for a, b in (("A", "B"), ("C", "B"), ("B", "D"), ("E", "D"))]
    m = spark.createDataFrame(rows, MAPPING)
    got = {r.make for r in mapping.expand_makes(m, spark.createDataFrame([("A",)], "make string")).collect()}
    assert got == {"A", "B", "C"}
    pairs = {r.make for r in mapping.expand_pairs(m, spark.createDataFrame([("A", "M")], "make string, model string")).collect()}
    assert pairs == {"A", "B", "C"}


def test_save_replaces_and_refuses(spark, rules):
    new = spark.createDataFrame([("HOND", "CIVIC", None, "HONDA", "CIVIC", None, "MC", 2, 2023, 2023)], MAPPING)
    got = {(r.model_year, r.vehicle_type) for r in mapping.save(rules, new).collect()}
    assert got == {(None, "MC"), (2015, None)}
    with pytest.raises(ValueError):
        mapping.save(rules, new.withColumn("canonical_make", F.lit("VOLVO")))
    assert mapping.delete(rules, "HOND", "CIVIC", 2015).count() == 1
    assert mapping.delete(rules, "HOND", "CIVIC", whole_pair=True).count() == 0


def test_automatic_rules(spark, facts):
    none = spark.createDataFrame([], MAPPING)
    assert [tuple(r) for r in mapping.auto_wildcards(facts, none, CONFIG, ("AU", "MC")).collect()] == [("HONDA", "CIVIC", "AU")]
    assert mapping.auto_triplets(facts, none, CONFIG).count() == 0  # two fuels for 2015


def test_nested_hierarchy_keeps_nulls(spark, facts):
    got = {(r.make, r.model): (r.model_years, r.types) for r in mapping.nested_hierarchy(facts, CONFIG).collect()}
    years, types = got["HONDA", "CIVIC"]
    assert [(y.model_year, [(f.fuel_type, f.n) for f in y.fuels]) for y in years] == [(2015, [("E", 1), ("L", 1)]), (2016, [("E", 1)])]
    assert got["VOLVO", "X60"][0][0].model_year is None and [(t.vehicle_type, t.n) for t in types] == [("AU", 3)]


def test_dimensions(spark, facts, rules):
    badges = {r.make: r.display_name for r in dims.make_badges(facts, rules, CONFIG).collect()}
    assert badges == {"HONDA": "HONDA", "VOLVO": "VOLVO", "HOND": "HOND → HONDA (3 records)"}
    ids = dims.surrogate_ids(spark.createDataFrame([(7, "VOLVO")], "id int, make string"), facts, "make")
    assert {r.make: r.id for r in ids.collect()} == {"VOLVO": 7, "HOND": 8, "HONDA": 9}
    assert [r.id for r in dims.resolve(ids, "make", "VOLVO").collect()] == [7] and dims.resolve(ids, "make", "olv").count() == 0
    assert [r.id for r in dims.resolve(ids, "make", "ond", fuzzy=True).collect()] == [8]
    fuels = dims.fuels(spark.createDataFrame([("U", "A"), ("E", "Z"), ("NS", "B")], "code string, description string"))
    assert [r.code for r in fuels.orderBy("place").collect()] == ["E", "U"]


def test_resolution(spark):
    unknown = spark.createDataFrame([("VOLV0", "XC-60"), ("MAZD", "CX3"), ("ACME", "ZZ")], "make string, model string")
    known = spark.createDataFrame([("VOLVO", "XC60"), ("MAZDA", "CX-3"), ("MAZDA", "CX-5")], "canonical_make string, canonical_model string")
    got = {r.make: (r.canonical_model, r.score) for r in resolve.best_blocked(unknown, known).collect()}
    assert got == {"VOLV0": ("XC60", 0.99), "MAZD": ("CX-3", 0.99)}
    assert {r.make for r in resolve.best_joined(unknown, known).collect()} >= {"VOLV0", "MAZD"}
    reference = spark.createDataFrame([("MAZDA", "CX-3", "PAU")], "ref_make string, ref_model string, ref_type string")
    typed = resolve.reference_type(spark.createDataFrame([("MAZDA", "CX3"), ("X", "Y")], "make string, model string"), reference, "make", "model", "t")
    assert {r.make: r.t for r in typed.collect()} == {"MAZDA": "PAU", "X": None}


def test_names():
    spec = FilterSpec(fuels=("L", "E"), regions=("Laval",))
    assert naming.series_name(spec) == "Count in [Region: Laval] AND [Fuel: Electric OR Gasoline]"
    assert naming.series_name(FilterSpec()) == "All"
    assert naming.percentage_name(spec, ("fuels",)) == "% [Fuel: Electric OR Gasoline] in Count in [Region: Laval]"
    assert [naming.show(x) for x in (3.14159, 1234567, 0.0, 2.5e12, 1500.0)] == ["3.14", "1.23M", "0", "2.50e+12", "1,500"]
    assert FilterSpec(axles=(2,), genders=("F",)).for_licences().axles is None


def test_values_and_axes_by_metric():
    text = naming.value_text
    assert [text(v, Metric()) for v in (1234.0, 2.0)] == ["1,234 vehicles", "2 vehicles"] and text(5.0, Metric(), "licences") == "5 license holders"
    assert [text(v, Metric("sum", "net_mass")) for v in (9999.0, 10_001.0)] == ["9,999 kg", "10.0 tonnes"] and text(12_345.0, Metric("sum", "cylinder_count")) == "12,345"
    assert [text(v, Metric("average", "age")) for v in (0.0432, 0.434, 3.46, 45.4)] == ["0.043", "0.43", "3.5", "45"] and text(1500.7, Metric("median", "net_mass")) == "1,500"
    assert (text(0.5, Metric("coverage", "fuel_type")), text(1500.0, Metric("missing", "fuel_type")), text(12.3, Metric("percentage"))) == ("0.50%", "1,500 NULL values", "12%")
    assert [text(v, Metric("wear_sum")) for v in (999.0, 1500.0, 2.5e6, 1.6e18)] == ["999 RWI", "1.50 K RWI", "2.50 M RWI", "1.60e+18 RWI"]
    assert text(1.05, Metric("wear_average"), normalised=True) == "1.05" and text(12.0, Metric("wear_average"), normalised=True) == "12.00 RWI"
    assert [naming.axis_label(m) for m in (Metric(), Metric("sum", "net_mass"), Metric("average", "model_year"), Metric("wear_median"))] == ["Number of Vehicles", "Total Vehicle Mass (kg)", "Average Model Year", "Median Road Wear Index (Raw)"]


def test_baselines_and_patterns():
    spec = FilterSpec(years=(2015, 2013, 2014, 2012), mrcs=("66",), regions=("b", "a", "c"), fuels=("L", "E"), makes=("KIA", "BMW", "AUDI"), age_ranges=((0, 5),))
    base = spec.without("makes")
    assert naming.baseline_name(base) == "[Electric OR Gasoline] AND [Region: a OR b OR c]"
    assert naming.baseline_name(FilterSpec(), "licences") == "All License Holders"
    assert naming.dropped_category(spec, base) == "makes" and naming.dropped_text(spec, "makes") == "AUDI & BMW & Others"
    assert naming.dropped_text(spec, "regions") == "Regions a & b & c" and naming.dropped_text(spec, None) is None
    assert naming.dropped_category(spec, spec) is None
    assert naming.pattern(spec) == "Vehicle • Years: 2012–2015 (4 years) • Regions: a, b... (3 total) • Fuel: E, L • Age ranges: 1"
    assert naming.pattern(FilterSpec(years=(2020,), age_groups=("75+",)), "licences") == "License • Years: 2020 • Age groups: 75+"


def test_saving_refuses_rows_that_clash_among_themselves(spark):
    schema = "uncurated_make string, uncurated_model string, model_year int, canonical_make string, canonical_model string, fuel_type string, vehicle_type string, record_count bigint, year_start int, year_end int"
    row = lambda make, to, year=None, kind=None: (make, "m", year, to, "m", None, kind, 1, 2000, 2001)
    here = spark.createDataFrame([row("A", "B")], schema)
    with pytest.raises(ValueError):
        mapping.save(here, spark.createDataFrame([row("C", "D"), row("C", "E", 1999)], schema))
    with pytest.raises(ValueError):
        mapping.save(here, spark.createDataFrame([row("A", "Z", 1999)], schema))
    saved = mapping.save(here, spark.createDataFrame([row("A", "B", None, "x"), row("A", "B", None, "y"), row("C", "D")], schema))
    assert sorted((r.uncurated_make, r.vehicle_type) for r in saved.collect()) == [("A", "y"), ("C", None)]


def test_long_model_lists_are_joined(spark):
    facts = spark.createDataFrame([(2000, "a", f"m{k}") for k in range(300)], "year int, make string, model string")
    wanted = tuple(("a", f"m{k}") for k in range(250))
    assert apply(facts, FilterSpec(models=wanted), Years()).count() == 250
    assert apply(facts, FilterSpec(models=wanted[:3]), Years()).count() == 3 and apply(facts, FilterSpec(models=()), Years()).count() == 0
