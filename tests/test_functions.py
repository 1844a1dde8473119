import pytest
from pyspark.sql import functions as F

from cohortline.functions import similarity as sim
from cohortline.functions import text as tx
from cohortline.operators.wear import BY_AXLES, Wear, coefficient, coefficient_of, valid


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "v string").select(use(F.col("v"))).first()[0]


@pytest.mark.parametrize("bad,good", [("MontrÃ©al", "Montréal"), ("QuÃ©bec", "Québec"), ("LÃ©vis", "Lévis"), ("Saint-JÃ©rÃ´me", "Saint-Jérôme"), ("RiviÃ¨re", "Rivière"), ("Ã®les", "Îles"), ("plain", "plain"), (None, None)])
def test_mojibake(spark, bad, good):
    assert one(spark, bad, tx.repair_mojibake) == good


@pytest.mark.parametrize("text,name,code", [("Montréal (06)", "Montréal", "06"), ("Montréal (66 )", "Montréal", "66"), ("A (B) (C)", "A", "B"), ("none", None, None), ("(06)", None, None), ("x )y(", None, None)])
def test_name_and_code(spark, text, name, code):
    assert (one(spark, text, tx.name_of), one(spark, text, tx.code_of)) == (name, code)


def test_last_brackets_and_trailing_code(spark):
    assert one(spark, "A (B) (C)", tx.last_name_of) == "A (B)"
    assert one(spark, "A (B) (C)", tx.last_code_of) == "C"
    assert one(spark, "Montréal (06 ) ", tx.trailing_code) == "06"
    assert one(spark, "Montréal", tx.trailing_code) is None
    assert one(spark, "X(06)", tx.space_region) == "X (06)"


def test_casts_and_flags(spark):
    assert [one(spark, x, tx.to_int) for x in (" 5", "2015.0", "x", "")] == [5, None, None, None]
    assert one(spark, "2.5", lambda c: tx.rounded(tx.to_double(c))) == 3
    assert [one(spark, x, tx.yes) for x in ("OUI", "oui", None)] == [True, False, False]
    assert one(spark, "/d/12345_2017_x.csv", tx.year_in_name) == 2017
    assert one(spark, "Sainte-Anne-de-l'Île", tx.normal_name) == "sainte anne de l ile"


@pytest.mark.parametrize("a,b,want", [("VOLV0", "VOLVO", 0.92), ("CX3", "CX-3", 0.933333), ("CIVIC", "CRV", 0.72), ("RAV", "RAV4", 0.941667), ("ACCORD", "CIVIC", 0.577778), ("COROL", "CAMRY", 0.64), ("AB", "AC", 0.0), ("X3", "X4", 0.0), ("", "", 1.0), ("A", "", 0.0), ("cx", "CX", 1.0)])
def test_jaro_winkler(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sim.jaro_winkler(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-6)


def test_similarity_columns(spark):
    df = spark.createDataFrame([("VOLV0", "volvo"), ("CX3", "CX-3"), ("F150", "F250"), (None, "A")], "a string, b string")
    got = df.select(sim.edit_similarity(F.col("a"), F.col("b")), sim.hyphen_boost(F.col("a"), F.col("b"), F.lit(0.1)), sim.numeric_difference(F.col("a"), F.col("b")), sim.combined_similarity(F.col("a"), F.col("b")), sim.normal_make(F.col("a")), sim.hyphenated(F.col("a"))).collect()
    assert [r[0] for r in got] == [0.8, 0.75, 0.75, None]
    assert [r[1] for r in got] == [0.1, 0.99, 0.1, 0.1]
    assert [r[2] for r in got] == [False, False, True, False]
    assert got[0][3] == pytest.approx(0.4 * 0.8 + 0.6 * 0.92)
    assert [r[4] for r in got] == ["VOLVO", "CX3", "F150", None]
    assert [r[5] for r in got] == ["VOLV-0", "CX-3", "F-150", None]


def test_wear(spark):
    assert coefficient((45.0, 55.0)) == pytest.approx(0.1325125)
    assert coefficient((30.0, 35.0, 35.0)) == pytest.approx(0.0381125)
    assert all(valid(w) for w in BY_AXLES.values()) and not valid((50.0, 40.0)) and not valid(())
    with pytest.raises(ValueError):
        Wear(((2, (10.0, 10.0)),))
    rows = [(2, "AU", 2000.0), (9, None, 10.0), (None, "AB", 10.0), (None, None, 10.0), (1, "CA", 10.0), (2, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "max_axles int, vehicle_type string, net_mass double").select(Wear().index()).collect()]
    want = [0.1325125 * 2000.0**4, coefficient(BY_AXLES[6]) * 1e4, 0.1935125e4, 0.125e4, 0.0381125e4]
    assert got[:5] == pytest.approx(want) and got[5] is None
    weights = F.array(F.lit(45.0), F.lit(55.0))
    assert spark.range(1).select(coefficient_of(weights)).first()[0] == pytest.approx(0.1325125)


def test_normal_make_map(spark):
    assert one(spark, "hond", sim.normal_make) == "HONDA"
    assert [one(spark, x, sim.motorcycle_model) for x in ("CBR600", "AB123", "CIVIC")] == [True, True, False]
    assert [one(spark, x, sim.passenger_model) for x in ("CIVIC", "X-5", "??")] == [True, True, False]


def test_saved_wear_and_answers(spark):
    assert Wear.from_json(Wear().to_json()).to_json() == Wear().to_json()
    from cohortline.operators.resolve import parse_answer

    cases = {"Classification: SpellingVariant. Confidence: 0.9": ("spelling", True, 0.9), "classification: new model, confidence 85": ("new", False, 0.85), "This is a truncation": ("truncation", True, 0.7), "a genuinely new one": ("new", False, 0.7), "hm": ("uncertain", False, 0.7)}
    for text, want in cases.items():
        assert tuple(one(spark, text, parse_answer)) == want
