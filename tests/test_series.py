import pytest

from cohortline.operators import series


def frame(spark, values, first=2020):
    return spark.createDataFrame([(first + k, float(v)) for k, v in enumerate(values)], "year int, value double")


def values(df):
    return [r.value for r in df.orderBy("year").collect()]


@pytest.mark.parametrize("given,want", [((1000, 1100, 1200), (1.0, 1.1, 1.2)), ((0, 5, 7), (0, 5, 7)), ((-2, 4), (-2, 4)), ((50, 60, 55), (1.0, 1.2, 1.1))])
def test_normalise(spark, given, want):
    assert values(series.normalise(frame(spark, given))) == pytest.approx(want)


@pytest.mark.parametrize("given,want", [((100, 150, 200), (100, 250, 450)), ((100, -50, 75), (100, 50, 125)), ((), ())])
def test_cumulate(spark, given, want):
    assert values(series.cumulate(frame(spark, given))) == pytest.approx(want)


def test_order_of_transforms(spark):
    assert values(series.transform(frame(spark, (1000, 1100, 1200)), normalised=True, cumulative=True)) == pytest.approx([1.0, 2.1, 3.3])


def test_zero_fill_adds_and_removes(spark):
    got = series.zero_fill(frame(spark, (1, 2, 3)), (2019, 2021))
    assert [(r.year, r.value) for r in got.orderBy("year").collect()] == [(2019, 0.0), (2021, 2.0)]
    assert series.zero_fill(frame(spark, (1, 2)), ()).count() == 2
    assert series.transform(frame(spark, (1, 2)), (2030,), exclude_zeroes=True).count() == 2


def test_statistics(spark):
    r = series.statistics(frame(spark, (100, 200, 400))).first()
    assert (r.n, r.total, r.median, r.range, r.change, r.change_pct) == (3, 700.0, 200.0, 300.0, 300.0, 300.0)
    assert r.growth_pct == pytest.approx(100.0)
    one = series.statistics(frame(spark, (5,))).first()
    assert one.deviation == 0.0 and one.growth_pct is None


def test_axis(spark):
    r = series.axis(frame(spark, (0, 100))).first()
    assert (r.low, round(r.high, 6), r.stride) == (0.0, 110.0, 50.0)


def test_several_series_at_once(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 5.0)], "name string, year int, value double")
    got = {(r.name, r.year): r.value for r in series.normalise(df, ("name",)).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 2.0, ("b", 1): 1.0}
