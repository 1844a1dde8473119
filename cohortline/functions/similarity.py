"""Similarity of make and model codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of makes, substrings and forms of model codes.
MAKE_VARIANTS = {"VOLV0": "VOLVO", "HOND": "HONDA", "TOYOT": "TOYOTA", "MERCE": "MERCEDES-BENZ", "CHEVR": "CHEVROLET", "VOLKSW": "VOLKSWAGEN", "MAZD": "MAZDA"}
MOTORCYCLE_PARTS = ("CBR", "GSX", "NINJA", "R1250", "R1200", "FZ", "MT-", "YZF", "ZX", "VFR", "HAYABUSA", "SUPER", "STREET")
MOTORCYCLE_FORM, PASSENGER_FORMS = "^[A-Z]{2,4}[0-9]{3,4}$", ("^[A-Z]{3,8}$", "^[A-Z]{1,2}-?[0-9]{1,3}[A-Z]{0,2}$")
NUMERIC_LIMIT = 0.15


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance's share of the longer string, upper-cased; two empty strings are equal."""
    x, y = F.upper(a), F.upper(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y).cast("double") / longest.cast("double"))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two strings, upper-cased, by array functions alone; null if either is.

    Letters of ``a`` take the first free equal letter of ``b`` within reach, one after another.  Two departures from the
    textbook form: with a match window of 0 only equal strings are alike, and the prefix always counts, however low
    the Jaro value is.
    """
    x, y = F.upper(a), F.upper(b)
    n, m = F.length(x), F.length(y)
    reach = F.floor(F.greatest(n, m) / 2).cast("int") - 1
    start = F.struct(y.alias("free"), F.array().cast("array<int>").alias("taken"))

    def take(s: Column, i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(1))
        at = F.call_function("locate", F.substring(x, i, F.lit(1)), s["free"], low)
        found = (at > 0) & (at <= i + reach)
        return F.struct(F.when(found, F.call_function("overlay", s["free"], F.lit("\0"), at, F.lit(1))).otherwise(s["free"]).alias("free"), F.when(found, F.array_append(s["taken"], at)).otherwise(s["taken"]).alias("taken"))

    def value(s: Column) -> Column:
        found = F.size(s["taken"])
        letter = lambda k: F.substring(y, k, F.lit(1))
        moved = F.size(F.filter(F.zip_with(s["taken"], F.array_sort(s["taken"]), lambda p, q: letter(p) != letter(q)), lambda z: z)) / 2
        jaro = (found / n + found / m + (found - moved) / found) / 3
        prefix = sum((F.when(F.least(n, m) >= k, F.when(F.substring(x, 1, k) == F.substring(y, 1, k), 1).otherwise(0)).otherwise(0) for k in range(1, 5)), F.lit(0))
        return F.when(found == 0, 0.0).otherwise(jaro + 0.1 * prefix * (1 - jaro))

    alike = F.aggregate(F.sequence(F.lit(1), n), start, take, value)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(x == y, 1.0).when((n == 0) | (m == 0) | (reach <= 0), 0.0).otherwise(alike)


def jaro_winkler_most(a: Column, b: Column) -> Column:
    """What ``jaro_winkler`` can be at most, by lengths and by the letters that only one of two strings has."""
    x, y = F.upper(a), F.upper(b)
    n, m = F.length(x), F.length(y)
    other = lambda p, q: F.length(F.call_function("translate", p, q, F.lit("")))
    found = F.least(n - other(x, y), m - other(y, x))
    jaro = F.when(found > 0, (found / F.greatest(n, F.lit(1)) + found / F.greatest(m, F.lit(1)) + 1) / 3).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(jaro + 0.4 * (1 - jaro) * (found > 0).cast("int"))


def combined_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """0.4 of the edit similarity and 0.6 of Jaro-Winkler; 0 where a bound tells that this is below ``least``."""
    edit = edit_similarity(a, b)
    return F.when(0.4 * edit + 0.6 * jaro_winkler_most(a, b) >= least - 1e-9, 0.4 * edit + 0.6 * jaro_winkler(a, b)).when(a.isNotNull() & b.isNotNull(), 0.0)


def hyphen_match(a: Column, b: Column) -> Column:
    """Whether two codes differ in hyphens only."""
    return (F.replace(a, F.lit("-"), F.lit("")) == F.replace(b, F.lit("-"), F.lit(""))) & (a != b)


def hyphen_boost(a: Column, b: Column, score: Column) -> Column:
    return F.when(hyphen_match(a, b), F.lit(0.99)).otherwise(score)


def numeric_difference(a: Column, b: Column, limit: float = NUMERIC_LIMIT) -> Column:
    """Whether the numbers made of all digits of two codes differ by more than a share of the smaller one."""
    x, y = (F.regexp_replace(c, "[^0-9]", "").try_cast("bigint") for c in (a, b))
    share = F.abs(x - y).cast("double") / F.least(x, y).cast("double")
    return F.coalesce(F.when((x > 0) & (y > 0), share > limit), F.lit(False))


def hyphenated(c: Column) -> Column:
    """``CX3`` becomes ``CX-3``: letters and then a digit."""
    return F.regexp_replace(c, "^([A-Za-z]+)([0-9].*)$", "$1-$2")


def motorcycle_model(c: Column) -> Column:
    return F.upper(c).rlike("|".join(MOTORCYCLE_PARTS) + "|" + MOTORCYCLE_FORM)


def passenger_model(c: Column) -> Column:
    return F.upper(c).rlike("|".join(PASSENGER_FORMS))


def normal_make(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MAKE_VARIANTS.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == F.upper(c))), F.lit(0)), F.upper(c))
