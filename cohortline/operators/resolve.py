"""Entity resolution: candidates for unknown pairs, evidence for and against, and a decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import combined_similarity, edit_similarity, hyphen_boost, hyphenated, motorcycle_model, normal_make, numeric_difference, passenger_model
from ..sources.store import written

# Thresholds and confidences of the evidence, and body types by keyword in order.
RECENT, GAP = 2023, 2
PASSENGER, MOTORCYCLE, SPECIAL = ("PAU", "CAU", "VUS"), ("MOTO", "CYC", "CYCL", "PMC", "CMC", "RMC"), ("MONE", "AGRI", "CONS", "TRAC", "HMN", "HVO", "HVT", "CVO", "RMN", "HOT", "ROT")
BODY_TYPES = (("SEDAN", "SEDAN"), ("VAN", "MINIVAN"), ("SUV", "SUV"), ("HATCH", "HATCHBACK"), ("WAGON", "WAGON"), ("COUPE", "COUPE"), ("PICKUP", "PICKUP"), ("TRUCK", "PICKUP"), ("CONVERTIBLE", "CONVERTIBLE"))

#: Letters of the pieces by which strings meet, and the levels that a best match is looked for at, from the highest down.
Q = 2
LEVELS = (0.85, 0.7)


def candidates(unknown: DataFrame, known: DataFrame, block: tuple[str, str], score: Column, least: float) -> DataFrame:
    """Pairs of unknown ``(make, model)`` and known ``(canonical_make, canonical_model)`` with at least ``least`` as ``score``.

    The block names an unknown and a known column that are equal for a pair: an equality join.
    """
    joined = unknown.join(known, unknown[block[0]] == known[block[1]])
    return joined.withColumn("score", score).where(F.col("score") >= least)


def spelled(df: DataFrame, text: Column) -> DataFrame:
    """Rows whose ``text`` is not null, with it upper-cased, its length, and its q-grams with their places."""
    df = df.where(text.isNotNull()).withColumn("_s", F.upper(text)).withColumn("_n", F.length("_s"))
    places = F.when(F.col("_n") >= Q, F.sequence(F.lit(0), F.col("_n") - Q)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("_g", F.transform(places, lambda i: F.struct(F.substring(F.col("_s"), i + 1, F.lit(Q)).alias("g"), i.alias("p"))))


def indexed(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists of ``spelled`` rows with their q-grams ``(f, g, p)`` from the rarest to the most frequent of both.

    They are indexed as one list and written once.
    """
    both = x.withColumn("_first", F.lit(True)).unionByName(y.withColumn("_first", F.lit(False)), allowMissingColumns=True)
    often = both.select(F.explode("_g.g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    own = [c for c in both.columns if c != "_g"]
    each = both.select(*own, F.explode_outer("_g").alias("x")).select(*own, F.col("x.g").alias("g"), F.col("x.p").alias("p")).join(often, "g", "left")
    done = written(each.groupBy(*own).agg(F.sort_array(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("f", "g", "p")))).alias("_k")))
    side = lambda df, first: done.where(F.col("_first") == first).select(*[c for c in df.columns if c != "_g"], "_k")
    return side(x, True), side(y, False)


def meeting(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Candidates of two ``indexed`` lists with other names, and ``_x``, ``_y`` (upper-cased) and ``_most`` (edits that they may
    differ in): all pairs of similarity ``least`` or more are among them, some more than once.

    An edit touches ``Q`` q-grams at most, so of the ``most * Q + 1`` rarest of a string one is untouched and is among the
    other's rarest too, moved by as many places as there are edits at most; and all but ``most * Q`` are in both.  Strings that are too short to have as many
    meet all that fit in length, by equality of lengths.
    """
    edits = F.floor((1 - least) * F.floor(F.col("_n") / least + 1e-9) + 1e-9).cast("int")  # with the longest that is close
    last = F.get("_k", edits * Q)
    rare = F.filter("_k", lambda z: last.isNull() | (F.struct(z["f"], z["g"]) <= F.struct(last["f"], last["g"])))  # all that are as the last one too
    by_gram = F.transform(rare, lambda z: F.struct(F.concat(F.lit("~"), z["g"]).alias("k"), z["p"].alias("p")))
    by_length = lambda n: F.struct(F.concat(F.lit("="), n.cast("string")).alias("k"), F.lit(0).alias("p"))
    lengths = F.transform(F.sequence(F.ceil(F.col("_n") * least - 1e-9).cast("int"), F.floor(F.col("_n") / least + 1e-9).cast("int")), by_length)
    short = F.col("_n") - Q + 1 <= edits * Q

    def keyed(df: DataFrame, keys: Column, name: str) -> DataFrame:
        own = [c for c in df.columns if c[0] != "_"]
        return df.select(*own, F.col("_s").alias(f"_{name}"), F.col("_n").alias(f"_n{name}"), F.array_distinct("_k.g").alias(f"_g{name}"), F.explode(keys).alias("_e")).select(*own, f"_{name}", f"_n{name}", f"_g{name}", F.col("_e.k").alias("_key"), F.col("_e.p").alias(f"_p{name}"))

    sc = x.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # little data, but much to compare
    keyed_x, keyed_y = keyed(x, F.when(short, lengths).otherwise(by_gram), "x"), keyed(y, F.concat(by_gram, F.array(by_length(F.col("_n")))), "y")
    met = keyed_x.repartition(tasks, "_key").join(keyed_y.repartition(tasks, "_key"), "_key")
    met = met.withColumn("_most", F.floor(F.greatest("_nx", "_ny") * (1 - least) + 1e-9).cast("int"))
    near = (F.abs(F.col("_nx") - F.col("_ny")) <= F.col("_most")) & (F.abs(F.col("_px") - F.col("_py")) <= F.col("_most"))
    shared = F.size(F.array_intersect("_gx", "_gy")) >= F.greatest(F.size("_gx"), F.size("_gy")) - F.col("_most") * Q
    return met.where(near).where(shared).drop("_key", "_nx", "_ny", "_px", "_py", "_gx", "_gy")


def close_enough(met: DataFrame, least: float) -> DataFrame:
    """Candidates of ``meeting`` that are as similar as that, without its columns."""
    met = met.withColumn("_e", F.expr("levenshtein(_x, _y, _most)"))  # stops where there are more
    longest = F.greatest(F.length("_x"), F.length("_y"))
    close = F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.col("_e").cast("double") / longest.cast("double"))
    return met.where((F.col("_e") >= 0) & (close >= least)).drop("_x", "_y", "_most", "_e")


def close_strings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: all pairs of two lists of strings (columns ``a`` and ``b``) of an edit similarity of ``least`` or more."""
    x, y = indexed(spelled(a.select("a").distinct(), F.col("a")), spelled(b.select("b").distinct(), F.col("b")))
    return close_enough(meeting(x, y, least).distinct(), least)


def by_levels(unknown: DataFrame, known: DataFrame, keys: list[str], top: Callable[[DataFrame], DataFrame], least: float, more: DataFrame | None = None) -> DataFrame:
    """The best match of each ``spelled`` row of ``unknown``: at each level ``top`` takes the close pairs and scores them, and
    only rows without one go on to the next.  ``more`` are pairs of the first level besides.

    Both lists are indexed once.  They and what is found at a level are written, as lists of codes; where nothing is
    left, lower levels are not planned at all.
    """
    x, y = indexed(unknown, known)
    out, left = None, x
    open_ = left.count()
    for level in [k for k in LEVELS if k > least] + [least]:
        pairs = close_enough(meeting(left, y, level), level)
        pairs = pairs.unionByName(more) if out is None and more is not None else pairs
        found = written(top(pairs).where(F.col("score") >= level))
        out = found if out is None else out.unionByName(found)
        open_ -= found.count()  # a row for each that is resolved
        if level == least or not open_:
            return out
        left = left.join(found.select(*keys), keys, "left_anti")
    raise AssertionError


def best(found: DataFrame) -> DataFrame:
    """The best candidate of each pair; ties go to the first make and model."""
    order = F.struct((-F.col("score")).alias("s"), "canonical_make", "canonical_model", "score")
    return found.groupBy("make", "model").agg(F.min(order).alias("b")).select("make", "model", "b.canonical_make", "b.canonical_model", "b.score")


def weighted_score(least_make: float = 0.7) -> Column:
    """0.7 of the makes' and 0.3 of the models' similarity, 0 where the makes differ too much."""
    makes = edit_similarity(F.col("make"), F.col("canonical_make"))
    return F.when(makes >= least_make, 0.7 * makes + 0.3 * edit_similarity(F.col("model"), F.col("canonical_model"))).otherwise(0.0)


def joined_score() -> Column:
    """Similarity of make and model as one string, 0.99 for models that differ in hyphens only."""
    whole = edit_similarity(F.concat("make", "model"), F.concat("canonical_make", "canonical_model"))
    return hyphen_boost(F.col("model"), F.col("canonical_model"), whole)


def blocked_score() -> Column:
    return hyphen_boost(F.col("model"), F.col("canonical_model"), combined_similarity(F.col("model"), F.col("canonical_model"), 0.75))


def best_weighted(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """Makes that are close enough meet first, and only their models are compared."""
    makes = close_strings(unknown.select(F.col("make").alias("a")), known.select(F.col("canonical_make").alias("b")), 0.7)
    met = unknown.join(makes, unknown["make"] == makes["a"]).join(known, F.col("b") == known["canonical_make"])
    return best(met.withColumn("score", weighted_score()).where("score >= 0.70"))


def best_joined(unknown: DataFrame, known: DataFrame, least: float = 0.4) -> DataFrame:
    """The most alike by make and model as one string.

    Pairs meet level by level (``by_levels``), and models that differ in hyphens only by an equality join.
    """
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    hyphens = unknown.join(known, bare("model") == bare("canonical_model")).where(F.col("model") != F.col("canonical_model"))
    x, y = spelled(unknown, F.concat("make", "model")), spelled(known, F.concat("canonical_make", "canonical_model"))
    return by_levels(x, y, ["make", "model"], lambda pairs: best(pairs.withColumn("score", joined_score())), least, hyphens)


def best_blocked(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """Models of the same make, however it is spelt, by edit and Jaro-Winkler similarity."""
    u, k = unknown.withColumn("_make", normal_make(F.col("make"))), known.withColumn("_canonical", normal_make(F.col("canonical_make")))
    return best(candidates(u, k, ("_make", "_canonical"), blocked_score(), 0.75))


def standard_makes(unknown: DataFrame, known: DataFrame, least: float = 0.4) -> DataFrame:
    """The known make that each unknown make is most like, level by level."""
    def top(pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("score", edit_similarity(F.col("make"), F.col("canonical_make")))
        return scored.groupBy("make").agg(F.min(F.struct((-F.col("score")).alias("s"), "canonical_make", "score")).alias("b")).select("make", "b.canonical_make", "b.score")

    x, y = spelled(unknown.select("make").distinct(), F.col("make")), spelled(known.select("canonical_make").distinct(), F.col("canonical_make"))
    return by_levels(x, y, ["make"], top, least)


def _of(decision: str, confidence: float) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"))


def found_evidence(own: Column, other: Column) -> Column:
    """``(decision, confidence)`` from the types of a reference table, in the short form: only equal types support."""
    both = F.when(own == other, _of("SUPPORT", 0.9)).otherwise(_of("PREVENT", 0.9))
    return F.when(own.isNotNull() & other.isNotNull(), both).when(own.isNotNull(), _of("PREVENT", 0.9)).when(other.isNotNull(), _of("SUPPORT", 0.8)).otherwise(_of("NEUTRAL", 0.5))


def span_evidence(a: Column, b: Column, x: Column, y: Column) -> Column:
    """``(decision, confidence)`` from years of registration, in the short form: later than the known one, or apart in any other way."""
    missing = a.isNull() | b.isNull() | x.isNull() | y.isNull()
    return F.when(missing, _of("NEUTRAL", 0.5)).when((b >= x) & (y >= a), _of("SUPPORT", 0.9)).when(a > y, _of("PREVENT", 0.7)).otherwise(_of("PREVENT", 0.8))


def set_evidence(own: Column, other: Column) -> Column:
    """``(valid, confidence)`` from the sets of reference vehicles of an unknown and a known pair (empty: not in the table)."""
    of = lambda v, c: F.struct(F.lit(v).alias("valid"), F.lit(c).alias("confidence"))
    has, knows = F.size(own) > 0, F.size(other) > 0
    return F.when(~has & ~knows, of(True, 0.5)).when(has & knows & F.arrays_overlap(own, other), of(True, 0.9)).when(has & ~knows, of(False, 0.9)).when(~has & knows, of(True, 0.8)).otherwise(of(True, 0.6))


def model_year_evidence(a: Column, b: Column, x: Column, y: Column) -> Column:
    """``(valid, confidence)`` from model years: they meet, or the unknown ones follow within two years."""
    of = lambda v, c: F.struct(F.lit(v).alias("valid"), F.lit(c).alias("confidence"))
    missing = a.isNull() | b.isNull() | x.isNull() | y.isNull()
    return F.when(missing, of(True, 0.5)).when((b >= x) & (y >= a), of(True, 0.9)).when((a > y) & (a - y <= 2), of(True, 0.7)).otherwise(of(False, 0.8))


def standardise_makes(unknown: DataFrame, known: DataFrame, facts: DataFrame, reference: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """What to do with each unknown make: its best known one, the evidence, and whether to put that in its place.

    ``reference`` has a type for each ``ref_make`` that it knows, ``proposed`` (make, standardise) what was
    proposed from outside (nothing: yes).  A reference table that prevents with 0.9, or years that
    prevent with 0.8, overrule it, the latter having the last word on the reason.
    """
    types = reference.groupBy("ref_make").agg(F.min("ref_type").alias("t"))
    years = facts.groupBy("make").agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    out = standard_makes(unknown, known)
    for name, own in (("make", "own"), ("canonical_make", "other")):
        t = types.select(F.col("ref_make").alias(f"_{own}"), F.col("t").alias(f"{own}_type"))
        y = years.select(F.col("make").alias(f"_{own}y"), F.col("from_year").alias(f"{own}_from"), F.col("to_year").alias(f"{own}_to"))
        out = out.join(t, F.col(name) == F.col(f"_{own}"), "left").join(y, F.col(name) == F.col(f"_{own}y"), "left").drop(f"_{own}", f"_{own}y")
    out = out.withColumns({"by_type": found_evidence(F.col("own_type"), F.col("other_type")), "by_years": span_evidence(*[F.col(c) for c in ("own_from", "own_to", "other_from", "other_to")])})
    out = out.join(proposed, "make", "left") if proposed is not None else out.withColumn("standardise", F.lit(True))
    prevents = lambda e, least: (F.col(e)["decision"] == "PREVENT") & (F.col(e)["confidence"] >= least)
    reason = F.when(prevents("by_years", 0.8), "years").when(prevents("by_type", 0.9), "reference").otherwise("proposal")
    return out.select("make", "canonical_make", "score", "by_type", "by_years", (F.coalesce("standardise", F.lit(True)) & (reason == "proposal")).alias("standardise"), reason.alias("reason"))


def temporal_evidence(a: Column, b: Column, x: Column, y: Column) -> Column:
    """``(decision, confidence)`` from the years ``a`` to ``b`` of an unknown pair and ``x`` to ``y`` of a known one."""
    of = lambda d, c: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"))
    missing = a.isNull() | b.isNull() | x.isNull() | y.isNull()
    return F.when(missing, of("NEUTRAL", 0.0)).when((b >= x) & (y >= a), of("SUPPORT", 0.90)).when((a >= RECENT) & (y < RECENT), of("NEUTRAL", 0.70)).when(a > y + GAP, of("PREVENT", 0.80)).otherwise(of("PREVENT", 0.75))


def reference_evidence(own: Column, other: Column, other_types: Column) -> Column:
    """``(decision, confidence)`` from the types that a reference table gives to an unknown and a known pair (null: not in it)."""
    of = lambda d, c: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"))
    both, crossed = own.isNotNull() & other.isNotNull(), own.isin(*PASSENGER) & other.isin(*MOTORCYCLE) | own.isin(*MOTORCYCLE) & other.isin(*PASSENGER)
    same_kind = own.isin(*PASSENGER) & other.isin(*PASSENGER)
    known = F.when(own == other, of("SUPPORT", 0.95)).when(same_kind, of("SUPPORT", 0.85)).when(crossed, of("PREVENT", 0.99)).otherwise(of("PREVENT", 0.85))
    alone = F.when(F.array_contains(other_types, own), of("NEUTRAL", 0.60)).otherwise(of("PREVENT", 0.75))
    return F.when(both, known).when(own.isNotNull(), alone).when(other.isNotNull(), of("SUPPORT", 0.65)).otherwise(of("NEUTRAL", 0.0))


def reference_type(pairs: DataFrame, reference: DataFrame, make: str, model: str, name: str) -> DataFrame:
    """The reference table's type for a pair, else for the pair with a hyphen after the letters, as a new column."""
    r = reference.groupBy("ref_make", "ref_model").agg(F.min("ref_type").alias("t"))
    one, two = r.withColumnsRenamed({"ref_make": "m1", "ref_model": "o1", "t": "t1"}), r.withColumnsRenamed({"ref_make": "m2", "ref_model": "o2", "t": "t2"})
    out = pairs.join(one, (F.col(make) == F.col("m1")) & (F.col(model) == F.col("o1")), "left")
    out = out.join(two, (F.col(make) == F.col("m2")) & (hyphenated(F.col(model)) == F.col("o2")), "left")
    return out.withColumn(name, F.coalesce("t1", "t2")).drop("m1", "o1", "t1", "m2", "o2", "t2")


def decide(score: Column, model: Column, canonical_model: Column, reference: Column, temporal: Column) -> Column:
    """What to do with a pair: NEW, PRESERVE, REGULARIZE, or REVIEW where rules do not settle it."""
    def agrees(e: Column) -> Column:
        return (e["decision"] == "SUPPORT") | (e["confidence"] < 0.5)

    def prevents(e: Column, least: float) -> Column:
        return (e["decision"] == "PREVENT") & (e["confidence"] >= least)

    out = F.when(canonical_model.isNull(), "NEW").when(numeric_difference(model, canonical_model), "PRESERVE").when(score >= 0.99, "REGULARIZE")
    out = out.when(prevents(reference, 0.95) | prevents(temporal, 0.85), "PRESERVE")
    return out.when((score >= 0.90) & agrees(reference) & agrees(temporal), "REGULARIZE").when(prevents(reference, 0.90), "PRESERVE").otherwise("REVIEW")


def classify(model: Column, reference: Column, passenger: Column, motorcycle: Column, special: Column) -> Column:
    """``(kind, confidence)`` of a pair from the reference table's type, from what its make makes, and from the form of the model."""
    of = lambda d, c: F.struct(F.lit(d).alias("kind"), F.lit(c).alias("confidence"))
    by_reference = F.when(reference.isin(*PASSENGER), of("PAU/CAU", 0.95)).when(reference.isin(*MOTORCYCLE), of("MOTORCYCLE", 0.95)).when(reference.isin(*SPECIAL), of("SPECIALIZED", 0.95))
    by_make = by_reference.when(passenger & motorcycle & motorcycle_model(model), of("MOTORCYCLE", 0.80)).when(passenger & passenger_model(model), of("PAU/CAU", 0.85)).when(passenger, of("PAU/CAU", 0.70))
    by_make = by_make.when(motorcycle, of("MOTORCYCLE", 0.85)).when(special, of("SPECIALIZED", 0.85))
    return by_make.when(motorcycle_model(model), of("MOTORCYCLE", 0.70)).when(passenger_model(model), of("PAU/CAU", 0.60)).otherwise(of("UNKNOWN", 0.30))


def body_type(text: Column) -> Column:
    """A body type by the first keyword that a description has."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, kind in BODY_TYPES:
        out = out.when(F.contains(F.upper(text), F.lit(word)), kind)
    return out


def reference_keys(table: DataFrame) -> DataFrame:
    """The short keys of a reference table ``(make, model)``: the first five letters of the make and of the model's first word."""
    return table.withColumns({"ref_make": F.upper(F.substring("make", 1, 5)), "ref_model": F.upper(F.substring(F.split("model", " ")[0], 1, 5)), "ref_type": body_type(F.col("model"))})


def correct(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts with make and model put right: corrections ``(from_make, from_model, to_make, to_model)`` are joined on upper-cased codes."""
    c = corrections.groupBy(F.upper("from_make").alias("_make"), F.upper("from_model").alias("_model")).agg(F.min(F.struct("to_make", "to_model")).alias("_to"))
    joined = facts.join(c, (F.upper("make") == F.col("_make")) & (F.upper("model") == F.col("_model")), "left")
    return joined.withColumns({"make": F.coalesce("_to.to_make", "make"), "model": F.coalesce("_to.to_model", "model")}).drop("_make", "_model", "_to")


def parse_answer(text: Column) -> Column:
    """``(kind, correct, confidence)`` from a model's answer in words: a classification if it names one, else by its phrases."""
    low = F.lower(text)
    named = F.contains(low, F.lit("classification:"))
    has = lambda pattern: low.rlike(f"(?s){pattern}")
    by_name = F.when(has("spellingvariant|classification:.*spelling"), "spelling").when(has("truncationvariant|classification:.*truncation"), "truncation").when(has("newmodel|classification:.*new.*model"), "new").otherwise("uncertain")
    by_words = F.when(has("new model|genuinely new|genuinely different"), "new").when(has("spelling") & has("variant"), "spelling").when(has("truncation|schema"), "truncation").otherwise("uncertain")
    kind = F.when(named, by_name).otherwise(by_words)
    number = F.regexp_extract(low, r"confidence:?\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    confidence = F.coalesce(F.when(number > 1, number / 100).otherwise(number), F.lit(0.7))
    return F.struct(kind.alias("kind"), kind.isin("spelling", "truncation").alias("correct"), confidence.alias("confidence"))
