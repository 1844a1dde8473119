"""Row pattern matching inside the JVM: ``A (D+ U+)+ P?`` over each client's clicks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, shared_dir

#: A row's longest distance from the one before it.
GAP = "30 minutes"
#: Rows that a step of a scan over partitions sees together.
BLOCK = 512
#: What follows the first row of a match, encoded: small letters may be P too.  No part can give back what it took, as
#: classes exclude each other, so that possessive quantifiers match what greedy ones do, without recursion.
FORM = "^((?:[Dd]++[Uu]++)++)([dp]?)"


def cents(value: Column) -> Column:
    """``floor(100 * value + 0.5)``, null for what is no finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.floor(100 * v + 0.5))


def near(client: Column, ts: Column, before: Column, then: Column, gap: str = GAP) -> Column:
    """Whether a row is of the same client as the row before it, and at most ``gap`` later."""
    return F.coalesce((client == before) & (ts <= then + F.expr(f"interval {gap}")), F.lit(False))


def letter(close: Column, sound: Column, own: Column, before: Column) -> Column:
    """D or U by the cents of a row and the one before it, null if neither fits."""
    return F.when(close & sound & (own < before), "D").when(close & sound & (own > before), "U")


def last_before(parts: DataFrame, part: str, value: str, block: int = BLOCK) -> DataFrame:
    """``(part, value)``: for each of the distinct ``part`` numbers the last ``value`` that is not null of a smaller one.

    Parts are taken in blocks, whose last values are carried on by the same means, so that no task sees more
    than a block: as many rounds as the number of parts has digits to the base of ``block``.
    """
    rows, levels = parts.select(F.col(part).cast("long").alias("p"), F.col(value).alias("v")), []
    top = rows.agg(F.max("p")).first()[0] or 0
    while True:
        blocks = rows.withColumn("b", F.expr(f"p div {block}"))
        w = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(blocks.select("p", "b", F.last("v", True).over(w).alias("v")))
        if top < block:
            break
        rows = blocks.groupBy("b").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("p"))).alias("v")).select(F.col("b").alias("p"), "v")
        top //= block
    out = levels.pop()
    while levels:
        carried = out.select(F.col("p").alias("b"), F.col("v").alias("more"))
        out = levels.pop().join(carried, "b", "left").select("p", "b", F.coalesce("v", "more").alias("v"))
    return out.select(F.col("p").alias(part), F.col("v").alias(value))


def total_before(counts: DataFrame, key: str, part: str, value: str, block: int = BLOCK) -> DataFrame:
    """``(key, part, value)``: the sum of ``value`` over a key's smaller parts, by blocks as in ``last_before``."""
    rows, levels = counts.select(F.col(key).alias("k"), F.col(part).cast("long").alias("p"), F.col(value).alias("v")), []
    top = rows.agg(F.max("p")).first()[0] or 0
    while True:
        blocks = rows.withColumn("b", F.expr(f"p div {block}"))
        w = Window.partitionBy("k", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(blocks.select("k", "p", "b", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("v")))
        if top < block:
            break
        rows = blocks.groupBy("k", "b").agg(F.sum("v").alias("v")).select("k", F.col("b").alias("p"), "v")
        top //= block
    out = levels.pop()
    while levels:
        carried = out.select("k", F.col("p").alias("b"), F.col("v").alias("more"))
        out = levels.pop().join(carried, ["k", "b"]).select("k", "p", "b", (F.col("v") + F.col("more")).alias("v"))
    return out.select(F.col("k").alias(key), F.col("p").alias(part), F.col("v").alias(value))


def ordered(clicks: DataFrame) -> DataFrame:
    """Distinct rows, dealt over all tasks in the order of client, time and id; ``at`` numbers them, ``part`` is the task.

    Rows that are equal have the same keys and so meet in a task; other columns than those that the pattern
    reads are compared by two 64-bit hashes.
    """
    rest = [F.col(f"`{c}`") for c in sorted(clicks.columns)]
    kind = F.col("kind")
    rows = clicks.where("client_id is not null and ts is not null").select(
        "client_id", "ts", "click_id", cents(F.col("value")).alias("cents"),
        (F.when(kind.isNotNull() & (kind != "error"), 1).otherwise(0) + F.when(kind == "click", 2).otherwise(0)).alias("kinds"),
        F.xxhash64(*rest).alias("h"), F.xxhash64(F.lit(1), *rest).alias("g"),
    )
    keys = ["client_id", "ts", "click_id", "h"]
    one = rows.repartitionByRange(*keys).dropDuplicates([*keys, "g", "cents", "kinds"]).sortWithinPartitions("client_id", "ts", "click_id", "h", "g")
    return one.select("client_id", "ts", "click_id", "cents", "kinds", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))


def fragments(clicks: DataFrame, gap: str = GAP) -> DataFrame:
    """Runs of rows that are D or U after their first row, cut where a task's rows begin.

    A row has its ``part``, the number ``head`` of its first row, ``seg`` (its rows in order), ``nxt`` (the row after
    it, if that may be a P), and, where it is the first or last of its part, what its neighbour has to know.
    """
    w = Window.partitionBy("part").orderBy("at")
    at = ordered(clicks).withColumns({"sound": F.expr("kinds & 1") == 1, "click": F.expr("kinds & 2") == 2}).drop("kinds")
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    close = near(F.col("client_id"), F.col("ts"), F.col("client_b"), F.col("ts_b"), gap)
    close_next = near(F.col("client_n"), F.col("ts_n"), F.col("client_id"), F.col("ts"), gap)
    rows = at.withColumns({"client_b": before("client_id"), "ts_b": before("ts"), "cents_b": before("cents"), "client_n": after("client_id"), "ts_n": after("ts"), "nxt": after(F.struct("click", "cents", "click_id"))})
    rows = rows.withColumn("letter", letter(close, F.col("sound"), F.col("cents"), F.col("cents_b")))
    rows = rows.withColumn("head", F.last(F.when(F.col("letter").isNull(), F.col("at")), True).over(w))
    rows = rows.withColumn("nxt", F.when(close_next & F.col("nxt.click") & F.col("nxt.cents").isNotNull(), F.col("nxt")))
    first, last = F.col("client_b").isNull(), F.col("client_n").isNull()
    return rows.groupBy("part", "head", "client_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "cents", "letter", "click", "click_id"))).alias("seg"), F.max_by("nxt", "at").alias("nxt"),
        F.max(F.when(first, F.struct("ts", "sound"))).alias("first"), F.max(F.when(last, F.col("ts"))).alias("last_ts"),
    )


def stitched(parts: DataFrame, gap: str = GAP) -> DataFrame:
    """Of fragments, those at the ends of parts, put together where a run goes on in the next part: a row or two for each part."""
    ends = parts.where("first is not null or last_ts is not null")
    last, first = ends.where("last_ts is not null"), ends.where("first is not null")
    known = first.select("part", F.col("part").cast("long").alias("prev"))
    prev = last_before(known, "part", "prev")
    tail = last.select(F.col("part").alias("prev"), F.col("client_id").alias("client_b"), F.col("last_ts").alias("ts_b"), F.element_at("seg", -1)["cents"].alias("cents_b"))
    row = F.element_at("seg", 1)
    close = near(F.col("client_id"), F.col("first.ts"), F.col("client_b"), F.col("ts_b"), gap)
    joint = first.join(prev, "part").join(tail, "prev", "left").select(
        "part", "prev", letter(close, F.col("first.sound"), row["cents"], F.col("cents_b")).alias("joint"), F.col("last_ts").isNotNull().alias("whole"),
        F.when(close & row["click"] & row["cents"].isNotNull(), F.struct(row["click"].alias("click"), row["cents"].alias("cents"), row["click_id"].alias("click_id"))).alias("p"),
    )
    # the part where the run that reaches into a part begins: the last one before that is not all one run that goes on
    start = last_before(joint.select("part", F.when(~(F.col("whole") & F.col("joint").isNotNull()), F.col("part").cast("long")).alias("start")), "part", "start")
    after = joint.where("prev is not null").select(F.col("prev").alias("part"), F.when(F.col("joint").isNull(), F.col("p")).alias("after"))
    into = joint.join(start, "part").select("part", "joint", "start")
    e = ends.join(into, "part").join(after, "part", "left")
    goes_on = F.col("first").isNotNull() & F.col("joint").isNotNull()
    tail_row = F.col("last_ts").isNotNull()
    own = F.when(goes_on, F.col("start")).when(tail_row, F.col("part")).otherwise(-1 - F.col("part"))  # a first one that neither goes on nor reaches the end is alone
    named = F.transform("seg", lambda x, i: F.when((i == 0) & goes_on, x.withField("letter", F.col("joint"))).otherwise(x))
    e = e.select(own.alias("run"), "part", "head", "client_id", named.alias("seg"), F.when(tail_row, F.col("after")).otherwise(F.col("nxt")).alias("nxt"))
    return e.groupBy("run").agg(F.first("client_id").alias("client_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "head", "seg"))), lambda x: x["seg"])).alias("seg"), F.max_by("nxt", F.struct("part", "head")).alias("nxt")).drop("run")


def found(runs: DataFrame) -> DataFrame:
    """A row for each start that matches, from runs ``(client_id, seg, nxt)``: what follows it is encoded and searched."""
    tail = F.struct(F.lit(None).cast("long").alias("at"), F.col("nxt.cents").alias("cents"), F.lit("P").alias("letter"), F.col("nxt.click").alias("click"), F.col("nxt.click_id").alias("click_id"))
    runs = runs.where(F.exists("seg", lambda x: x["letter"] == "U"))
    runs = runs.select("client_id", F.when(F.col("nxt").isNull(), F.col("seg")).otherwise(F.concat("seg", F.array(tail))).alias("seg"))
    starts = F.filter(F.sequence(F.lit(1), F.size("seg") - 1), lambda i: F.element_at("seg", i + 1)["letter"] == "D")
    each = runs.where(F.size("seg") > 2).select("client_id", "seg", F.explode(starts).alias("i")).withColumn("a", F.element_at("seg", F.col("i")))
    sign = lambda x: F.when(x["click"] & (x["cents"] >= F.col("a.cents")), F.lower(x["letter"])).otherwise(x["letter"])
    each = each.withColumn("code", F.array_join(F.transform(F.slice("seg", F.col("i") + 1, F.size("seg")), sign), ""))
    each = each.withColumns({"body": F.regexp_extract("code", FORM, 1), "end": F.regexp_extract("code", FORM, 2)}).where("body <> ''")
    labels = F.concat(F.lit("A"), F.upper("body"), F.when(F.col("end") != "", "P").otherwise(""))
    rows = F.slice("seg", F.col("i"), F.length("labels"))
    return each.withColumn("labels", labels).select(
        "client_id", F.col("a.at").alias("at"), F.col("a.click_id").alias("first_id"), F.element_at("seg", (F.col("i") + F.length("labels") - 1).cast("int"))["click_id"].alias("last_id"),
        F.length("labels").cast("long").alias("n_rows"), F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x["cents"]).alias("sum_cents"), "labels",
    )


def matches(clicks: DataFrame, gap: str = GAP) -> DataFrame:
    """Matches of ``A (D+ U+)+ P?`` in the distinct ``clicks`` of each client, ordered by time and id.

    A fits every row with a value, D needs cents below those of the row before and a kind other than ``error``, U
    the same above, P the kind ``click`` and at least the cents of A's row; all but A come at most ``gap`` after the row
    before.  Each row is tried as a start: rows ``client_id, match_no, first_id, last_id, n_rows, sum_cents,
    labels``, numbered by the order of starts within a client.

    Rows are dealt by range over client, time and id, so that a client with a third of all rows spreads over tasks.
    Each task finds its runs of D and U rows; only the runs at the ends of its rows meet their neighbours.  A run's
    starts are exploded one by one; what follows a start becomes a string in which small letters may be a P for that
    start, and a regular expression gives the lengths.  Work grows with the squares of the runs' lengths, as the labels do.

    Null clients or times are dropped; a null or infinite value, or one that is no number, fits no letter; a null kind
    is neither D, U nor P; equal rows count once, rows that differ in any column do not; rows with equal time and id
    are ordered by a hash; a null id comes first; an empty table gives no rows; further columns only tell rows apart.
    """
    spark = clicks.sparkSession
    place = f"{shared_dir(spark)}/pattern-{uuid.uuid4().hex}"
    try:
        fragments(clicks, gap).write.option("compression", "zstd").parquet(f"{place}/runs")
        runs = spark.read.parquet(f"{place}/runs")
        inner = runs.where("first is null and last_ts is null").select("client_id", "seg", "nxt")
        found(inner.unionByName(stitched(runs, gap))).withColumn("part", F.shiftright("at", 33)).write.option("compression", "zstd").parquet(f"{place}/found")
        all_ = spark.read.parquet(f"{place}/found")
        offset = total_before(all_.groupBy("client_id", "part").agg(F.count(F.lit(1)).alias("n")), "client_id", "part", "n")
        number = F.row_number().over(Window.partitionBy("client_id", "part").orderBy("at"))
        numbered = all_.withColumn("k", number).join(offset, ["client_id", "part"])
        return cut(numbered.select("client_id", (F.col("n") + F.col("k")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels"))
    finally:
        delete(spark, place)
