"""Imports of yearly files: one after another by year, each replacing its year, with counts and a log; and the writer of the yearly layout."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import readers, store

# Names that a column has in the later layout, the first that a file has counting.
LATER_NAMES = {
    "period": ("Année civile", "Année civile / mois"), "make": ("Marque du véhicule (fabricant)", "Marque"), "model": ("Modèle du véhicule", "Modèle"),
    "model_year": ("Année du modèle du véhicule", "Année de fabrication"), "region": ("Région admin (code)",), "municipality": ("Municipalité (description)", "Municipalité"),
}


@dataclass(frozen=True)
class Result:
    """What an import did: rows stored, and lines that were dropped for their number of fields."""

    path: str
    year: int
    stored: int
    dropped: int


def year_of(path: str) -> int:
    """The first run of exactly four digits in a file's name."""
    found = re.search(r"(?<![0-9])[0-9]{4}(?![0-9])", path.rsplit("/", 1)[-1])
    if not found:
        raise readers.SourceError(f"no year in the name of {path}")
    return int(found[0])


def import_files(spark: SparkSession, paths: list[str], table: str, log: str | None = None, family: str = "vehicles") -> list[Result]:
    """Imports files by year into a table partitioned by year.

    A year that is there already is replaced, in this family's table alone.  Of rows with the same sequence
    one is kept, chosen by their values, so that a second import gives the same.  Each file is parsed once, to a
    folder beside the year's, which takes its place if no sequence is there twice; stored rows and dropped lines are
    counted while they are written.
    """
    read = readers.vehicles if family == "vehicles" else readers.licences
    out = []
    for path in sorted(paths, key=year_of):
        year = year_of(path)
        seen, lines = Observation(), Observation()
        rows = read(spark, path, year, lines)
        of = [c for c in rows.columns if c not in ("year", "sequence")]
        order = F.xxhash64(*of)  # equal rows are one; of others under one sequence any is as good, but always the same
        beside = f"{table}/_new-{uuid.uuid4().hex}"
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("year").parquet(beside)
            stored, dropped = seen.get["n"], lines.get["bad"]
            kept = store.once(spark.read.schema(rows.schema).parquet(beside), ["year", "sequence"], [order])
            if kept is None:
                store.put_years(spark, beside, table)
            else:
                counted = Observation()
                store.write_years(kept.select(*rows.columns).observe(counted, F.count(F.lit(1)).alias("n")), table, dealt=True)
                stored = counted.get["n"]
        finally:
            store.delete_all(spark, [beside])
        out.append(Result(path, year, stored, dropped))
        if log:
            store.log_import(spark, log, path.rsplit("/", 1)[-1], year, stored, dropped, family)
    return out


@dataclass(frozen=True)
class Batch:
    """What an import of many files did, and the files that it could not take, with reasons."""

    results: list[Result]
    failed: list[tuple[str, str]]


def import_all(spark: SparkSession, paths: list[str], table: str, rejects: str | None = None, log: str | None = None, family: str = "vehicles") -> Batch:
    """Imports files in one job: each replaces its year, and a broken one does not stop the others.

    A file may be a folder of parts.  The driver reads the heads of files for their dialects alone; files of a dialect are one scan, and all lines are
    parsed once, to a table beside.  From there good rows go to their years, one for each sequence, and rejected lines
    with file, year and reason to ``rejects``; one aggregation counts both by file.  Of several files of a year the last
    is taken, in the order of names.
    """
    vehicle, failed, by = family == "vehicles", [], {}
    last = {year_of(p): p for p in sorted(p for p in paths if _has_year(p))}
    for path in sorted(paths):
        year = year_of(path) if _has_year(path) else None
        if year is None or last[year] != path:
            failed.append((path, "there is no year in its name" if year is None else "a later file has its year"))
            continue
        try:
            how = readers.dialect(spark, path, readers.vehicle_columns(year) if vehicle else readers.LICENCE_COLUMNS, vehicle)
        except Exception as e:  # noqa: BLE001  whatever keeps a file from being read is told, and the others go on
            failed.append((path, str(e).splitlines()[0]))
            continue
        by.setdefault((how, readers.is_folder(spark, path)), []).append(path)
    if not by:
        return Batch([], failed)
    of_file = {_plain(spark, p): y for y, p in last.items()}
    years = spark.createDataFrame(list(of_file.items()), "_file string, _year int")
    staged, stage = None, store.work_dir(spark)
    for (how, folder), some in by.items():
        rows, good = readers.read_dialect(spark, some, how, repaired=vehicle)
        source = F.regexp_replace("file", "/[^/]*$", "") if folder else F.col("file")
        rows = rows.join(F.broadcast(years), F.regexp_replace(source, "^file:/+", "file:/") == F.col("_file"))  # a row for each file
        facts = readers.vehicle_facts(F.col("_year"), "TYP_CARBU" in how.names) if vehicle else readers.licence_facts(F.col("_year"))
        reason = F.when(~good, F.format_string("%d fields in place of %d", F.size("f"), F.lit(len(how.names))))
        one = rows.select(*facts, F.col("_file"), reason.alias("_reason"), F.when(~good, F.col("line")).alias("_line"))
        staged = one if staged is None else staged.unionByName(one)
    try:
        staged.write.parquet(stage)
        staged = spark.read.parquet(stage)
        good = staged.where("_reason is null").drop("_file", "_reason", "_line")
        of = [c for c in good.columns if c not in ("year", "sequence")]
        kept = store.once(good, ["year", "sequence"], [F.xxhash64(*of)])
        store.write_years(good if kept is None else kept.select(*good.columns), table, dealt=True)
        counts = {r["_file"]: r for r in staged.groupBy("_file").agg(F.count_if(F.col("_reason").isNull()).alias("good"), F.count("_reason").alias("bad")).collect()}  # a row for each file
        stored = {r.year: r.n for r in spark.read.parquet(table).groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}  # ... and for each year
        if rejects:
            lines = staged.where("_reason is not null").select(F.col("_file").alias("file"), "year", F.col("_reason").alias("reason"), F.col("_line").alias("line"))
            lines.withColumn("import_date", F.current_timestamp()).write.mode("append").parquet(rejects)
    finally:
        store.delete_all(spark, [stage])
    results = []
    for year, path in sorted(last.items()):
        r = counts.get(_plain(spark, path))
        if any(path in some for some in by.values()):
            results.append(Result(path, year, stored.get(year, 0) if r and r.good else 0, r.bad if r else 0))
    if log:
        store.log_imports(spark, log, [(r.path.rsplit("/", 1)[-1], r.year, r.stored, r.dropped) for r in results], family)
    return Batch(results, failed)


def _has_year(path: str) -> bool:
    return re.search(r"(?<![0-9])[0-9]{4}(?![0-9])", path.rsplit("/", 1)[-1]) is not None


def _plain(spark: SparkSession, path: str) -> str:
    """A file's name as Spark tells it, with one slash after ``file:``."""
    place, system = store._folder(spark, path)
    return re.sub("^file:/+", "file:/", system.makeQualified(place).toUri().toString())


def later_layout(raw: DataFrame) -> DataFrame:
    """The columns that ``readers.normalise`` takes, from whichever names a later file has; a missing one is empty.

    Damaged names and values are repaired with the spellings of these files.
    """
    known = {reduce(lambda x, p: x.replace(*p), sorted(tx.SCRIPT_MOJIBAKE.items(), key=lambda p: -len(p[0])), c): c for c in raw.columns}
    pick = {new: next((known[n] for n in names if n in known), None) for new, names in LATER_NAMES.items()}
    return raw.select(*[(tx.repair_mojibake(F.col(f"`{old}`"), tx.SCRIPT_MOJIBAKE) if old else F.lit("")).alias(new) for new, old in pick.items()])


def write_yearly(rows: DataFrame, path: str) -> None:
    """Writes rows in the yearly layout, every value quoted."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(path)


def families(spark: SparkSession, path: str, names: tuple[str, ...] = ("registrations", "licences")) -> set[str]:
    """The fact families that a package has rows of, by its manifest."""
    said = json.loads(spark.read.text(f"{path}/manifest").first().value)
    return {n for n in names if said.get(n, {}).get("rows", 0) > 0}
