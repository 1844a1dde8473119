"""Facts in Parquet, partitioned by year: upsert, replacement and removal of years, an import log, packages."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import LICENCES, REGISTRATIONS


#: Tables of a package, and columns that each must have.
REQUIRED = {"registrations": tuple(x.split()[0] for x in REGISTRATIONS.split(", ")), "licences": tuple(x.split()[0] for x in LICENCES.split(", ")), "places": ("code", "name", "type", "parent_code"), "import_log": ("file_name", "year", "record_count", "status"), "hierarchy": ("make", "model", "model_year", "fuel_type", "vehicle_type", "n")}
FAMILIES = ("registrations", "licences")


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine only."""
    place = f"{_shared(spark)}/work-{uuid.uuid4().hex}"
    for made in _made:
        made.append(place)
    return place


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="work-")
    return base


#: Lists that each note the work folders made while they are open.
_made: list[list[str]] = []


def tidied(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` returns, without the work folders that it has made: a result that may read them is written before they go."""
    made: list[str] = []
    _made.append(made)
    try:
        out = run()
        return written(out) if made else out
    finally:
        _made.remove(made)
        delete_all(spark, made)


def written(df: DataFrame) -> DataFrame:
    """Computes ``df`` once: its rows are written to ``spark.checkpoint.dir``, which executors share, and go when nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _folder(spark, path)
    return system.exists(folder)


def last_wins(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order given.  Keys are unique but for repeats, so no group is large."""
    if not order:
        return facts.dropDuplicates(keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return facts.withColumn("_n", number).where("_n = 1").drop("_n")


#: Repeated keys, of which a hash is sent to all tasks at most.
MOST_REPEATED = 1_000_000


def once(staged: DataFrame, keys: list[str], order: list[Column], most: int = MOST_REPEATED) -> DataFrame | None:
    """``last_wins`` of rows that are written already, or None if no key is there twice.

    Only hashes of the keys are shuffled, to find those that are there twice; rows of these alone go through
    ``last_wins``, unless they are too many.
    """
    hashed = F.xxhash64(*keys)
    twice = written(staged.select(hashed.alias("_h")).repartition("_h").groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
    found = twice.count()
    if not found:
        return None
    if found > most:
        return last_wins(staged, keys, order)
    marked = staged.withColumn("_h", hashed)
    few = last_wins(marked.join(F.broadcast(twice), "_h", "left_semi").drop("_h"), keys, order)
    return marked.join(F.broadcast(twice), "_h", "left_anti").drop("_h").unionByName(few)


def put_years(spark: SparkSession, new: str, path: str) -> None:
    """Puts the years of a table that was written beside another in the place of those by renaming; other years stay."""
    made, system = _folder(spark, new)
    system.mkdirs(_folder(spark, path)[0])
    for name in sorted(x.getPath().getName() for x in system.listStatus(made) if x.getPath().getName().startswith("year=")):
        place, old = _folder(spark, f"{path}/{name}")[0], _folder(spark, f"{new}/_old-{name}")[0]
        if system.exists(place) and not system.rename(place, old):
            raise OSError(f"{path}/{name} cannot be renamed")
        if not system.rename(_folder(spark, f"{new}/{name}")[0], place):
            system.rename(old, place)  # as it was
            raise OSError(f"{new}/{name} cannot be renamed")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str] = ["year", "sequence"], ordinal: str | None = None) -> DataFrame:  # noqa: B006
    """``existing`` with the rows of ``new`` in place of those with the same keys; of rows of ``new`` with a key the last by ``ordinal``."""
    order = [F.desc(ordinal)] if ordinal else [F.desc_nulls_last(c) for c in new.columns if c not in keys]
    added = last_wins(new, keys, order)
    added = added.drop(ordinal) if ordinal else added
    return existing.join(added.select(*keys), keys, "left_anti").unionByName(added)


def tasks_for(facts: DataFrame, share: int = 16 << 20) -> int:
    """Tasks for rows of files: one for each ``share`` bytes of these, and all cores at least; 0 for rows that come from no files."""
    spark = facts.sparkSession
    places = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(x)) for x in facts.inputFiles()]  # names as in a URI
    sizes = [x.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(x).getLen() for x in places]
    return max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // share)) if sizes else 0


def write_years(facts: DataFrame, path: str, dealt: bool = False) -> None:
    """Writes facts by year; the years that they have replace those of the table, others stay.

    A year is split over tasks, unless the rows are ``dealt`` by key already.  The number of tasks follows from the
    files that the facts come from: facts of few columns are so small in a shuffle that tasks of a size there would
    sort many millions of rows.
    """
    if not dealt:
        tasks = tasks_for(facts)
        part = F.pmod(F.xxhash64(*[c for c in facts.columns if c != "year"]), F.lit(max(32, tasks // 4)))
        facts = facts.repartition(tasks, "year", part) if tasks else facts.repartition("year", part)
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def delete_years(spark: SparkSession, path: str, years: tuple[int, ...]) -> None:
    """Removes the folders of some years; no other data is read or written."""
    conf = spark._jsc.hadoopConfiguration()
    for y in years:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={y}")
        folder.getFileSystem(conf).delete(folder, True)


def delete_year(spark: SparkSession, year: int, tables: list[str], log: str | None = None) -> None:
    """Removes a year from all fact tables and its rows from the import log."""
    for path in tables:
        delete_years(spark, path, (year,))
    if log and exists(spark, log):
        beside = f"{log}-new-{uuid.uuid4().hex}"
        spark.read.parquet(log).where(~F.col("year").eqNullSafe(F.lit(year))).write.parquet(beside)
        swap(spark, beside, log)


def delete_all(spark: SparkSession, tables: list[str]) -> None:
    """Removes tables whole: facts, places and the log."""
    for path in tables:
        folder, system = _folder(spark, path)
        system.delete(folder, True)


def years_in(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("year").distinct()


#: What the log says of an import without and with lines that failed, by family.
STATUSES = {"vehicles": ("success", "partial"), "licences": ("completed", "completed_with_errors")}


def log_import(spark: SparkSession, path: str, file_name: str, year: int, good: int, bad: int, family: str = "vehicles") -> None:
    """Appends a row to the import log."""
    log_imports(spark, path, [(file_name, year, good, bad)], family)


def log_imports(spark: SparkSession, path: str, done: list[tuple[str, int, int, int]], family: str = "vehicles") -> None:
    """Appends a row for each import ``(file, year, good, bad)`` to the log."""
    rows = spark.createDataFrame([(f, y, good, STATUSES[family][bad > 0]) for f, y, good, bad in done], "file_name string, year int, record_count bigint, status string")
    rows.withColumn("import_date", F.current_timestamp()).write.mode("append").parquet(path)


def digests(df: DataFrame) -> dict[str, list]:
    """Of each year (of all rows, without a year): rows, and the sums of two hashes of each row, whatever the order of rows and columns."""
    by = F.coalesce(F.col("year").cast("string"), F.lit("")) if "year" in df.columns else F.lit("")
    whole = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    found = df.groupBy(by.alias("y")).agg(F.count(F.lit(1)).alias("n"), total(*whole).alias("one"), total(F.lit(1), *whole).alias("two"))
    return {r.y: [r.n, r.one, r.two] for r in found.collect()}  # a row for each year


def manifest(tables: dict[str, DataFrame]) -> dict:
    """Rows, years, columns and digests by year of tables."""
    out = {}
    for name, df in tables.items():
        has_year = "year" in df.columns
        r = df.agg(F.count(F.lit(1)).alias("n"), *([F.min("year").alias("a"), F.max("year").alias("b")] if has_year else [])).first()
        out[name] = {"rows": r.n, "columns": df.dtypes, "digests": digests(df)} | ({"from_year": r.a, "to_year": r.b} if has_year else {})
    return out


def export_package(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Writes tables and their manifest under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    found = manifest({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return found


def validate_package(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a package: tables that are missing, or differ from the manifest in columns or in any value (years are named)."""
    found = json.loads(spark.read.text(f"{path}/manifest").first().value)
    wrong = [f"{name} is missing" for name in required if name not in found]
    for name, said in found.items():
        try:
            df = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001
            wrong.append(f"{name} cannot be read: {type(e).__name__}")
            continue
        if [list(x) for x in df.dtypes] != [list(x) for x in said["columns"]]:
            wrong.append(f"{name} has other columns")
        elif df.count() != said["rows"]:
            wrong.append(f"{name} has other rows")
        elif (now := digests(df)) != (then := said.get("digests", now)):
            years = sorted(y for y in {*now, *then} if now.get(y) != then.get(y))
            wrong.append(f"{name} has other values" + (f" in {', '.join(years)}" if years != [""] else ""))
    return wrong


def lacking(spark: SparkSession, path: str) -> list[str]:
    """Tables that a package must have and has not, and columns that these lack: its structure, whatever its manifest says."""
    out = []
    for name, columns in REQUIRED.items():
        if not exists(spark, f"{path}/{name}"):
            out.append(f"{name} is missing")
        else:
            out += [f"{name} has no {c}" for c in columns if c not in spark.read.parquet(f"{path}/{name}").columns]
    return out


def families_in(spark: SparkSession, path: str) -> set[str]:
    """Fact families that a store or a package has rows of."""
    return {n for n in FAMILIES if exists(spark, f"{path}/{n}") and not spark.read.parquet(f"{path}/{n}").isEmpty()}


def import_package(spark: SparkSession, package: str, store: str, mode: str | None = None, whole: bool = False) -> str:
    """Takes a package into a store and says how; without a ``mode`` it chooses one by what both have.

    ``replace`` puts the package's tables in place of all of the store's.  ``merge`` adds families that the
    store has no rows of, with the package's other tables merged into the store's by row, and is refused where
    both have rows of a family.  A package that differs from its manifest, or has no rows, is refused; with ``whole``
    one that lacks any table or column that a package must have, too.

    All tables are written beside the store's before any of these goes, so that a write that fails leaves the store
    as it was; then they are renamed.
    """
    wrong = validate_package(spark, package) + (lacking(spark, package) if whole else [])
    there, here = families_in(spark, package), families_in(spark, store)
    if wrong or not there:
        raise ValueError(f"the package cannot be imported: {wrong or 'it has no rows'}")
    mode = mode or default_mode(here, there)
    if mode == "refuse" or mode == "merge" and here & there:
        raise ValueError(f"both sides have {sorted(here & there)}")
    names = json.loads(spark.read.text(f"{package}/manifest").first().value)
    beside, taken = f"{store}/_new-{uuid.uuid4().hex}", []
    try:
        for name in names:
            new = spark.read.parquet(f"{package}/{name}")
            if mode == "merge" and name in FAMILIES and name not in there:
                continue
            if mode == "merge" and name not in FAMILIES and exists(spark, f"{store}/{name}"):
                new = spark.read.parquet(f"{store}/{name}").unionByName(new, allowMissingColumns=True).distinct()
            writer = new.write.mode("overwrite")
            (writer.partitionBy("year") if name in FAMILIES else writer).parquet(f"{beside}/{name}")
            taken.append(name)
        for name in {*taken, *(REQUIRED if mode == "replace" else ())}:
            swap(spark, f"{beside}/{name}" if name in taken else None, f"{store}/{name}")
    finally:
        delete_all(spark, [beside])
    return mode


def swap(spark: SparkSession, new: str | None, path: str) -> None:
    """Puts a folder in the place of another by renaming; what was there goes last.  Without a new one the place is empty after it."""
    old = f"{path}-old-{uuid.uuid4().hex}"
    place, system = _folder(spark, path)
    system.mkdirs(place.getParent())
    if system.exists(place) and not system.rename(place, _folder(spark, old)[0]):
        raise OSError(f"{path} cannot be renamed")
    if new is not None and not system.rename(_folder(spark, new)[0], place):
        system.rename(_folder(spark, old)[0], place)  # as it was
        raise OSError(f"{new} cannot be renamed")
    delete_all(spark, [old])


def default_mode(here: set[str], there: set[str]) -> str:
    """How a package is taken in: ``replace`` if nothing is here, ``merge`` if both sides have no family in common, else ``refuse``."""
    if not here:
        return "replace"
    return "refuse" if here & there else "merge"


def merge(here: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by natural keys; those of ``there`` win."""
    return upsert(here, there, keys)


# ---- buckets within years
def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_versions(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    """The version of each year's buckets, by the last manifest."""
    place, system = _folder(spark, f"{path}/manifests")
    names = sorted(x.getPath().getName() for x in system.listStatus(place) if x.getPath().getName().endswith(".json")) if system.exists(place) else []
    return {(r.year, r.bucket): r.version for r in spark.read.schema("year int, bucket int, version string").json(f"{path}/manifests/{names[-1]}").collect()} if names else {}


def read_buckets(spark: SparkSession, path: str, years: tuple[int, ...] | None = None, only: set[tuple[int, int]] | None = None) -> DataFrame | None:
    """The rows of one version of a table with buckets: readers of a manifest see all of its write or nothing.  ``years`` limits the folders that are read; None if there are none."""
    folders = [f"{path}/data/{v}/_y={y}/_b={b}" for (y, b), v in sorted(bucket_versions(spark, path).items()) if (years is None or y in years) and (only is None or (y, b) in only)]
    return spark.read.parquet(*folders) if folders else None


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = ("year", "sequence"), buckets: int = 64, ordinal: str | None = None) -> list[tuple[int, int]]:
    """Puts rows in place of stored ones with the same keys, and says which (year, bucket) it has written.

    A key's bucket within its year follows from the key.  Only buckets that the rows touch are read and written, to
    a folder of their own; a manifest, put in place by renaming, then names the folder of each bucket.  A write that is
    killed before leaves the table as it was.  The number of buckets is that of the table: it stays the same.
    """
    dealt = lambda df: df.withColumns({"_y": F.col("year"), "_b": bucket_of(keys, buckets)}).repartition("_y", "_b")
    place = ["_y", "_b", *keys]  # rows that are dealt by bucket are grouped by key there, without another shuffle
    known, version = bucket_versions(spark, path), f"v-{uuid.uuid4().hex}"
    target, beside = f"{path}/data/{version}", f"{path}/_new-{uuid.uuid4().hex}"
    order = [F.desc(ordinal)] if ordinal else [F.desc_nulls_last(c) for c in new.columns if c not in keys]
    store = lambda df: df.write.partitionBy("_y", "_b").parquet(target)
    if not known:
        added = last_wins(dealt(new), place, order)
        store(added.drop(ordinal) if ordinal else added)
        touched = _folders(spark, target)
        if not touched:
            delete_all(spark, [target])
            return []
    else:
        try:
            last_wins(dealt(new), place, order).write.parquet(beside)  # no key is twice any more
            added = spark.read.parquet(beside)
            added = added.drop(ordinal) if ordinal else added
            touched = sorted((r["_y"], r["_b"]) for r in added.select("_y", "_b").distinct().collect())  # of years x buckets at most
            if not touched:
                return []
            old = read_buckets(spark, path, only=set(touched))
            if old is None:
                store(added.repartition("_y", "_b"))
            else:
                added = added.repartition("_y", "_b")
                store(dealt(old.select(*[c for c in new.columns if c != ordinal])).join(added.select(*place), place, "left_anti").unionByName(added))  # at most two files a bucket
        finally:
            delete_all(spark, [beside])
    publish(spark, path, known | dict.fromkeys(touched, version))
    return touched


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Years and buckets that a version has folders of."""
    place, system = _folder(spark, path)
    of = lambda folder, key: [(x.getPath(), int(x.getPath().getName()[len(key) :])) for x in system.listStatus(folder) if x.getPath().getName().startswith(key)]
    return sorted((y, b) for year, y in of(place, "_y=") for _, b in of(year, "_b="))


def publish(spark: SparkSession, path: str, versions: dict[tuple[int, int], str]) -> None:
    """Writes a manifest and gives it the next number by renaming, which fails if another writer has taken it."""
    beside = f"{path}/manifests/_new-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(y, b, v) for (y, b), v in versions.items()], "year int, bucket int, version string")
    rows.coalesce(1).write.json(beside)
    place, system = _folder(spark, f"{path}/manifests")
    number = 1 + max((int(x.getPath().getName()[:9]) for x in system.listStatus(place) if x.getPath().getName().endswith(".json")), default=0)
    made, _ = _folder(spark, beside)
    part = next(x.getPath() for x in system.listStatus(made) if x.getPath().getName().startswith("part-"))
    target, _ = _folder(spark, f"{path}/manifests/{number:09d}.json")
    if system.exists(target) or not system.rename(part, target):
        raise OSError("another writer was first")
    system.delete(made, True)


def vacuum_buckets(spark: SparkSession, path: str) -> int:
    """Deletes folders of buckets that the last manifest does not name, and older manifests; says how many folders.  For times without readers of old versions."""
    live = {f"{v}/_y={y}/_b={b}" for (y, b), v in bucket_versions(spark, path).items()}
    place, system = _folder(spark, f"{path}/data")
    gone = 0
    for version in system.listStatus(place):
        for year in system.listStatus(version.getPath()):
            for bucket in system.listStatus(year.getPath()) if year.isDirectory() else ():
                if "/".join((version.getPath().getName(), year.getPath().getName(), bucket.getPath().getName())) not in live:
                    gone += bool(system.delete(bucket.getPath(), True))
    manifests, _ = _folder(spark, f"{path}/manifests")
    for x in sorted(system.listStatus(manifests), key=lambda x: x.getPath().getName())[:-1]:
        system.delete(x.getPath(), True)
    return gone
