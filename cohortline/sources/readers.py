"""Readers of the source files: yearly CSV in several layouts and encodings, fixed-width places, reference tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.codes import ADMIN_REGIONS

# Columns of the source files in order.
VEHICLE_COLUMNS = ("AN", "NOSEQ_VEH", "CLAS", "TYP_VEH_CATEG_USA", "MARQ_VEH", "MODEL_VEH", "ANNEE_MOD", "MASSE_NETTE", "NB_CYL", "CYL_VEH", "NB_ESIEU_MAX", "COUL_ORIG", "TYP_CARBU", "REG_ADM", "MRC", "CG_FIXE")
LICENCE_COLUMNS = (
    "AN", "NOSEQ_TITUL", "AGE_1ER_JUIN", "SEXE", "MRC", "REG_ADM", "TYPE_PERMIS", "IND_PERMISAPPRENTI_123", "IND_PERMISAPPRENTI_5", "IND_PERMISAPPRENTI_6A6R", "IND_PERMISCONDUIRE_1234",
    "IND_PERMISCONDUIRE_5", "IND_PERMISCONDUIRE_6ABCE", "IND_PERMISCONDUIRE_6D", "IND_PERMISCONDUIRE_8", "IND_PROBATOIRE", "EXPERIENCE_1234", "EXPERIENCE_5", "EXPERIENCE_6ABCE", "EXPERIENCE_GLOBALE",
)
FUEL_FROM, FRENCH = 2017, "éèà"
PLACES = {"kind": (0, 1), "code": (1, 6), "name": (8, 66), "mrc": (244, 247), "region": (304, 306), "population": (494, 502), "lat": (624, 628), "lon": (628, 632), "land": (632, 642), "total": (642, 652)}


class SourceError(ValueError):
    """A file that is empty, has other columns than its year asks for, or no French text in any encoding."""


def vehicle_columns(year: int) -> tuple[str, ...]:
    return VEHICLE_COLUMNS if year >= FUEL_FROM else tuple(c for c in VEHICLE_COLUMNS if c != "TYP_CARBU")


def decode(head: bytes, need_french: bool) -> str:
    """The encoding of a file by its first bytes: UTF-8, else Latin-1, else Windows-1252; vehicle files must have an accent."""
    for name in ("utf-8", "iso-8859-1", "cp1252"):
        try:
            text = head.decode(name)
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.reason == "unexpected end of data":  # the head ends in a character
                text = head[: e.start].decode(name)
            else:
                continue
        if not need_french or any(c in text for c in FRENCH):
            return name
    raise SourceError("no encoding gives French text")


def delimiter(line: str) -> str:
    """``;`` or ``,``, whichever is more frequent outside quotes in a header."""
    bare = re.sub('"[^"]*"?', "", line)
    return ";" if bare.count(";") > bare.count(",") else ","


def head(spark: SparkSession, path: str, size: int = 1 << 20) -> bytes:
    """The first bytes of a source in any store that Spark reads: a file, or the files of a folder by name; compressed ones are told by their names, as Spark does."""
    conf, out = spark._jsc.hadoopConfiguration(), b""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, codecs = p.getFileSystem(conf), spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    parts = [s.getPath() for s in system.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"] if is_folder(spark, path) else [p]
    for part in sorted(parts, key=lambda x: x.getName()):
        codec, stream = codecs.getCodec(part), system.open(part)
        stream = codec.createInputStream(stream) if codec else stream
        try:
            out += bytes(stream.readNBytes(size - len(out)))
        finally:
            stream.close()
        if len(out) >= size:
            break
    return out


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a source is a folder of parts in place of a file; an error if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: What Windows-1252 has in place of the control characters of Latin-1.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def read_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines of text files and the file that each is from.  Windows-1252 is read as Latin-1, whose control characters are replaced."""
    raw = F.col("value")
    value = F.make_valid_utf8(raw) if encoding == "utf-8" else F.decode(raw.cast("binary"), "iso-8859-1")
    value = F.translate(value, _LATIN, _WINDOWS) if encoding == "cp1252" else value
    return spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"))


#: Stands for a separator within quotes while a line is split.
_MASK = "\u0001"


def fields(line: Column, sep: str) -> Column:
    """Fields of a line: a quote opens and closes, separators within quotes do not count, quotes go, outer spaces go.

    A separator counts if an even number of quotes follows it.  The work is in proportion to the line: lines of few
    quotes with no separators within are split as they are, in others the parts between quotes are masked by turns.
    """
    quote, none, mask = F.lit('"'), F.lit(""), F.lit(_MASK)
    cut = lambda c: F.split(c, re.escape(sep), -1)
    trimmed = lambda parts: F.transform(parts, lambda x: F.trim(x))
    bare = F.replace(line, quote, none)
    simple = ~F.contains(line, quote) | (F.length(line) - F.length(bare) <= 64) & line.rlike(f'^(?:[^"]*"[^"{re.escape(sep)}]*")*[^"]*$')
    spaced = F.contains(bare, F.lit(f" {sep}")) | F.contains(bare, F.lit(f"{sep} ")) | F.startswith(bare, F.lit(" ")) | F.endswith(bare, F.lit(" "))
    masked = lambda turn: F.array_join(F.transform(F.split(line, '"', -1), lambda x, i: F.when(i % 2 == turn, F.replace(x, F.lit(sep), mask)).otherwise(x)), "")
    turns = F.when((F.length(line) - F.length(bare)) % 2 == 0, masked(1)).otherwise(masked(0))
    quoted = F.transform(cut(turns), lambda x: F.trim(F.replace(x, mask, F.lit(sep))))
    even = f'{re.escape(sep)}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    with_mask = F.transform(F.split(line, even, -1), lambda x: F.trim(F.replace(x, quote, none)))  # a line that has the mask itself
    return F.when(simple & ~spaced, cut(bare)).when(simple, trimmed(cut(bare))).when(F.contains(line, mask), with_mask).otherwise(quoted)


@dataclass(frozen=True)
class Dialect:
    """How a file is written: its encoding, separator and header line, and the names in it."""

    encoding: str
    sep: str
    header: str
    names: tuple[str, ...]


def dialect(spark: SparkSession, path: str, columns: tuple[str, ...], french: bool) -> Dialect:
    """The dialect of a file by its first bytes; the header must have exactly the names of ``columns``, in any order."""
    start = head(spark, path)
    encoding = decode(start, french)
    lines = [x for x in start.decode(encoding, "replace").splitlines() if x.strip()]
    if len(lines) < 2:
        raise SourceError("the file has no rows")
    sep = delimiter(lines[0])
    names = tuple(x.strip().strip('"').lstrip("\ufeff") for x in lines[0].split(sep))
    if sorted(names) != sorted(columns):
        raise SourceError(f"the header has {len(names)} columns, or other names than the {len(columns)} of this year")
    return Dialect(encoding, sep, lines[0].lstrip("\ufeff"), names)


def read_dialect(spark: SparkSession, path: str | list[str], how: Dialect, repaired: bool = False) -> tuple[DataFrame, Column]:
    """Rows of files of a dialect under its names, with ``f`` (their fields), ``file`` and ``line``, and the condition that a line has the right number of fields.

    Blank lines go, and headers.  ``repaired`` undoes double encoding in the fields of lines that may have it, which
    is one expression, not one for each column: too much code in a stage is not compiled.
    """
    bare = F.replace(F.col("value"), F.lit("\ufeff"), F.lit(""))
    text = read_lines(spark, path, how.encoding).where(F.length(F.trim("value")) > 0).where(bare != how.header)
    split = text.select(fields(F.col("value"), how.sep).alias("f"), "file", F.col("value").alias("line"))
    if repaired:
        damaged = reduce(lambda a, b: a | b, [F.contains("line", F.lit(x)) for x in tx.signs_of()])
        split = split.withColumn("f", F.when(damaged, F.transform("f", lambda x: tx.repair_mojibake(x))).otherwise(F.col("f")))
    return split.select("f", "file", "line", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(how.names)]), F.size("f") == len(how.names)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], french: bool) -> tuple[DataFrame, Column]:
    """Rows of a file under its header's names, and the condition that a line has the right number of fields."""
    return read_dialect(spark, path, dialect(spark, path, columns, french), repaired=french)


def counted(rows: DataFrame, good: Column, seen: Observation | None) -> DataFrame:
    """The good lines; ``seen`` counts the ``bad`` ones while they are read."""
    if seen is not None:
        rows = rows.observe(seen, F.count_if(~good).alias("bad"))
    return rows.where(good)


def vehicle_facts(year: Column, fuels: bool) -> list[Column]:
    """The columns of registrations from those of a yearly file whose double encoding is undone."""
    blank = lambda c: tx.blank_to_null(F.col(c))
    mass, size = tx.to_double(F.col("MASSE_NETTE")), tx.to_double(F.col("CYL_VEH"))
    return [
        year.alias("year"), F.coalesce(blank("NOSEQ_VEH"), F.concat(year.cast("string"), F.lit("_UNKNOWN"))).alias("sequence"), blank("CLAS").alias("vehicle_class"), blank("TYP_VEH_CATEG_USA").alias("vehicle_type"),
        blank("MARQ_VEH").alias("make"), blank("MODEL_VEH").alias("model"), tx.to_int(F.col("ANNEE_MOD")).alias("model_year"), mass.alias("net_mass"), tx.rounded(mass).alias("net_mass_int"),
        size.alias("displacement"), tx.rounded(size).alias("displacement_int"), tx.to_int(F.col("NB_CYL")).alias("cylinder_count"), tx.to_int(F.col("NB_ESIEU_MAX")).alias("max_axles"), blank("COUL_ORIG").alias("color"),
        (blank("TYP_CARBU") if fuels else F.lit(None).cast("string")).alias("fuel_type"), tx.code_of(F.col("REG_ADM")).alias("admin_region"), tx.code_of(F.col("MRC")).alias("mrc"), blank("CG_FIXE").alias("municipality"),
    ]


def vehicles(spark: SparkSession, path: str, year: int, seen: Observation | None = None) -> DataFrame:
    """Registrations of a yearly file; lines with another number of fields go."""
    rows, good = read_csv(spark, path, vehicle_columns(year), french=True)
    return counted(rows, good, seen).select(*vehicle_facts(F.lit(year), year >= FUEL_FROM))


def licence_facts(year: Column) -> list[Column]:
    """The columns of licences from those of a yearly file."""
    blank = lambda c: tx.blank_to_null(F.col(c))
    flags = ("learner_123", "learner_5", "learner_6a6r", "driver_1234", "driver_5", "driver_6abce", "driver_6d", "driver_8", "probationary")
    years = ("exp_1234", "exp_5", "exp_6abce", "exp_global")
    return [
        year.alias("year"), F.coalesce(blank("NOSEQ_TITUL"), F.concat(year.cast("string"), F.lit("_UNKNOWN"))).alias("sequence"), blank("AGE_1ER_JUIN").alias("age_group"), blank("SEXE").alias("gender"), blank("TYPE_PERMIS").alias("licence_type"),
        tx.blank_to_null(tx.last_code_of(F.col("REG_ADM"))).alias("admin_region"), tx.blank_to_null(tx.last_code_of(F.col("MRC"))).alias("mrc"),
        *[tx.yes(F.col(c)).alias(n) for c, n in zip(LICENCE_COLUMNS[7:16], flags, strict=True)], *[blank(c).alias(n) for c, n in zip(LICENCE_COLUMNS[16:], years, strict=True)],
    ]


def licences(spark: SparkSession, path: str, year: int, seen: Observation | None = None) -> DataFrame:
    """Licences of a yearly file."""
    rows, good = read_csv(spark, path, LICENCE_COLUMNS, french=False)
    return counted(rows, good, seen).select(*licence_facts(F.lit(year)))


def dropped_lines(spark: SparkSession, path: str, columns: tuple[str, ...], french: bool) -> int:
    """Lines that have another number of fields than the header."""
    rows, good = read_csv(spark, path, columns, french)
    return rows.where(~good).count()


def places(spark: SparkSession, path: str) -> DataFrame:
    """Municipalities of a fixed-width Latin-1 file: codes, position in degrees, areas in square kilometres."""
    line = read_lines(spark, path, "iso-8859-1").select(F.col("value").alias("l")).where((F.length("l") >= 900) & F.substring("l", 1, 1).rlike("^[1-9A-H]$"))
    cut = lambda name: F.trim(F.substring("l", PLACES[name][0] + 1, PLACES[name][1] - PLACES[name][0]))
    degrees = lambda name: F.substring(cut(name), 1, 2).try_cast("double") + F.substring(cut(name), 3, 2).try_cast("double") / 60
    area = lambda name: cut(name).try_cast("double") / 1000
    return line.select(cut("code").alias("code"), tx.repair_mojibake(cut("name"), tx.PLACE_MOJIBAKE).alias("name"), F.lit("municipality").alias("type"), cut("mrc").alias("parent_code"), cut("region").alias("region_code"), cut("population").try_cast("int").alias("population"), degrees("lat").alias("latitude"), (-degrees("lon")).alias("longitude"), area("total").alias("area_total"), area("land").alias("area_land"))


def numbered(rows: DataFrame, by: str, order: Column | list[Column], place: str) -> DataFrame:
    """Rows with ``_n``, their number from 1 within each value of ``by`` in the order given, by no task alone.

    Rows are sorted over all tasks and written to ``place``, so that parts stay as they are; a row's number is
    its place in its part after the rows of its group in the parts before, of which there is a row each.
    """
    spark = rows.sparkSession
    keys = [by, *(order if isinstance(order, list) else [order])]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(place)
    parts = spark.read.parquet(place)
    sizes = parts.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_first", "_before")
    joined = parts.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_n", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_by", "_p", "_first", "_before", "_part", "_at")


def normalise(rows: DataFrame, names: DataFrame, order: Column | list[Column], place: str) -> DataFrame:
    """Rows of the later layout ``(period, make, model, model_year, region, municipality)`` in the yearly layout.

    The year is that of the period (``YYYY`` or ``YYYYMM``), the sequence ``year_`` and the row's number in ten
    digits, a region code becomes ``Name (07)``, and a municipality its code in ``names`` (name, code), compared
    without accents.  Numbers are given by ``order``, a column or several, which has no ties, within a year; ``place`` is a new folder
    for the sorted rows.
    """
    regions = F.create_map(*[F.lit(x) for pair in ADMIN_REGIONS.items() for x in pair])
    year = F.regexp_extract("period", r"^(\d{4})", 1).try_cast("int")
    number = F.when(F.col("_n") < 10**10, F.lpad(F.col("_n").cast("string"), 10, "0")).otherwise(F.col("_n").cast("string"))
    code = F.lpad(F.regexp_extract("region", r"(\d{1,2})\D*$", 1), 2, "0")
    known = names.select(tx.normal_name(F.col("name")).alias("_name"), F.col("code").alias("CG_FIXE")).groupBy("_name").agg(F.min("CG_FIXE").alias("CG_FIXE"))
    joined = numbered(rows.withColumn("AN", year), "AN", order, place).withColumn("_name", tx.normal_name(F.col("municipality"))).join(known, "_name", "left")
    none = F.lit(None).cast("string")
    return joined.select(
        "AN", F.concat(F.coalesce(F.col("AN").cast("string"), F.lit("null")), F.lit("_"), number).alias("NOSEQ_VEH"), none.alias("CLAS"), none.alias("TYP_VEH_CATEG_USA"), F.col("make").alias("MARQ_VEH"), F.col("model").alias("MODEL_VEH"), F.col("model_year").alias("ANNEE_MOD"),
        *[none.alias(c) for c in ("MASSE_NETTE", "NB_CYL", "CYL_VEH", "NB_ESIEU_MAX", "COUL_ORIG", "TYP_CARBU")], F.concat(F.try_element_at(regions, code), F.lit(" ("), code, F.lit(")")).alias("REG_ADM"), none.alias("MRC"), "CG_FIXE",
    )


def corrections(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Corrections from a table in a text: ``| make | model | → | make | model | 95% |``, those of at least ``least`` percent."""
    cell = lambda k: F.trim(F.get(F.split("value", r"\|"), F.lit(k)))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|.*→.*\|\s*\d+\s*%"))
    out = rows.select(cell(1).alias("from_make"), cell(2).alias("from_model"), cell(4).alias("to_make"), cell(5).alias("to_model"), F.regexp_replace(cell(6), "[^0-9]", "").try_cast("int").alias("confidence"))
    return out.where(F.col("confidence") >= least)


def reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """An external reference table: make, model, model year and sixteen measures, without quotes."""
    measures = ("ol", "ow", "oh", "wb", "cw", "a", "b", "c", "d", "e", "f", "g", "twf", "twr")
    schema = "make string, model string, myr int, " + ", ".join(f"{m} double" for m in measures) + ", wd string"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
