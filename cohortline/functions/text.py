"""Column functions that clean source values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Damaged spellings and what they stand for.
MOJIBAKE = {
    "MontrÃ©al": "Montréal", "QuÃ©bec": "Québec", "LÃ©vis": "Lévis", "GaspÃ©": "Gaspé", "ChaudiÃ¨re": "Chaudière", "MontÃ©rÃ©gie": "Montérégie",
    "TÃ©miscamingue": "Témiscamingue", "Ã®les": "Îles", "RÃ‰GULIER": "RÉGULIER", "Ã‰": "É", "Ã¨": "è", "Ã©": "é", "Ã ": "à", "Ã´": "ô",
}
PLACE_MOJIBAKE = {
    "MontrÃ©al": "Montréal", "QuÃ©bec": "Québec", "LÃ©vis": "Lévis", "Saint-JÃ©rÃ´me": "Saint-Jérôme", "TrÃ¨s-Saint-RÃ©dempteur": "Très-Saint-Rédempteur", "RiviÃ¨re": "Rivière",
    "Ã®les": "Îles", "Ã‰": "É", "Ã¨": "è", "Ã©": "é", "Ã ": "à", "Ã´": "ô", "Ã¢": "â", "Ã®": "î",
}
SCRIPT_MOJIBAKE = {
    "È": "é", "Ë": "è", "AnnÈe": "Année", "vÈhicule": "véhicule", "ModËle": "Modèle", "MunicipalitÈ": "Municipalité", "RÈgion": "Région",
    "Ã©": "é", "Ã¨": "è", "Ã": "à", "Ã´": "ô", "Ã®": "î", "Ã»": "û", "Ã§": "ç", "Ã«": "ë",
}
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Spaces around the code of a region go to one before it.
_SPACING = r"\s*\(\s*([^)]*?)\s*\)\s*$"


def signs_of(spellings: dict[str, str] = MOJIBAKE) -> list[str]:
    """Characters of which every damaged spelling has one."""
    return sorted({next(x for x in "ÃÈË" if x in key) for key in spellings}, reverse=True)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def repair_mojibake(c: Column, spellings: dict[str, str] = MOJIBAKE) -> Column:
    """Undoes double encoding; the longest spelling goes first, so that the result does not depend on an order of equals.

    Vehicle files, places (``PLACE_MOJIBAKE``) and files of the later layout (``SCRIPT_MOJIBAKE``) have each their own spellings.
    """
    pairs = sorted(spellings.items(), key=lambda x: (-len(x[0]), x[0]))
    fixed = reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, c)
    signs = signs_of(spellings)
    damaged = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in signs])
    return F.when(damaged, fixed).otherwise(c)


def name_of(c: Column) -> Column:
    """The name before the first bracket of ``Name (code)``; null unless name and code are both there."""
    name, code = (F.trim(F.regexp_extract(c, r"^([^(]*)\(([^)]*)\)", k)) for k in (1, 2))
    return F.when((name != "") & (code != ""), name)


def code_of(c: Column) -> Column:
    """The code in the first brackets of ``Name (code)``; null unless name and code are both there."""
    return blank_to_null(F.regexp_extract(c, r"^ *[^( ][^(]*\(([^)]*)\)", 1))


def last_name_of(c: Column) -> Column:
    """As ``name_of`` with the last brackets, and empty parts allowed: the form of the licence files."""
    return F.when(c.rlike(r"\(.*\)"), F.trim(F.regexp_extract(c, r"^(.*)\(([^()]*)\)[^)]*$", 1)))


def last_code_of(c: Column) -> Column:
    return F.when(c.rlike(r"\(.*\)"), F.trim(F.regexp_extract(c, r"^(.*)\(([^()]*)\)[^)]*$", 2)))


def trailing_code(c: Column) -> Column:
    """The code in brackets at the end of a display name, or null."""
    return blank_to_null(F.regexp_extract(c, r"\(([^)]+)\)\s*$", 1))


def space_region(c: Column) -> Column:
    """``Name(06)`` and ``Name  ( 06 )`` become ``Name (06)``."""
    return F.regexp_replace(c, _SPACING, " ($1)")


def strip_accents(c: Column) -> Column:
    plain = F.translate(c, ACCENTED, PLAIN)
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")), plain)


def normal_name(c: Column) -> Column:
    """A place name for comparison: no accents, lower case, hyphens and runs of spaces as one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[-–'’\s]+", " "))


def to_int(c: Column) -> Column:
    return blank_to_null(c).try_cast("int")  # a cast that fails costs an exception


def to_double(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def rounded(c: Column) -> Column:
    """Rounded half away from zero, as an int."""
    return F.round(c).cast("int")


def yes(c: Column) -> Column:
    return F.coalesce(c == "OUI", F.lit(False))


def year_in_name(path: Column) -> Column:
    """The first run of exactly four digits in a file name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def strip_model_badge(c: Column) -> Column:
    return F.substring_index(c, " (", 1)


def strip_make_badge(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, " → ", 1), " [", 1)


def rating(seconds: Column, limits: tuple[float, ...] = (1, 5, 10, 25)) -> Column:
    """How good a time is: excellent, good, acceptable, slow or very slow."""
    out = F.lit("very slow")
    for limit, name in reversed(list(zip(limits, ("excellent", "good", "acceptable", "slow"), strict=True))):
        out = F.when(seconds < limit, name).otherwise(out)
    return out
