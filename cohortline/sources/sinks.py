"""What results are written as: series in CSV, code lists in JSON, reports in Markdown, SQL scripts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_csv(points: DataFrame, path: str, name: str | None = None) -> None:
    """``Year,Value``, or with a name ``Series,Year,Value``; a series is small, so one file."""
    columns = [F.col("year").alias("Year"), F.col("value").alias("Value")]
    out = points.orderBy("year").select(*([F.lit(name).alias("Series")] if name else []), *columns)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def all_series_csv(named: dict[str, DataFrame], path: str) -> None:
    out = None
    for name, points in named.items():
        one = points.select(F.lit(name).alias("Series"), F.col("year").alias("Year"), F.col("value").alias("Value"))
        out = one if out is None else out.union(one)
    if out is not None:
        out.orderBy("Series", "Year").coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def codes_json(dimension: DataFrame, code: str, name: str) -> str:
    """A code list (small by nature) as JSON with sorted keys."""
    return json.dumps({r[0]: r[1] for r in dimension.select(code, name).distinct().collect()}, ensure_ascii=False, indent=2, sort_keys=True)


def markdown(df: DataFrame, top: int = 1000) -> str:
    """A report's table; a report shows ``top`` rows."""
    cells = [df.columns, ["---"] * len(df.columns), *[["" if x is None else str(x).replace("|", "\\|") for x in r] for r in df.limit(top).collect()]]
    return "\n".join("| " + " | ".join(row) + " |" for row in cells)


def quote(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def correction_script(corrections: DataFrame, table: str) -> str:
    """UPDATE statements for corrections, in order."""
    rows = corrections.select("from_make", "from_model", "to_make", "to_model").orderBy("from_make", "from_model").collect()
    return "\n".join(f"UPDATE {table} SET make = {quote(c)}, model = {quote(d)} WHERE UPPER(make) = {quote(a.upper())} AND UPPER(model) = {quote(b.upper())};" for a, b, c, d in rows)
