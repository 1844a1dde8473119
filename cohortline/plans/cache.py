"""Results kept as Parquet under a key that says what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.codes import Years


def key_of(config: Years, *more: object) -> str:
    """A key of the curated and uncurated years and whatever else a result depends on."""
    said = [sorted(config.curated), sorted(config.uncurated), config.fuel_from, *map(str, more)]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:16]


def kept(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result under ``key``, made and written if it is not there: a folder is complete once it has Spark's mark of success."""
    place = f"{path}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def forget(spark: SparkSession, path: str, key: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
