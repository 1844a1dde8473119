"""Yearly files taken in as they arrive: a file stream that handles what is new and stops, or goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import year_in_name


def arrivals(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv", files_per_batch: int = 10) -> DataFrame:
    """New CSV files of a folder as a stream, with the year that is in their names."""
    rows = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.withColumn("year", year_in_name(F.input_file_name()))


def store_arrivals(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet by year; after a failure it goes on from its checkpoint, each file once."""
    writer = stream.writeStream.format("parquet").partitionBy("year").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_arrivals(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Puts each batch in place of stored rows with the same keys, in the years that the batch has."""
    from ..sources.store import last_wins, upsert, write_years

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        years = [r.year for r in batch.select("year").distinct().collect()]
        if not years:
            return
        try:
            old = spark.read.parquet(path).where(F.col("year").isin(*years)).select(*batch.columns)
            new = upsert(old, batch, keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = last_wins(batch, keys, [F.desc_nulls_last(c) for c in batch.columns if c not in keys])
        stage = f"{checkpoint}/stage/{number}"
        new.write.mode("overwrite").parquet(stage)  # what is read may not be written over
        write_years(spark.read.parquet(stage), path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, time: str, delay: str, window: str, *keys: str) -> DataFrame:
    """Rows by window of event time and keys; windows close when no earlier row can come any more."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
