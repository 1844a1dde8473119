"""What the text operators share: lineage cuts, folds, batching and graph components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python holds as objects at a time, whatever the size of the Arrow batch.
SLICE_ROWS = 512
#: ... and bytes of text, unless a single text is longer.
SLICE_BYTES = 4_000_000
#: Rows of a few numbers that one task writes to a checkpoint, and tasks at least, if there are as many partitions.
ROWS_A_FILE, LEAST_FILES = 250_000, 16


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint.

    Where it is known that there are at most ``most_rows`` rows, they are written in files of about
    ``ROWS_A_FILE``, so that few rows do not make a file for each shuffle partition.

    Its files go when nothing refers to them any more.
    """
    shared_dir(df.sparkSession)
    if most_rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-most_rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, for checkpoints and for files that an operator writes.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Only on a single machine (tests), where that
    is unset, a temporary folder is set; elsewhere that would be lost with its machine, and is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key written in decimal, modulo ``n``; a null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def rows(batches: Iterable[pa.RecordBatch], text: str = "text", most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded bytes, so that Python never holds a whole batch as objects."""
    for batch in batches:
        at, i = 0, batch.schema.get_field_index(text)
        while at < batch.num_rows:
            n = min(most_rows, batch.num_rows - at)
            while n > 1 and batch.column(i).slice(at, n).nbytes > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n
        pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``; loops and repeats are allowed.  Returns ``node`` and
    ``component`` (the smallest node reachable) for the nodes that have an edge to another node.
    Each step is two aggregations and two joins over the edges, whose number never grows; the result
    of a step is checkpointed, and steps end when the edges no longer change (O(log^2 n) steps).
    A hub is no bottleneck: minima are combined before the shuffle and AQE can split the joins,
    since both sides are exchanged for the join alone.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.distinct(), e.count())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def lowest(df: DataFrame, of: str, over: str) -> DataFrame:
        return df.groupBy(of).agg(F.min(over).alias("m")).repartition("m", F.hash(of))

    before = mark(e)
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        near = lowest(both, "x", "y").select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(near, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = lowest(large, "u", "v")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", "m")).distinct(), before[0])
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct()
    )
