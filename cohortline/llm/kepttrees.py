"""Token trees kept as a table of leaves: edits read the trees of edited documents alone and write the leaves they touch.

A table is a folder of versions.  Version 0 holds the leaves of all documents, each later one only those that a round
of edits has touched; the newest row of a leaf holds, and one without pre-tokens says that the leaf is gone.  A
version counts once Spark has marked it as whole, so that a round that is killed leaves the table as it was, and
the next one takes its place.  One writer at a time.

A document is known by its id and a hash of the text it began with: repeats of a row are one tree, and
different texts of one id are trees of their own, which all take the edits of that id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, cut, rows
from .tokencount import VOCABULARY, Counter, TokenTree

#: Parts that ids are dealt to: edits read the parts of their ids only.
PARTS = 256
#: Edited ids up to which the scan itself is told them; more are joined alone.
PUSHED = 1_000
LEAF_ROW = "id long, copy long, leaf int, pieces array<string>, counts array<int>, chars long, tokens long, n_pieces long, reencoded long"
_ARROW = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("leaf", pa.int32()), ("pieces", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("chars", pa.int64()), ("tokens", pa.int64()), ("n_pieces", pa.int64()), ("reencoded", pa.int64())])


def _part(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(PARTS))


def _row(key: tuple, tree: TokenTree, k: int, reencoded: int) -> tuple:
    if k >= len(tree.leaves):
        return (*key, k, None, None, 0, 0, 0, reencoded)
    return (*key, k, tree.leaves[k], tree.counts[k], sum(map(len, tree.leaves[k])), sum(tree.counts[k]), len(tree.leaves[k]), reencoded)


def _batches(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in found:
        held.append(r)
        if len(held) == SLICE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _write(leaves: DataFrame, place: str, version: int) -> None:
    leaves.withColumn("part", _part(F.col("id"))).hint("rebalance", "part").sortWithinPartitions("part", "id", "copy", "leaf").write.mode("overwrite").partitionBy("part").parquet(f"{place}/version={version}")


def versions(spark: SparkSession, place: str) -> list[int]:
    """The versions of a table that are whole, in order; none where there is no table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("version=")]
    whole = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in whole)


def leaves(spark: SparkSession, place: str) -> DataFrame:
    """All rows of all whole versions, older ones of a leaf too."""
    known = versions(spark, place)
    if not known:
        raise ValueError(f"no trees are kept in {place}")
    return spark.read.schema(f"{LEAF_ROW}, version int, part int").option("basePath", place).parquet(*[f"{place}/version={n}" for n in known])


def newest(spark: SparkSession, place: str, *columns: str) -> DataFrame:
    """The newest row of each leaf, with ``columns`` of it; leaves that are gone are there too, with zeros and nulls."""
    found = leaves(spark, place).groupBy("id", "copy", "leaf").agg(F.max_by(F.struct(*columns), "version").alias("x"))
    return found.select("id", "copy", "leaf", "x.*")


def keep(docs: DataFrame, place: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row of ``docs`` once and keeps its tree in the new table ``place``.

    Null and empty texts have a tree of one empty leaf; a null id is an id like any other; repeats of a row are one tree; an empty
    table makes an empty table; no other column is looked at.  A folder that holds a table is refused.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(VOCABULARY)
    if versions(spark, place):
        raise ValueError(f"trees are kept in {place} already")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        trees = ((key, TokenTree(text, counter)) for b in rows(batches) for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_row(key, tree, k, 0) for key, tree in trees for k in range(len(tree.leaves)))

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _write(picked.select("id", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, LEAF_ROW), place, 0)


def apply_edits(edits: DataFrame, place: str, path: str | None = None, id_col: str = "doc_id") -> int:
    """Makes the edits ``id_col, seq, start, stop, new`` in the kept trees and returns the number of the version written.

    The edits of a document are made in the order of ``seq`` (ties: the last place first, then by ``new``), each in characters of the
    text as it is then.  Only the parts of edited ids are scanned, only trees of edited ids leave the scan, and only touched leaves
    are written.  A tree is in one task, as its text was; its edits pass by one after another and are not held.  Places
    outside of a text are moved to its nearest end; a null ``start`` is the text's start, a null ``stop`` its end, a null ``new`` is
    empty; a null id is the null id; ids that no tree has are passed over; no edits make a version without rows.
    """
    spark, path = edits.sparkSession, path or public_tokenizers.path(VOCABULARY)
    wanted = edits.select(F.col(id_col).cast("long").alias("id"), F.col("seq").cast("long").alias("at"), F.col("start").cast("long"), F.col("stop").cast("long"), F.col("new").cast("string"))
    wanted = cut(wanted)
    ids = cut(wanted.select("id").distinct())
    parts = [r[0] for r in ids.select(_part(F.col("id"))).distinct().collect()]  # at most PARTS
    old = leaves(spark, place).where(F.col("part").isin(parts))
    if ids.count() <= PUSHED:
        few = [r.id for r in ids.collect()]
        old = old.where(F.col("id").isin([x for x in few if x is not None]) | (F.col("id").isNull() if None in few else F.lit(False)))
    old = old.select("id", "copy", "leaf", "pieces", "counts", "version").join(ids.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    trees = old.select("id", "copy").distinct().withColumnRenamed("id", "_id")
    todo = wanted.join(trees, F.col("id").eqNullSafe(F.col("_id"))).select("id", "copy", F.lit(1).alias("kind"), "at", F.lit(0).alias("version"), "start", "stop", "new", F.lit(None).cast("array<string>").alias("pieces"), F.lit(None).cast("array<int>").alias("counts"))
    known = old.select("id", "copy", F.lit(0).alias("kind"), F.col("leaf").cast("long").alias("at"), "version", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("new"), "pieces", "counts")
    order = ["id", "copy", "kind", "at", "version", F.col("start").desc(), F.col("stop").desc(), "new"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)

        def touched(key: tuple, tree: TokenTree, was: int) -> Iterator[tuple]:
            changed = sorted(tree.touched | set(range(len(tree.leaves), was)))
            yield from (_row(key, tree, k, 0 if i else tree.encoded) for i, k in enumerate(changed))

        def found() -> Iterator[tuple]:
            key, tree, was, held = None, None, 0, {}
            for b in rows(batches, "pieces"):
                for i, copy, kind, at, _, start, stop, new, pieces, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (i, copy) != key:
                        if tree is not None:
                            yield from touched(key, tree, was)
                        key, tree, held = (i, copy), None, {}
                    if not kind:
                        held[at] = (pieces, counts)  # versions of a leaf come one after another: the last one holds
                        continue
                    if tree is None:
                        whole = [held[k] for k in sorted(held) if held[k][0] is not None]
                        tree, was, held = TokenTree.kept([x for x, _ in whole], [x for _, x in whole], counter), len(whole), {}
                    size = tree.chars[1]
                    a = min(max(start or 0, 0), size)
                    tree.edit(a, min(max(size if stop is None else stop, a), size), new or "")
                    was = max(was, len(tree.leaves))
            if tree is not None:
                yield from touched(key, tree, was)

        yield from _batches(found())

    version = versions(spark, place)[-1] + 1
    _write(known.union(todo).repartition("id", "copy").sortWithinPartitions(*order).mapInArrow(run, LEAF_ROW), place, version)
    return version


def totals(spark: SparkSession, place: str) -> DataFrame:
    """``id, copy, n_tokens, n_pieces, n_chars`` of every kept tree, from the sums of its leaves: no text is read."""
    found = newest(spark, place, "tokens", "n_pieces", "chars")
    return found.groupBy("id", "copy").agg(F.sum("tokens").alias("n_tokens"), F.sum("n_pieces").alias("n_pieces"), F.sum("chars").alias("n_chars"))


def compact(spark: SparkSession, place: str, to: str) -> None:
    """Writes the newest leaves as version 0 of a new table, without encoding anything."""
    if versions(spark, to):
        raise ValueError(f"trees are kept in {to} already")
    found = newest(spark, place, "pieces", "counts", "chars", "tokens", "n_pieces").where(F.col("pieces").isNotNull())
    _write(found.select("id", "copy", "leaf", "pieces", "counts", "chars", "tokens", "n_pieces", F.lit(0).cast("long").alias("reencoded")), place=to, version=0)
