"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, rows, texts

BITS = 64
#: Hashes whose bits are counted at once, for texts of any length.
CHUNK = 1 << 16
#: Fingerprints of one block value that one task compares with each other.
BUCKET = 8192
#: Ids that are broadcast at most.
MOST_IDS = 500_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit number.

    A-Z are lowered, words are runs of bytes other than ASCII white space, shingles are ``width``
    words joined by a space, repeats included; a text with fewer words has its whole sequence as its
    only shingle and a text without words has fingerprint 0.  A bit is set where more than half of
    the shingles' XXH64 values have it set.
    """
    words = text.lower().split()  # bytes: lowers A-Z only, splits at 20 09 0A 0B 0C 0D only
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    pairs = (zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True) for k in range(0, len(starts), CHUNK))
    return majority(np.array([digest(line[a:b], seed) for a, b in part], "<u8") for part in pairs)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The number whose bits are set in more than half of the hashes."""
    n, set_bits = 0, np.zeros(BITS, np.int64)
    for h in parts:
        n += len(h)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)`` for every row: a signed long holding the fingerprint's 64 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            fp = np.array([fingerprint(t, width, seed) for t in texts(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def block_keys(fp: Column, distance: int, spare: int = 3) -> Column:
    """Keys such that fingerprints within ``distance`` bits share one at least.

    The bits are split in ``distance + spare`` blocks.  ``distance`` differing bits touch at most
    ``distance`` blocks, so ``spare`` whole blocks agree: there is a key for each choice of ``spare``
    blocks, the hash of the choice and of those blocks' bits.
    """
    n = distance + spare
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    masks = [sum(c) for c in combinations(blocks, spare)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values within ``distance`` bits.

    A breadth-first search that compares each value once with those not reached so far: at most
    ``len(fps) - 1`` edges come out, however dense the graph is.
    """
    left, out = fps, []
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            x = edge.pop()
            close = np.bitwise_count(left ^ x) <= distance
            if close.any():
                found = left[close]
                out += [(int(x), int(y)) for y in found]
                edge.extend(found)
                left = left[~close]
    return out


def bucket_edges(batches: Iterable[pa.RecordBatch], distance: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """From rows ``(key, fp)`` sorted by key: forests of each key's fingerprints as ``(key, a, b)``.

    A key with more than ``limit`` rows is given back as one row with null ``a`` and ``b`` instead, for
    the caller to split; never more than ``limit`` rows and one batch are held.
    """
    out: list[tuple] = []

    def close(key: int | None, fps: np.ndarray) -> None:
        if limit is not None and len(fps) > limit:
            out.append((key, None, None))
        elif len(fps) > 1:
            out.extend((key, a, b) for a, b in forest(np.unique(fps).view(np.uint64), distance))

    held_key, held = None, np.empty(0, np.int64)
    wrap = lambda x: None if x is None else x - (1 << 64) if x >> 63 else x
    for b in batches:
        if not b.num_rows:
            continue
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        if held_key is not None and key[0] == held_key:
            held = np.concatenate((held, fp[: ends[0]]))
            held = held if limit is None else held[: limit + 1]
            starts, ends = starts[1:], ends[1:]
        if len(starts):
            close(held_key, held)
            for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
                close(int(key[starts[i]]), fp[starts[i] : ends[i]])
            held_key, held = int(key[starts[-1]]), fp[starts[-1] : ends[-1]]
        if out:
            yield _edges(out, wrap)
            out.clear()
    close(held_key, held)
    if out:
        yield _edges(out, wrap)


def _edges(out: list[tuple], wrap) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), *(pa.array([wrap(r[i]) for r in out], pa.int64()) for i in (1, 2))], names=["key", "a", "b"])


def links(fps: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose components are those of all close pairs.

    ``fps`` has one long column ``fp`` of distinct values.
    """
    return close_pairs(fps.select(F.explode(block_keys(F.col("fp"), distance)).alias("key"), "fp"), distance, bucket)


def close_pairs(keyed: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``distance`` bits among the rows ``(key, fp)`` of a key.

    Rows are dealt by key, and each key's rows become a spanning forest, never all pairs.  A key with
    more than ``bucket`` values is split by hash in parts of half that size, and each two parts are
    compared in a task of their own, so that memory stays bounded and no pair is missed.
    """

    def run(limit: int | None):
        return lambda batches: bucket_edges(batches, distance, limit)

    schema = "key long, a long, b long"
    first = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run(bucket), schema))
    edges, crowded = first.where("a is not null").select("a", "b"), first.where("a is null").select("key")
    if crowded.isEmpty():
        return edges
    sizes = keyed.join(crowded, "key", "left_semi").groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / bucket).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    dealt = keyed.join(sizes.repartition("parts", F.hash("key")), "key").withColumn("part", part).select(F.explode(pairs).alias("key"), "fp")
    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run(None), schema)
    return edges.union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in ``distance`` bits or fewer are linked, and
    ``component_id`` is the smallest id reachable over links, the own one included.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows all come back
    with the same values; rows with a null id come back with a null id and the component of their
    fingerprint (null only if no row of the component has an id); an empty table gives no rows; other
    columns of ``docs`` are not looked at.
    """
    marked = cut(fingerprints(docs, width, seed, id_col, text_col))
    first = marked.groupBy("fp").agg(F.min(id_col).alias("low"))
    found = components(links(first.select("fp"), distance))
    joined = first.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = cut(joined, first.count())
    ids = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    label = joined.join(ids.repartition("component_id", F.hash("component")), "component").select("fp", "component_id")
    return marked.join(label.repartition("component_id", F.hash("fp")), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component (``near_duplicates``) has a smaller id; columns stay as they are.

    The ids to drop are broadcast if they are few and joined by a shuffle if not.  Of rows that share an
    id one stays; rows with a null id all stay.
    """
    found = cut(near_duplicates(docs, distance, width, seed, id_col, text_col))
    gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct())
    again = cut(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("again")))
    side = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    kept = docs.join(side, docs[id_col] == gone["gone"], "left_anti")  # columns by frame: docs may have any names
    if again.isEmpty():
        return kept
    same = docs[id_col] == again["again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col]))
