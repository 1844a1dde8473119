"""SimHash near-dedup at a five-word Jaccard of 0.8: fingerprints that meet in blocks, Hamming check, exact check.

Pairs at 0.8 differ in 10 of 64 bits on average and in up to 20: fingerprints split in so many blocks have none in
common that is worth a join.  Here MinHash bands take the place of the pigeonhole blocks; what shares one is
compared by its fingerprint as in ``simhash``, and what is close by the whole sets of shingles.  Bands and fingerprints
find nearly all links, by chance; those between what they have left apart are found by a prefix filter, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, rows, texts
from .lm import hashes, mixed
from .simhash import CHUNK, MOST_IDS, close_pairs, majority

WIDTH = 5
#: A pair of similarity 0.8 shares none of the bands with probability (1 - 0.8^6)^40 = 5e-6, one of 0.3 shares some with 0.03.
BANDS, ROWS = 40, 6
#: Differing bits of fingerprints that are compared at once: a pair of 0.8 has more with a probability below 1e-4, chance pairs with 0.95.
DISTANCE = 25
#: The Jaccard of near copies in percent.
LEAST = 80
#: Shingles whose minima are taken at once.
AT_ONCE = 512
#: Texts and shingles of candidates that one task compares with each other at most, unless two parts are longer.
CROWD, MOST_SHINGLES = 1024, 4_000_000
_TIMES = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of the whole sequence for fewer words, none without words.

    A-Z are lowered, words are runs of bytes other than ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, width = hashes(words), min(width, len(words))
    n = len(h) - width + 1
    x = mixed(h[:n] + np.uint64(width))
    for k in range(1, width):
        x = mixed(x * _TIMES + h[k : k + n])
    return np.unique(x)


def band_keys(one: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of the minima of its permutations."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(one), AT_ONCE):
        np.minimum(low, (_FACTORS[:, None] * one[None, k : k + AT_ONCE]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        key = mixed(key * _TIMES + x)
    return key


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links sets (no empty ones) of a Jaccard of 0.8 or more.

    A breadth-first search: each set is compared with those that are not reached so far.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    left, out, has = np.arange(len(sets)), [], np.zeros(len(values), bool)
    while len(left):
        edge, left = [int(left[0])], left[1:]
        while edge and len(left):
            x = edge.pop()
            fit = (5 * np.minimum(sizes[left], sizes[x]) >= 4 * np.maximum(sizes[left], sizes[x])).nonzero()[0]
            if not len(fit):
                continue
            some = left[fit]
            has[ids[x]] = True
            starts = np.cumsum(sizes[some]) - sizes[some]
            both = np.add.reduceat(has[np.concatenate([ids[i] for i in some])], starts, dtype=np.int64)
            has[ids[x]] = False
            close = 9 * both >= 4 * (sizes[some] + sizes[x])  # both / (a + b - both) >= 0.8 in whole numbers
            found = some[close].tolist()
            out += [(x, i) for i in found]
            edge.extend(found)
            left = np.delete(left, fit[close])
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, hash of the text ``h``, hash of the set of shingles ``node``, its size ``n``, fingerprint ``fp`` and band keys, for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            sets = [shingles(t) for t in texts(b.column(1))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s[k : k + CHUNK] for k in range(0, len(s), CHUNK)) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), keys], names=["id", "h", "node", "n", "fp", "keys"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return picked.mapInArrow(run, "id long, h long, node long, n long, fp long, keys array<long>")


def exact_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(key, node, s)`` sorted by key: the forest of each key's sets."""

    def made(group: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        nodes = list(group)
        return [(nodes[i], nodes[j]) for i, j in forest(list(group.values()))] if len(nodes) > 1 else []

    held_key, held = None, {}
    for b in batches:
        out: list[tuple[int, int]] = []
        for key, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if key != held_key:
                out += made(held)
                held_key, held = key, {}
            held[node] = np.frombuffer(s.as_py(), "<u8")
        yield _edges(out)
    yield _edges(made(held))


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_IDS else df


def links(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, crowd: int = CROWD, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """Edges ``(a, b)`` between sets of a Jaccard of 0.8 or more whose components are those of all such candidate pairs.

    Fingerprints that share a band and are close are loosely linked.  A component of that graph gets the sets
    of its texts once and a task finds its exact links.  A crowded one is split by hash in parts, each two of
    which meet in a task.
    """
    sets_ = marked.where("n > 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))  # copies have the same
    keyed = sets_.select(F.explode("keys").alias("key"), "fp")
    shared = marked.where("n > 0").groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    loose = cut(close_pairs(keyed, DISTANCE).union(shared.select("fp", "fp")).distinct())
    found = components(loose)
    first = marked.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("low"), F.max("n").alias("n"), F.min("fp").alias("fp"))
    crowd_of = loose.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    member = cut(first.join(side(crowd_of), "fp").select("node", "component", F.col("low.id").alias("i"), F.col("low.h").alias("k"), "n"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) * 2 / crowd, F.sum("n") * 2 / most_shingles))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), parts.cast("int").alias("twice"))
    sizes = sizes.withColumn("parts", F.when((F.col("c") <= crowd) & (F.col("s") <= most_shingles), 1).otherwise(F.col("twice"))).select("component", "parts")
    dealt = member.join(sizes.repartition("parts", F.hash("component")), "component")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("component", F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    dealt = cut(dealt.withColumn("part", part).select("node", "i", "k", F.array_distinct(pairs).alias("meets")))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    picked = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    picked = picked.join(side(dealt), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("text", "node", "meets")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            yield pa.record_batch([b.column(1), b.column(2), pa.array([shingles(t).tobytes() for t in texts(b.column(0))], pa.binary())], names=["node", "meets", "s"])

    made = picked.mapInArrow(sets, "node long, meets array<long>, s binary").dropDuplicates(["node"])  # equal rows give equal sets
    met = made.select(F.explode("meets").alias("key"), "node", "s")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(exact_edges, "a long, b long")


def prefix(n):
    """Tokens of a set of ``n`` that are told, and how many of them others must have for it to have a partner.

    Of ``x`` and a partner ``y`` each lacks ``n // 5`` tokens of the other at most.  So the first ``n // 5 + 1`` tokens that they
    have in common are among the told ones of ``x``, and among those of ``y``, with 2 more than twice ``y``'s spare ones for
    what rounding takes.
    """
    return 2 * (n // 5) + 3, n // 5 + 1


def missed(docs: DataFrame, marked: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges ``(a, b)`` that join the components ``found`` so far to those of all pairs of sets of a Jaccard of 0.8 or more.

    A component tells the first tokens of its sets, and keeps those that another component tells too.  Where they
    are enough for a partner of its smallest set, its sets meet those of the others by all their tokens: few, since
    near copies are in one component already.
    """
    from . import ngramjoin  # which builds on this module

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            sets = [s for s in (shingles(t) for t in texts(b.column(0))) if len(s)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(node), pa.array([s[: prefix(len(s))[0]].view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "tokens"])

    own = lambda df: df.join(side(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = own(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "node long, tokens array<long>"))
    sent = told.select(F.explode("tokens").alias("token"), "component")  # by Spark: one Python worker a task
    also = sent.repartition("token").sortWithinPartitions("token", "component").mapInArrow(elsewhere, "component long, c long").groupBy("component").agg(F.sum("c").alias("c"))
    sets = marked.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct(F.col("id").isNull(), F.col("id").alias("i"), F.col("h").alias("k"))).alias("low"))
    sets = own(sets).select("node", "component", "n", "low.i", "low.k")
    least = sets.groupBy("component").agg(F.min("n").alias("n")).select("component", (F.floor(F.col("n") / 5) + 1).alias("least"))
    open_ = also.join(least, "component").where("c >= least").select("component")
    wanted = cut(sets.join(open_, "component", "left_semi").select("i", "k", "node"))
    if wanted.isEmpty():
        return found.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    whole = cut(ngramjoin.sets_of(docs, wanted, WIDTH, id_col, text_col, lambda s: s).dropDuplicates(["node"]))
    return ngramjoin.links(cut(ngramjoin.by_frequency(whole, LEAST)), LEAST)


def elsewhere(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(token, component)`` sorted by both: ``(component, c)``, how many of its tokens another component has too.

    Equal rows count once.  The last row of a batch is held until the next one tells whether its token goes on.
    """
    token, component, follows = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(0, bool)

    def counted(hit: np.ndarray) -> pa.RecordBatch:
        node, c = np.unique(hit, return_counts=True)
        return pa.record_batch([pa.array(node), pa.array(c)], names=["component", "c"])

    for b in batches:
        token, component = np.concatenate((token, b.column(0).to_numpy())), np.concatenate((component, b.column(1).to_numpy()))
        if not len(token):
            continue
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (component[1:] != component[:-1])))
        token, component = token[new], component[new]
        same = token[1:] == token[:-1]
        before = np.concatenate((follows if len(follows) else [False], same))
        yield counted(component[:-1][before[:-1] | same])
        token, component, follows = token[-1:], component[-1:], before[-1:]
    yield counted(component[follows])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies; columns stay as they are.

    Texts are linked whose sets of five-word shingles have a Jaccard of 0.8 or more, those without words
    with each other.  Candidates share a MinHash band (at 0.8 a pair is missed with probability 5e-6) and have close
    fingerprints; what these leave apart meets by prefixes of tokens (``missed``), so that no link is lost.  The
    similarity is checked on whole sets of 64-bit shingle hashes.  The row with the smallest id stays, null
    ids last, of different texts under one id the one with the smaller hash.
    """
    marked = cut(sketches(docs, id_col, text_col))
    quick = cut(links(docs, marked, id_col, text_col))
    more = cut(missed(docs, marked, components(quick), id_col, text_col))
    found = components(quick.union(more))
    first = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("low"))
    first = cut(first.join(side(found), "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = first.groupBy("component").agg(F.min("low").alias("low"))
    label = first.select("node", "component").join(lowest.repartition("low", F.hash("component")), "component").select("node", "low")
    own = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("h") == F.col("low.h"))
    gone = cut(marked.select("id", "h", "node").join(label.repartition("low", F.hash("node")), "node").where(~own).select(F.col("id").alias("i"), F.col("h").alias("k")).distinct())
    again = cut(marked.groupBy("id", "h").count().where("count > 1").select(F.col("id").alias("i"), F.col("h").alias("k")))
    h = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))

    def same(other: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(other["i"]) & (h == other["k"])  # columns by frame: docs may have any names

    drop = side(gone)
    kept = docs.join(drop, same(drop), "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col]))
