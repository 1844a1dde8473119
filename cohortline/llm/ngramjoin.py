"""Similarity join of texts by the Jaccard of their word shingles, by prefix filters under several token orders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, rows, texts
from .lm import mixed
from .nearcopies import shingles, side

WIDTH, LEAST = 4, 85
#: Tokens that a task compares with each other before it sends what is left.
FLUSH = 600_000
#: Texts and shingles of candidates that one task compares with each other at most, unless two parts are longer.
CROWD, MOST_SHINGLES = 4096, 4_000_000
_SECOND = np.uint64(0x94D049BB133111EB)


def spare(n, least: int = LEAST):
    """Tokens of a set of ``n`` that a partner may lack: it shares ``ceil(least * n / 100)`` at least."""
    return (100 - least) * n // 100


def second_order(one: np.ndarray) -> np.ndarray:
    """Tokens by another hash; the first order is that of the tokens themselves, which are hashes."""
    return one[np.argsort(mixed(one ^ _SECOND), kind="stable")]


def marks(docs: DataFrame, width: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """For every row: ``id``, hash of the text ``h``, hash of its set ``node``, size ``n`` and its prefix in the first order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            sets = [shingles(t, width) for t in texts(b.column(1))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prefix = [s[: spare(len(s), least) + 1].tobytes() for s in sets]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prefix, pa.binary())], names=["id", "h", "node", "n", "tokens"])

    return cut(picked(docs, id_col, text_col).mapInArrow(run, "id long, h long, node long, n long, tokens binary"))


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def met(flush: int = FLUSH) -> Callable:
    """From rows ``(node, tokens)`` of different nodes, numbers of 0 or more: what a task knows of its own tokens, and what others have to tell.

    Rows ``(token, v)``: a token and its node; a token that several of the task's sets have once, with -1; and for a node
    ``v = -2 - node`` the number of such tokens of it, above 20 bits that spread these rows.  So a token that every
    text has makes a row for each flush, not for each text.
    """

    def send(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for _, t in held])
        node, token = np.repeat(np.array([n for n, _ in held], np.int64), sizes), np.concatenate([t for _, t in held])
        order = np.argsort(token)
        node, token = node[order], token[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        alone = np.diff(np.append(first, len(token))) == 1
        one, many = first[alone], first[~alone]
        both = np.ones(len(token), bool)
        both[one] = False
        here, c = np.unique(node[both], return_counts=True)
        spread = mixed(here.view(np.uint64)) & np.uint64((1 << 20) - 1) | c.astype(np.uint64) << np.uint64(20)
        keys = np.concatenate((token[one], token[many], spread)).view(np.int64)
        return pa.record_batch([pa.array(keys), pa.array(np.concatenate((node[one], np.full(len(many), -1), -2 - here)))], names=["token", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for node, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = np.frombuffer(raw.as_py(), "<u8")
                held.append((node, tokens))
                n += len(tokens)
                if n >= flush:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    return run


def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(token, v)`` of ``met`` sorted by token: ``(node, c)``, how many tokens of a node others have too.

    The last row of a batch is held until the next one tells whether it has the same token.
    """
    token, v, follows = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, bool)

    def found(node: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(node), pa.array(c)], names=["node", "c"])

    for b in batches:
        new_token, new_v = b.column(0).to_numpy(), b.column(1).to_numpy()
        own, key = new_v < -1, new_v >= -1
        yield found(-2 - new_v[own], new_token[own] >> 20)
        token, v = np.concatenate((token, new_token[key])), np.concatenate((v, new_v[key]))
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        follows = np.concatenate((follows[:1], same))
        hit = ((follows[:-1] | same) & (v[:-1] >= 0)).nonzero()[0]
        yield found(v[hit], np.ones(len(hit), np.int64))
        token, v, follows = token[-1:], v[-1:], follows[-1:]
    last = (follows[: len(v)] & (v >= 0)).nonzero()[0]
    yield found(v[last], np.ones(len(last), np.int64))


def known_elsewhere(tokens: DataFrame) -> DataFrame:
    """``(node, c)``: of the ``tokens`` of each node, how many another node has too; nodes without such have no row."""
    sent = tokens.mapInArrow(met(), "token long, v long")
    found = sent.repartition("token").sortWithinPartitions("token").mapInArrow(shared, "node long, c long")
    return found.groupBy("node").agg(F.sum("c").alias("c"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(node, tokens)``: what ``make`` takes of the sets of the texts that ``wanted`` (i, k, node) names by id and hash."""
    found = picked(docs, id_col, text_col).join(side(wanted), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            yield pa.record_batch([b.column(0), pa.array([make(shingles(t, width)).tobytes() for t in texts(b.column(1))], pa.binary())], names=["node", "tokens"])

    return found.mapInArrow(run, "node long, tokens binary")


def by_frequency(sets: DataFrame, least: int) -> DataFrame:
    """``(node, tokens, rare)``: each set's prefix in the order of frequency among these sets, without tokens that no other set has.

    Such tokens come first in that order, so a set with more of them than it may lack has no prefix and goes.
    """
    token = sets.mapInArrow(tokens_of, "node long, token long")
    often = token.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    size = F.octet_length("tokens") / 8
    free = F.floor(size * (100 - least) / 100).cast("int")
    found = token.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
    most = free + 1 - (size.cast("int") - F.size("known"))
    return sets.join(found, "node").where(most > 0).select("node", "tokens", F.slice("known.token", 1, most).alias("rare"))


def tokens_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            token = np.frombuffer(raw.as_py(), "<i8")
            yield pa.record_batch([pa.array(np.full(len(token), node)), pa.array(token)], names=["node", "token"])


def forest(sets: list[np.ndarray], rare: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links sets (no empty ones) of a Jaccard of ``least`` percent or more.

    A breadth-first search.  Of the sets not reached so far those are compared whole that fit in size and share a
    token of the prefix under each order: by frequency (``rare``), by hash and by another hash.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    free = spare(sizes, least) + 1
    orders = [Postings(rare), Postings([s[:k] for s, k in zip(sets, free.tolist(), strict=True)]), Postings([second_order(s)[:k] for s, k in zip(sets, free.tolist(), strict=True)])]
    whole = Postings(sets)
    left, out = np.arange(len(sets)), []
    while len(left):
        edge, left = [int(left[0])], left[1:]
        while edge and len(left):
            x = edge.pop()
            few, many = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            some = (100 * few >= least * many).nonzero()[0]
            for order in orders:
                some = some[order.common(x, left[some]) > 0]
            both = whole.common(x, left[some])
            close = some[100 * both >= least * (sizes[left[some]] + sizes[x] - both)]
            found = left[close].tolist()
            out += [(x, i) for i in found]
            edge.extend(found)
            left = np.delete(left, close)
    return out


class Postings:
    """Lists of tokens, numbered; ``common`` counts the tokens that one of them shares with others."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists], np.int64)
        values, self.flat = np.unique(np.concatenate(lists), return_inverse=True)
        self.ends, self.sizes, self.has = np.cumsum(sizes), sizes, np.zeros(len(values), bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        full = self.sizes[others].nonzero()[0]
        if len(full):
            some = others[full]
            own = self.flat[self.ends[x] - self.sizes[x] : self.ends[x]]
            self.has[own] = True
            n = self.sizes[some]
            starts = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(self.ends[some] - n - starts, n)
            out[full] = np.add.reduceat(self.has[self.flat[at]], starts, dtype=np.int64)
            self.has[own] = False
        return out


def exact_edges(least: int) -> Callable:
    """From rows ``(key, node, tokens, rare)`` sorted by key: the forest of each key's sets."""

    def made(group: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes = list(group)
        out = forest(*(list(x) for x in zip(*group.values(), strict=True)), least) if len(nodes) > 1 else []
        return pa.record_batch([pa.array([nodes[e[i]] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, {}
        for b in batches:
            for key, node, raw, rare in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if key != held_key:
                    yield made(held)
                    held_key, held = key, {}
                held[node] = np.frombuffer(raw.as_py(), "<u8"), rare.values.to_numpy().view(np.uint64)
        yield made(held)

    return run


def links(alike: DataFrame, least: int, crowd: int = CROWD, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``alike`` (node, tokens, rare) that are close enough.

    Sets that share a token of the prefix by frequency are loosely linked, as a star for each token.  The sets of a
    component meet in a task; a crowded one is split by hash in parts, each two of which meet.
    """
    rare = alike.select("node", F.explode("rare").alias("token"))
    star = rare.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    found = components(rare.join(star, "token").where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    member = cut(alike.select("node", F.octet_length("tokens").alias("size")).join(found, "node").select("node", "component", F.col("size") / 8))
    member = member.toDF("node", "component", "n")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) * 2 / crowd, F.sum("n") * 2 / most_shingles))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), parts.cast("int").alias("twice"))
    sizes = sizes.select("component", F.when((F.col("c") <= crowd) & (F.col("s") <= most_shingles), 1).otherwise(F.col("twice")).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("component", F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    dealt = member.join(sizes.repartition("parts", F.hash("component")), "component").withColumn("part", part).select("node", F.array_distinct(pairs).alias("meets"))
    met_ = alike.join(dealt, "node").select(F.explode("meets").alias("key"), "node", "tokens", "rare")
    return met_.repartition("key").sortWithinPartitions("key").mapInArrow(exact_edges(least), "a long, b long")


def classes(docs: DataFrame, least: int = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (size of its set) and ``component_id``.

    Words are runs of bytes other than ASCII white space, A-Z lowered; a set holds the distinct runs of ``width``
    words, of fewer words the whole sequence, and is empty without any.  Two rows are linked if neither set is empty and
    their Jaccard is ``least`` percent or more; ``component_id`` is the smallest id reachable, the own one included.

    A set with a partner shares at least ``least`` percent of its tokens with it, so that under any order of all
    tokens both have one in common among their first ``spare + 1``, and of any ``k`` tokens of a set the partner has
    ``k - spare``.  Three orders are used one after another, each on what the one before has left: that of the
    tokens' hashes finds the sets whose prefix has any token that another set has too; another hash counts these in
    a prefix of twice the length; and by frequency among what is left, rare tokens first, candidates share a token of
    the prefix.  Pairs must meet under all three before whole sets are compared (64-bit hashes of shingles).

    Equal sets are one.  Null and empty texts are linked with nothing; repeated rows all come back with the same
    values; a null id comes back null with the component of its set (null only if no row of it has an id), and alone if
    it is empty; an empty table gives no rows; other columns are not looked at.
    """
    marked = marks(docs, width, least, id_col, text_col)
    full = marked.where("n > 0")
    first = cut(full.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("i"), F.col("h").alias("k"))).alias("low"), F.max("n").alias("n")))
    first = first.withColumn("number", F.monotonically_increasing_id())  # of rows that are written: it stays; small numbers take less room
    key = first.select(F.col("number").alias("node"), F.col("node").alias("whole"), "n", "low.i", "low.k")
    own = full.join(side(key.select("node", "i", "k").withColumnRenamed("node", "number")), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("number", "tokens")
    some = known_elsewhere(own)
    wanted = cut(key.join(some, "node").select("i", "k", "node", "n"))
    twice = sets_of(docs, wanted.select("i", "k", "node"), width, id_col, text_col, lambda s: second_order(s)[: 2 * spare(len(s), least) + 1])
    enough = F.least(F.col("n"), spare_of(F.col("n"), least) * 2 + 1) - spare_of(F.col("n"), least)
    wanted = cut(wanted.join(known_elsewhere(twice), "node").where(F.col("c") >= enough).select("i", "k", "node"))
    sets = cut(sets_of(docs, wanted, width, id_col, text_col, lambda s: s).dropDuplicates(["node"]))
    alike = cut(by_frequency(sets, least))
    found = components(links(alike, least))
    joined = cut(key.join(side(found), "node", "left").select(F.col("whole").alias("node"), "i", F.coalesce("component", F.col("node")).alias("component")))
    lowest = joined.groupBy("component").agg(F.min("i").alias("component_id"))
    label = joined.select("node", "component").join(lowest.repartition("component_id", F.hash("component")), "component").select("node", "component_id")
    out = marked.select("id", "node", "n").join(side(cut(label)), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def spare_of(n, least: int):
    return F.floor(n * (100 - least) / 100)
