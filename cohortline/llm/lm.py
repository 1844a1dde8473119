"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, rows, texts

#: Pair counts are kept as levels of a geometric scale; a level of a pair takes ``BITS`` bits, probed ``PROBES`` times.
BASE, BITS, PROBES = 1.5, 8, 5
#: Bits of the filter and words with their counts that are broadcast at most; beyond, the probes are sent to the filter.
MOST_BITS, MOST_WORDS = 1 << 31, 1 << 24
#: Tokens counted at once, and those of a segment of the n-grams on average.
FLUSH, PER_SEGMENT = 1_000_000, 1_000_000
#: Bits of a segment's number that one exchange deals by, and tokens that a task deals again on average.
DEALT, PER_TASK = 8, 32_000_000
#: A word with at least this share of all tokens is known to all tasks: there are at most as many of them as its inverse.
HOT, LEAST_HOT = 1 << 20, 8
#: Classes of words, which a pair's key holds in its last bits: 0 for those that are not hot, then one for each doubling of
#: the count.  The least and the largest weight of pairs after words of a class, and bins of the counts of class 0.
CLASSES, LEAST, LARGEST, BINS = 32, 1e-3, 0.95, 256
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWEST = np.unique(np.ceil(BASE ** np.arange(0, 100)).clip(max=2**62).astype(np.int64))  # the count of each level
VALUE = np.concatenate(([0], LOWEST))
_long = pa.list_(pa.int64())


def tokens(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lowered, runs of bytes other than ASCII white space."""
    return text.lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pairs(before: np.ndarray, word: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The hash of two words in a row, with the class of the first one in its last bits."""
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + word) & np.uint64(-CLASSES % (1 << 64)) | kind.astype(np.uint64)


def chain(many: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts one after another, of the token before each, and the number of tokens of each text."""
    each = [tokens(t) for t in many]
    sizes = np.fromiter((len(x) + 1 for x in each), np.int64, len(each))
    ends = np.cumsum(sizes) - 1
    word = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = hashes([w for x in each for w in x])
    word[ends] = END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[ends - sizes + 1] = START
    return word, before, sizes


def leveled(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of (key, level)."""
    return mixed(keys + np.uint64(level * 0xA24BAED4963EE407 % (1 << 64)))


def probes(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the bits of (key, level) in its segment's part of the filter."""
    a = leveled(keys, level)
    b = mixed(a + np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % size


def quantised(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The level of each count: that below or above it, by a hash of the key, so that the mean of the levels' counts is the count."""
    low = np.searchsorted(LOWEST, n, side="right")
    below, above = VALUE[low], VALUE[np.minimum(low + 1, len(LOWEST))]
    chance = (n - below) / np.maximum(above - below, 1)
    return low + ((mixed(keys ^ END) >> np.uint64(11)) * 2.0**-53 < chance)


def filter_of(keys: np.ndarray, level: np.ndarray, bits_a_level: int = BITS) -> bytes:
    """A Bloom filter that holds each key at all levels up to its own."""
    size = bits_a_level * int(level.sum()) + 7 & ~7
    bits = np.zeros(size, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        for at in probes(keys[level >= k], k, np.uint64(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels(keys: np.ndarray, start: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The highest level up to which the filter, in the part ``start`` and ``size`` (in bits), has each key: never less than the true one."""
    out = np.zeros(len(keys), np.int64)
    left = np.flatnonzero(size > 0)
    for level in range(1, len(LOWEST) + 1):
        a = leveled(keys[left], level)
        b = mixed(a + np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
        first, n = start[left], size[left]
        for i in range(PROBES):
            at = first + (a + np.uint64(i) * b) % n
            hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, a, b, first, n = left[hit], a[hit], b[hit], first[hit], n[hit]
        if not len(left):
            break
        out[left] = level
    return out


def segment_of(keys: np.ndarray, power: int) -> np.ndarray:
    return (keys >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)


def counts_of(keys: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The count of each key in sorted ``known``, 0 where it is not there."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, times[at], 0).astype(np.int64)


@dataclass
class Model:
    """Totals, weights and the hot words, and, where they are few enough to be broadcast, all words' counts and the filter.

    ``least`` is the lowest count of a hot word, ``prior`` the weight of single words after the others, in tokens.
    """

    total: int
    distinct: int
    texts: int
    least: int
    hot: tuple[np.ndarray, np.ndarray]
    power: int
    prior: float = 1.0
    weights: np.ndarray | None = None
    hot_pairs: tuple[np.ndarray, np.ndarray] | None = None
    words: np.ndarray | None = None
    times: np.ndarray | None = None
    bounds: np.ndarray | None = None
    bits: np.ndarray | None = None

    def times_of(self, keys: np.ndarray) -> np.ndarray:
        return counts_of(keys, self.words, self.times)

    def value_of(self, keys: np.ndarray) -> np.ndarray:
        segment = segment_of(keys, self.power)
        start = self.bounds[segment]
        return VALUE[levels(keys, start, self.bounds[segment + 1] - start, self.bits)]

    def probability(self, c: np.ndarray, u: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a token by itself, and after the one before: a pair is no more frequent than its words.

        The former makes 1 over all words and one unknown word.  The latter mixes it with ``both / u``,
        which makes 1 over all words if no count is rounded, and on average if some are.
        """
        alone = (c + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        after = np.divide(np.minimum(both, np.minimum(c, u)), u, out=np.zeros(len(u)), where=u > 0)
        w = np.where(u < self.least, u / (u + self.prior), self.weights[classes(u, self.least)])
        return alone, w * after + (1 - w) * alone

    def score(self, many: list[bytes], times_of: Callable[[np.ndarray], np.ndarray], value_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and the model's score of each text."""
        word, before, sizes = chain(many)
        of = np.repeat(np.arange(len(sizes)), sizes)
        one, at = np.unique(mixed(word), return_inverse=True)
        c = times_of(one)[at]
        u = np.empty_like(c)  # the count of the token before, and that of a text's start
        u[1:] = c[:-1]
        u[before == START] = self.texts
        both = np.zeros(len(word), np.int64)
        may = np.flatnonzero((c > 0) & (u > 0))
        key, at = np.unique(pairs(before[may], word[may], classes(u[may], self.least)), return_inverse=True)
        both[may] = value_of(key)[at]
        alone, mix = self.probability(c, u, both)
        n = len(sizes)
        return sizes, np.bincount(of, c > 0, n).astype(np.int64), np.bincount(of, np.log10(alone), n), np.bincount(of, np.log10(mix), n)


def classes(u: np.ndarray, least: int) -> np.ndarray:
    """The class of a word's count: 0 below ``least``, then one for each doubling."""
    return np.where(u < least, 0, np.frexp(np.maximum(u, least) // least)[1]).clip(0, CLASSES - 1)


def binned(n: np.ndarray, least: int) -> np.ndarray:
    """The bin of a count below ``least``: one for each count, or as many as there are bins."""
    return n if least <= BINS else np.ceil(n * ((BINS - 1) / least)).astype(np.int64)


def prior(words: np.ndarray, tokens_: np.ndarray, single: int) -> float:
    """How many tokens of a rare word's own distribution the one of single tokens stands for beside those seen after it.

    By Good and Turing a new pair comes as often as there are pairs that were seen once.  The prior ``k`` is such
    that the shares ``k / (u + k)`` of the tokens after words seen ``u`` times make as many.  ``words`` and ``tokens_``
    are the numbers of words and of their tokens in each bin of counts; all are sums over the whole corpus.
    """
    some = words > 0
    if not some.any():
        return 1.0
    u, n = tokens_[some] / words[some], tokens_[some]
    low, high = 1e-3, 1e6
    for _ in range(200):
        k = (low * high) ** 0.5
        low, high = (k, high) if (n * k / (u + k)).sum() < single else (low, k)
    return float(low)


def weights(tokens_: np.ndarray, single: np.ndarray) -> np.ndarray:
    """By Good and Turing: of the tokens after hot words of a class, the share whose pair is seen again."""
    return (1 - np.divide(single, tokens_, out=np.ones(CLASSES), where=tokens_ > 0)).clip(LEAST, LARGEST)


SENT = "segment int, kind int, keys binary, n binary"


def blobs(kind: int, keys: np.ndarray, n: np.ndarray, power: int) -> pa.RecordBatch:
    """Sorted keys and their counts, a row for each segment."""
    edges = [0, *np.searchsorted(keys, np.arange(1, 1 << power, dtype=np.uint64) << np.uint64(64 - power)).tolist(), len(keys)] if power else [0, len(keys)]
    some = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    cast = n.astype("u1" if n.max(initial=0) < 256 else "<u8")
    columns = ([i for i, _, _ in some], [kind] * len(some), [keys[a:b].tobytes() for _, a, b in some], [cast[a:b].tobytes() for _, a, b in some])
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "kind", "keys", "n"])


def unpacked(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, "<u8"), np.frombuffer(n, "u1" if len(n) * 8 == len(keys) else "<u8").astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def gather(power: int, kind_of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable:
    """Counts the words of texts in flushes of bounded size; their pairs, where ``kind_of`` gives the classes of tokens."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, before = (np.concatenate(x) for x in zip(*held, strict=True))
        keys = mixed(word) if kind_of is None else pairs(before, word, kind_of(before))
        return blobs(int(kind_of is not None), *np.unique(keys, return_counts=True), power)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in rows(batches):
            word, before, _ = chain(texts(b.column(0)))
            held.append((word, before))
            n += len(word)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def deal(old: int, power: int) -> Callable:
    """Deals rows of the segments of ``old`` bits, sorted by segment, anew by ``power`` bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        segment, n = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, c = summed(parts)
                    own = blobs(kind, keys << np.uint64(old), c, power - old)  # the bits after those dealt by
                    whole = np.array(own.column(0).to_pylist(), np.int64) + (segment << (power - old))
                    back = pa.array([(np.frombuffer(x, "<u8") >> np.uint64(old) | np.uint64(segment << (64 - old))).tobytes() for x in own.column(2).to_pylist()], pa.binary())
                    yield pa.record_batch([pa.array(whole, pa.int32()), own.column(1), back, own.column(3)], names=own.schema.names)
                held[kind] = []

        for b in batches:
            for i in range(b.num_rows):
                at, kind, keys, c = (x[i].as_py() for x in b.columns)
                if n and (at != segment or n >= FLUSH):
                    yield from flush()
                    n = 0
                segment, n = at, n + len(keys) // 8
                held[kind].append(unpacked(keys, c))
        if n:
            yield from flush()

    return run


WORDS = "segment int, words binary, times binary, distinct long, total long, of_class array<long>, seen array<long>, seen_tokens array<long>, hot binary, hot_n binary"
PAIRS = "segment int, bits binary, single array<long>, hot_pair binary, hot_pair_n binary"


def row(values: tuple, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": _long}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([v.astype("<u8").tobytes() if k == "binary" and isinstance(v, np.ndarray) else v.tolist() if k == "array<long>" else v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return summed([unpacked(k.as_py(), n.as_py()) for k, n in zip(table["keys"], table["n"], strict=True)])


def merge_words(table: pa.Table, least: int) -> pa.Table:
    """One row for the rows of a segment: its words' exact counts, sums by class, those of class 0 by bin, and its hot words."""
    word, times = gathered(table)
    kind, many = classes(times, least), times >= least
    rare = binned(times[~many], least)
    of_class, seen, seen_tokens = np.bincount(kind, times, CLASSES), np.bincount(rare, minlength=BINS), np.bincount(rare, times[~many], BINS)
    return row((table["segment"][0].as_py(), word, times, len(word), int(times.sum()), of_class.astype(np.int64), seen, seen_tokens.astype(np.int64), word[many], times[many]), WORDS)


def merge_pairs(table: pa.Table, bits: int, least: int) -> pa.Table:
    """One row for the rows of a segment: the filter of its pairs, those that come once by class, and what the filter says of hot ones."""
    pair, n = gathered(table)
    raw, many = filter_of(pair, quantised(pair, n), bits), pair[n >= least]
    single = np.bincount((pair[n == 1] & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    told = VALUE[levels(many, np.zeros(len(many), np.uint64), np.full(len(many), len(raw) * 8, np.uint64), np.frombuffer(raw, np.uint8))]
    return row((table["segment"][0].as_py(), raw, single, many, told), PAIRS)


def total_of(made: DataFrame, column: str) -> np.ndarray:
    """The sums of an array column, element by element: a row for each class or bin goes to the driver."""
    out = np.zeros(max(CLASSES, BINS), np.int64)
    for r in made.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def sorted_arrays(made: DataFrame, keys: str, n: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of all segments on the driver, sorted by key."""
    held = [(bytes(k), bytes(v)) for k, v in made.select(keys, n).toLocalIterator()]
    key, value = (np.frombuffer(b"".join(x), "<u8") for x in (zip(*held, strict=True) if held else (b"", b"")))
    order = np.argsort(key)
    return key[order], value[order]


def dealt(train: DataFrame, size: int, power: int, kind_of: Callable | None = None) -> DataFrame:
    """Rows of keys and counts by segment of ``power`` bits, by as many exchanges as it takes."""
    old = min(power, DEALT)
    sent = train.select("text").mapInArrow(gather(old, kind_of), SENT)
    while old < power:
        new = min(power, old + DEALT)
        tasks = max(2, -(-size // (6 * PER_TASK)))
        spread = F.pmod(F.xxhash64("keys"), F.lit(max(1, -(-tasks // (1 << old)))))  # a segment of very many rows is shared by tasks
        sent = sent.repartition(tasks, "segment", spread).sortWithinPartitions("segment").mapInArrow(deal(old, new), SENT)
        old = new
    return sent


def count(train: DataFrame, most_bits: int = MOST_BITS, most_words: int = MOST_WORDS, bits_a_level: int = BITS) -> tuple[DataFrame, Model]:
    """Counts words, and then pairs, of the rows ``text``: the merged segments, and the model (with all of them, if they are few enough).

    Each task sums its tokens in flushes of bounded size, cuts the sorted hashes in at most ``2^DEALT``
    segments and sends a row for each, so that the rows are in proportion to the tokens.  A segment
    holds about ``PER_SEGMENT`` tokens however large the corpus is; where there are more than ``2^DEALT`` of
    them, the rows are dealt again by the next bits, in as many exchanges as it takes, and summed at each.
    The hot words are known to all tasks when pairs are counted, so that a pair's key holds the class of its first
    word, by which the pairs that come once in all rows are counted.
    """
    size, texts_ = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    power = max(0, int(np.ceil(np.log2(max(1, size / 6 / PER_SEGMENT)))))
    least = max(LEAST_HOT, (size // 2 + 2 * texts_) // HOT)  # of the tokens at most: each takes two bytes, but for the end of a text
    by_word = cut(dealt(train, size, power).groupBy("segment").applyInArrow(lambda table: merge_words(table, least), WORDS))
    total, distinct = (x or 0 for x in by_word.agg(F.sum("total"), F.sum("distinct")).first())
    model = Model(total, distinct, texts_, least, sorted_arrays(by_word, "hot", "hot_n"), power)
    sent = train.sparkSession.sparkContext.broadcast(model)

    def kind_of(before: np.ndarray) -> np.ndarray:
        return class_of(before, sent.value)

    by_pair = cut(dealt(train, size, power, kind_of).groupBy("segment").applyInArrow(lambda table: merge_pairs(table, bits_a_level, least), PAIRS))
    single, of_class = total_of(by_pair, "single"), total_of(by_word, "of_class")
    model.weights = weights(of_class[:CLASSES], single[:CLASSES])
    model.prior = prior(total_of(by_word, "seen"), total_of(by_word, "seen_tokens"), single[0])
    bytes_ = by_pair.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if distinct <= most_words and bytes_ * 8 <= most_bits:
        words, times, bits = {}, {}, {}
        for r in by_word.select("segment", "words", "times").toLocalIterator():
            words[r.segment], times[r.segment] = bytes(r.words), bytes(r.times)
        for r in by_pair.select("segment", "bits").toLocalIterator():
            bits[r.segment] = bytes(r.bits)
        order, by_bits = sorted(words), sorted(bits)
        bounds = np.zeros((1 << power) + 1, np.uint64)
        bounds[[k + 1 for k in by_bits]] = [len(bits[k]) * 8 for k in by_bits]
        model.words, model.times = (np.frombuffer(b"".join(x.pop(k) for k in order), "<u8") for x in (words, times))
        if model.times.max(initial=0) < 1 << 32:
            model.times = model.times.astype("<u4")
        model.bounds, model.bits = np.cumsum(bounds), np.frombuffer(b"".join(bits.pop(k) for k in by_bits), np.uint8)
    return by_word.unionByName(by_pair, allowMissingColumns=True), model


def class_of(before: np.ndarray, model: Model) -> np.ndarray:
    """Classes of tokens by the hot words alone; before the first token of a text there is its start, which comes once a text."""
    known, at = np.unique(before, return_inverse=True)
    u = counts_of(mixed(known), *model.hot)
    u[known == START] = model.texts
    return classes(u, model.least)[at]


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(b: pa.RecordBatch, model: Model, times_of: Callable, value_of: Callable) -> pa.RecordBatch:
    n, known, base, own = model.score(texts(b.column(1)), times_of, value_of)
    return pa.record_batch([b.column(0), b.column(2), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(own)], names=[x.split()[0] for x in SCORED.split(", ")])


def routed(picked: DataFrame, made: DataFrame, model: Model) -> DataFrame:
    """Scores rows by a model too large to be broadcast: the probes go to the segments and the counts come back.

    Rows are cut in slices of bounded text.  A slice asks for each of its words and pairs once; a
    segment answers what it has; the answers of a slice meet its texts.  All is in proportion to the
    input, and results are those of the broadcast model.  The few keys that many slices would ask for, those with a
    share of one in ``HOT`` of all tokens or more, are broadcast and not asked for.
    """
    model.hot_pairs = sorted_arrays(made.where("hot_pair is not null"), "hot_pair", "hot_pair_n")
    sent_model = picked.sparkSession.sparkContext.broadcast(model)

    def hot(kind: int) -> tuple[np.ndarray, np.ndarray]:
        return sent_model.value.hot_pairs if kind else sent_model.value.hot

    def unknown(keys: np.ndarray, kind: int) -> np.ndarray:
        """The keys that are not hot."""
        return keys[counts_of(keys, *hot(kind)) == 0]

    schema = "id long, text string, held_out boolean, slice long"

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in rows(batches):
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, number))], names=["id", "text", "held_out", "slice"])
            number += 1

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            for slice_ in np.unique(b.column(3).to_numpy()).tolist():
                word, before, _ = chain(texts(b.column(1).filter(pa.array(b.column(3).to_numpy() == slice_))))
                found = [unknown(np.unique(mixed(word)), 0), unknown(np.unique(pairs(before, word, class_of(before, sent_model.value))), 1)]
                key = np.concatenate(found)
                kind = np.repeat([0, 1], [len(x) for x in found])
                yield pa.record_batch([pa.array(segment_of(key, model.power), pa.int32()), pa.array(np.full(len(key), slice_)), pa.array(kind, pa.int32()), pa.array(key.view(np.int64))], names=["segment", "slice", "kind", "key"])

    names = ["slice", "kind", "key", "n"]

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = asked.select(names[:3])
        key, kind = asked["key"].to_numpy().view(np.uint64), asked["kind"].to_numpy()
        n = np.zeros(len(key), np.int64)
        words, times, bits = (next((x for x in own[c].to_pylist() if x is not None), b"") for c in ("words", "times", "bits"))
        one, two = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        n[one] = counts_of(key[one], np.frombuffer(words, "<u8"), np.frombuffer(times, "<u8"))
        if bits:
            bits = np.frombuffer(bits, np.uint8)
            n[two] = VALUE[levels(key[two], np.zeros(len(two), np.uint64), np.full(len(two), len(bits) * 8, np.uint64), bits)]
        return out.append_column("n", pa.array(n)).filter(pa.array(n > 0))

    def meet(texts_: pa.Table, got: pa.Table) -> pa.Table:
        kind, key, n = (got[c].to_numpy() for c in names[1:])

        def of(k: int) -> Callable:
            order = np.flatnonzero(kind == k)
            order = order[np.argsort(key[order].view(np.uint64))]
            known, times = key[order].view(np.uint64), n[order]
            new = np.concatenate(([True], known[1:] != known[:-1])) if len(known) else np.empty(0, bool)
            return lambda keys: counts_of(keys, *hot(k)) + counts_of(keys, known[new], times[new])

        own = sent_model.value
        if not texts_.num_rows:
            return pa.table(scored(pa.record_batch([pa.array([], f.type) for f in texts_.schema], schema=texts_.schema), own, of(0), of(1)))
        return pa.Table.from_batches([scored(b, own, of(0), of(1)) for b in texts_.combine_chunks().to_batches()])

    parts = cut(picked.mapInArrow(sliced, schema))
    asked = parts.mapInArrow(ask, "segment int, slice long, kind int, key long")
    answers = asked.groupBy("segment").cogroup(made.select("segment", "words", "times", "bits").groupBy("segment")).applyInArrow(answer, "slice long, kind int, key long, n long")
    return parts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(meet, SCORED)


def score(docs: DataFrame, folds: int = 10, held: int = 0, most_bits: int = MOST_BITS, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row of ``docs`` by a model of the rows whose crc32 fold is not ``held``.

    The model interpolates pairs of words with words.  Counts are those of all training rows: of words exact, of
    pairs as levels of a geometric scale in one Bloom filter, read by probing level after level until one
    is missing.  The weights follow from how many pairs come once in all training rows, by class of the first word.
    Scores depend on the rows alone, not on how they lie in files.
    Rows: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score`` (exact, with
    add-0.1 smoothing of single tokens), ``score`` (log10 probability by the model, never above 0).  A
    null text is empty: it has its end token only.  Repeated rows all come back; null ids are in fold 0; an
    empty table gives no rows; if nothing is left to learn from, every token is unknown; other columns are not
    looked at.  The filter has ``BITS`` bits a level at every size; a model of more than ``most_bits`` bits or
    ``most_words`` words is not broadcast, but the probes are sent to it, with the same result.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (fold(F.col(id_col), folds) == held).alias("held_out"))
    made, model = count(picked.where(~F.col("held_out")), most_bits, most_words)
    if model.words is None:
        found = routed(picked, made, model)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows(batches):
                yield scored(b, sent.value, sent.value.times_of, sent.value.value_of)

        found = picked.mapInArrow(run, SCORED)
    return found.withColumnRenamed("id", id_col)
