"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, rows

#: Weights of hashed features (feature 0 is none), features of a word, tokens of a training segment.
WEIGHTS, WIDTH, SEGMENT = 1 << 18, 12, 32
#: Labelled rows of each class that the model is fitted on (expected numbers), and segments of each row.
TOXIC_ROWS, CLEAN_ROWS, SEGMENTS = 1500, 4500, 4
#: A feature marks toxic tokens if it is in this share of the toxic rows (and in this many), and so many
#: times as frequent there as in clean rows.
SHARE, AT_LEAST, RATIO = 0.02, 5, 20.0
FLAGGED, REMEMBERED, LINE = 0.5, 300_000, 128
_word = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """What the model sees of a word: itself, its first 3 to 9 letters and its last 3 and 4."""
    w = word.lower()
    n = len(w)
    return [w, *["^" + w[:k] for k in range(3, min(n, 10))], *[w[-k:] + "$" for k in (3, 4) if n > k]]


def feature(part: str) -> int:
    return xxhash.xxh32_intdigest(part) % (WEIGHTS - 1) + 1


def hashed(word: str) -> list[int]:
    return [feature(p) for p in parts(word)]


def beside(word: str) -> tuple[int, int]:
    """The features of a word for the word after it and for the one before it."""
    w = word.lower()
    return feature("<" + w), feature(">" + w)


class Tagger:
    """Two tags, 0 and 1: ``weights`` score tag 1 of a word, ``step[i, j]`` the step from tag i to j."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(WEIGHTS, np.float32), -2.0
        self.step, self.first = np.zeros((2, 2)), np.zeros(2)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, 3))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": np.empty((0, 3))}

    def emissions(self, words: list[str], starts: np.ndarray) -> np.ndarray:
        """Scores of tag 1 for the words of texts laid one after another: of a word itself and of those beside it."""
        at = list(map(self.known.get, words))
        new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
        if new:
            if len(self.known) > REMEMBERED:  # all go, those of these texts come again
                self.known, self.table = {}, np.empty((0, 3))
                new = list(dict.fromkeys(words))
            own = [hashed(w) for w in new]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter((i for x in own for i in x), np.int64, int(sizes.sum()))
            near = self.weights[np.array([beside(w) for w in new])].astype(np.float64)
            score = np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) + self.bias
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate((self.table, np.column_stack((score, near))))
            at = list(map(self.known.__getitem__, words))
        found = self.table[np.array(at, np.int64)]
        out = found[:, 0].copy()
        inner = np.ones(len(out), bool)
        inner[starts[starts < len(out)]] = False
        inner = np.flatnonzero(inner)
        out[inner] += found[inner - 1, 1]
        out[inner - 1] += found[inner, 2]
        return out

    def marginals(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Exact forward-backward probabilities of tag 1, for texts laid one after another.

        The chain is a product of 2x2 matrices, a text's first one having equal rows, so that nothing
        passes from one text to the next.  It is cut in lines: their products are taken side by side,
        messages are then passed from line to line, and at last within all lines side by side.
        """
        n = len(scores)
        if not n:
            return np.empty(0)
        lines = -(-n // LINE)
        e = np.zeros(lines * LINE)
        e[:n] = np.clip(scores, -30, 30)
        first = np.zeros(lines * LINE, bool)
        first[starts[starts < n]] = True
        first[n:] = True
        a, s = np.exp(self.step), np.exp(self.first)
        m = np.where(first[:, None, None], s[None, None, :], a[None, :, :])
        m[:, :, 1] *= np.exp(e)[:, None]
        m /= m.max((1, 2), keepdims=True)
        m = m.reshape(lines, LINE, 2, 2)
        whole = m[:, 0].copy()
        for k in range(1, LINE):
            whole = whole @ m[:, k]
            whole /= whole.max((1, 2), keepdims=True)
        ahead, behind = np.empty((lines, 2)), np.empty((lines, 2))
        v = [0.5, 0.5]
        steps = whole.reshape(lines, 4).tolist()
        for k, (p, q, r, t) in enumerate(steps):
            ahead[k] = v
            x, y = v[0] * p + v[1] * r, v[0] * q + v[1] * t
            v = [x / (x + y), y / (x + y)]
        v = [0.5, 0.5]
        for k in range(lines - 1, -1, -1):
            behind[k] = v
            p, q, r, t = steps[k]
            x, y = p * v[0] + q * v[1], r * v[0] + t * v[1]
            v = [x / (x + y), y / (x + y)]
        alpha = np.empty((LINE, lines, 2))
        v = ahead
        for k in range(LINE):
            v = np.einsum("li,lij->lj", v, m[:, k])
            v /= v.sum(1, keepdims=True)
            alpha[k] = v
        out, v = np.empty((LINE, lines)), behind
        for k in range(LINE - 1, -1, -1):
            x = alpha[k] * v
            out[k] = x[:, 1] / x.sum(1)
            v = np.einsum("lij,lj->li", m[:, k], v)
            v /= v.sum(1, keepdims=True)
        return out.T.reshape(-1)[:n]

    def score(self, many: list[str | None]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """For each text: the largest marginal (0 without words), and the offsets ``[from, to)`` of the runs of words at ``FLAGGED`` or more."""
        words = [_word.findall(t) if t else [] for t in many]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        p = self.marginals(self.emissions([w for ws in words for w in ws], ends - sizes), ends - sizes)
        score, spans = [], []
        for text, end, n in zip(many, ends.tolist(), sizes.tolist(), strict=True):
            own = p[end - n : end]
            score.append(float(own.max()) if n else 0.0)
            spans.append(self.runs(text, own) if n and score[-1] >= FLAGGED else [])
        return score, spans

    @staticmethod
    def runs(text: str, p: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        last = -2
        for k, (m, hit) in enumerate(zip(_word.finditer(text), (p >= FLAGGED).tolist(), strict=True)):
            if hit:
                out[-1:] = [(out[-1][0], m.end())] if last == k - 1 else [*out[-1:], m.span()]
                last = k
        return out

    def fit(self, f: np.ndarray, tags: np.ndarray, used: np.ndarray, passes: int = 6, batch: int = 2048, rate: float = 0.3, decay: float = 1e-5) -> None:
        """Maximum likelihood by AdaGrad over segments: ``f`` features, ``tags`` and the tokens ``used``."""
        w, order = np.zeros(WEIGHTS), np.random.default_rng(0)
        square, small_square, small = np.full(WEIGHTS, 1e-6), np.full(7, 1e-6), np.array([self.bias, *self.step.ravel(), *self.first])
        for _ in range(passes):
            shuffled = order.permutation(len(f))
            for k in range(0, len(f), batch):
                pick = shuffled[k : k + batch]
                x, y, on = f[pick], tags[pick], used[pick]
                e, step, first = w[x].sum(2) + small[0], small[1:5].reshape(2, 2), small[5:7]
                p, pairs = _expectations(e, on, step, first)
                miss = np.where(on, p - y, 0.0)
                grad = np.bincount(x.ravel(), np.repeat(miss.ravel(), x.shape[2]), WEIGHTS) / len(pick) + decay * w
                grad[0] = 0
                seen = np.array([[(on[:, 1:] & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
                g = np.concatenate(([miss.sum()], (pairs - seen).ravel(), [(1 - p[:, 0]).sum() - (y[:, 0] == 0).sum(), p[:, 0].sum() - (y[:, 0] == 1).sum()])) / len(pick)
                square += grad**2
                small_square += g**2
                w -= rate * grad / np.sqrt(square)
                small -= rate * g / np.sqrt(small_square)
        w[0] = 0
        self.weights, self.bias, self.step, self.first = w.astype(np.float32), float(small[0]), small[1:5].reshape(2, 2), small[5:7]


def _expectations(e: np.ndarray, on: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 and expected counts of steps, over segments side by side."""
    n, length = e.shape
    a = np.exp(step)
    emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    alpha, beta = np.empty((length, n, 2)), np.ones((length, n, 2))
    v = np.exp(first) * emit[:, 0]
    alpha[0] = v / v.sum(1, keepdims=True)
    for t in range(1, length):
        v = (alpha[t - 1] @ a) * emit[:, t]
        alpha[t] = np.where(on[:, t, None], v / v.sum(1, keepdims=True), alpha[t - 1])
    for t in range(length - 2, -1, -1):
        v = (beta[t + 1] * emit[:, t + 1]) @ a.T
        beta[t] = np.where(on[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
    both = alpha * beta
    p = (both[:, :, 1] / both.sum(2)).T
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        x = alpha[t - 1][:, :, None] * a[None] * (emit[:, t] * beta[t])[:, None, :]
        pairs += (x / x.sum((1, 2), keepdims=True))[on[:, t]].sum(0)
    return p, pairs


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows_of: tuple[int, int]) -> DataFrame:
    """A bounded sample of ``(text, y)``: rows in the folds to learn from, chosen by a hash of the id.

    The ids are chosen first; they are few whatever the input is, and are broadcast to the documents.
    An id that repeats gives one of its texts.
    """
    known = labels.where((fold(F.col("id"), folds) != held) & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    rate: Column = F.when(F.col("y") == 1, rows_of[1] / max(1, sizes.get(1, 0))).otherwise(rows_of[0] / max(1, sizes.get(0, 0)))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < rate * 1_000_003)
    found = docs.where("text is not null").join(F.broadcast(chosen), "id").groupBy("id")
    return cut(found.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y"))


def lexicon(sample: DataFrame, share: float, ratio: float) -> set[str]:
    """Parts of words that mark toxic texts: the labels of tokens follow from these and the text's label."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for b in rows(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update({p for w in set(_word.findall(text)) for p in parts(w) if len(p) > 3})
        for y, n in seen.items():
            yield pa.record_batch([pa.array(list(n), pa.string()), pa.array([y] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["part", "y", "n"])

    size = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    toxic, clean = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    found = sample.mapInArrow(count, "part string, y int, n long").groupBy("part").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    marks = found.where((F.col("a") >= max(AT_LEAST, share * toxic)) & (F.col("a") / toxic >= ratio * (F.col("b") + 1) / clean))
    return {r[0] for r in marks.select("part").collect()}


def learn(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows_of: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS), share: float = SHARE, ratio: float = RATIO, most: int = SEGMENTS) -> Tagger:
    """Fits a tagger on ``docs`` (id, text) and ``labels`` (id, y).

    What a word's label follows from is counted on whole texts; the random field is then fitted on ``most``
    segments of each sampled text, those with marked words first, and so on 128 words of it by default.
    """
    sample = labelled(docs, labels, folds, held, rows_of)
    marks = lexicon(sample, share, ratio)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out: list[tuple[bytes, bytes, int]] = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _word.findall(text)
                tags = [int(y == 1 and not marks.isdisjoint(parts(w))) for w in words]
                starts = sorted(range(0, len(words), SEGMENT), key=lambda k: (not any(tags[k : k + SEGMENT]), xxhash.xxh32_intdigest(" ".join(words[k : k + SEGMENT])), k))
                for k in starts[:most]:
                    own = words[k : k + SEGMENT]
                    f, t = np.zeros((SEGMENT, WIDTH), np.int32), np.zeros(SEGMENT, np.int8)
                    for i, w in enumerate(own):
                        h = hashed(w)
                        f[i, : len(h)] = h
                        if k + i:
                            f[i, -2] = beside(words[k + i - 1])[0]
                        if k + i + 1 < len(words):
                            f[i, -1] = beside(words[k + i + 1])[1]
                    t[: len(own)] = tags[k : k + SEGMENT]
                    out.append((f.tobytes(), t.tobytes(), len(own)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["f", "t", "n"])

    got = sample.mapInArrow(segments, "f binary, t binary, n int").toArrow()
    tagger = Tagger()
    if got.num_rows:
        f = np.frombuffer(b"".join(got["f"].to_pylist()), np.int32).reshape(-1, SEGMENT, WIDTH)
        tags = np.frombuffer(b"".join(got["t"].to_pylist()), np.int8).reshape(-1, SEGMENT)
        order = np.lexsort((f[:, 1, 0], f[:, 0, 0], tags.sum(1)))  # the rows' order is not the same in every run
        tagger.fit(f[order], tags[order], (np.arange(SEGMENT) < got["n"].to_numpy()[:, None])[order])
    return tagger


def _tagger(docs: DataFrame, labels: DataFrame, folds: int, held: int, id_col: str, text_col: str, label_col: str, most: int = SEGMENTS) -> Tagger:
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return learn(named, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")), folds, held, most=most)


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SEGMENTS) -> DataFrame:
    """Toxicity of every row of ``docs``.

    Token labels come from ``labels`` (``id_col``, ``label_col``): in a text labelled 1, words with a part
    that marks such texts.  Only rows whose crc32 fold is not ``held`` are learnt from, about
    ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of them.  Rows: ``id_col, held_out, score`` (the largest
    marginal of the text's words, which are seen with their parts and the words beside them), ``predicted`` (1 at ``threshold`` or more), ``spans`` (offsets
    of offending runs of words, in characters, end excluded).  Null and empty texts and texts without words
    score 0; without labels of both classes nothing is flagged; ids labelled twice count as toxic if any
    label is; null ids are in fold 0 and unlabelled; repeated rows all come back; an empty table gives no
    rows; other columns are not looked at.
    """
    tagger = _tagger(docs, labels, folds, held, id_col, text_col, label_col, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for b in rows(batches):
            s, spans = tagger.score(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([[{"from": x, "to": y} for x, y in own] for own in spans], span)], names=["id", "held_out", "score", "predicted", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (fold(F.col(id_col), folds) == held).alias("held_out"))
    return picked.mapInArrow(run, "id long, held_out boolean, score double, predicted int, spans array<struct<from:int,to:int>>").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict to be toxic, unchanged.

    Null and empty texts stay, repeated rows stay or go together; without labels of both classes, and in an
    empty table, no row goes; columns of any name come back as they are.
    """
    tagger = _tagger(docs, labels, folds, held, id_col, text_col, label_col, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text_col):
            s, _ = tagger.score(b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield b.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
