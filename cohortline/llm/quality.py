"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, rows

#: Labelled rows that vote (expected number), hashed terms, latent dimensions, neighbours and the power of a similarity in a vote.
VOTERS, TERMS, LATENT, NEIGHBOURS, POWER = 5000, 1024, 32, 15, 4
#: The first terms are no word shapes: nothing, repeats, and ten steps each of distinct words and lines.
FIRST_SHAPE = 32
REMEMBERED = 200_000
_runs = re.compile(r"(.)\1+", re.DOTALL)
_known: dict[str, int] = {}


def shape(word: str) -> str:
    """A word with letters and digits as their class and runs as one: ``Word,`` is ``Aa,`` and ``word###`` is ``a#``."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return _runs.sub(r"\1", "".join(kinds))


def term(word: str) -> int:
    found = _known.get(word)
    if found is None:
        if len(_known) >= REMEMBERED:
            _known.clear()
        _known[word] = found = zlib.crc32(shape(word).encode()) % (TERMS - FIRST_SHAPE) + FIRST_SHAPE
    return found


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's terms: word shapes, words like the one before, variety of words and lines."""
    v = np.zeros(TERMS, np.float32)
    words = text.split() if text else []
    if not words:
        v[0] = 1
        return v
    n, lines = len(words), text.split("\n")
    v += np.bincount(np.fromiter(map(term, words), np.int64, n), minlength=TERMS)
    v[1] = sum(map(str.__eq__, words, words[1:]))
    v[2 + min(9, 10 * len(set(words)) // n)] = 0.3 * n
    v[12 + min(9, 10 * len(set(lines)) // len(lines))] = 0.3 * n
    return np.sqrt(v / n)


@dataclass
class Voters:
    """Labelled latent vectors of length one, with the way into their space."""

    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Voters:
        """Latent semantic analysis: the strongest right singular vectors of the weighted term matrix."""
        weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
        z = cls.unit(x * weight)
        _, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
        space = np.ascontiguousarray(vectors[:, ::-1][:, :latent]).astype(np.float32)
        return cls(weight, space, cls.unit(z @ space), labels.astype(np.float32))

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, x: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        """The share of label 1 among the nearest voters by exact cosine, each weighted by a power of it."""
        if not len(self.labels):
            return np.zeros(len(x))
        near = self.unit(self.unit(x * self.weight) @ self.space) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.take_along_axis(near, at, 1).clip(1e-6).astype(np.float64) ** power
        return (w * self.labels[at]).sum(1) / w.sum(1)


def learn(docs: DataFrame, labels: DataFrame, folds: int, held: int, voters: int) -> Voters:
    """Voters from a bounded sample of labelled rows, chosen by a hash of the id; only ids are broadcast to find them; an id that repeats gives one of its texts."""
    known = labels.where((fold(F.col("id"), folds) != held) & F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"))
    rate = voters / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) < rate * 1_000_003)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            yield pa.record_batch([pa.array([terms(t).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["v", "y"])

    found = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    got = found.select("text", "y").mapInArrow(run, "v binary, y int").toArrow()
    order = sorted(zip(got["v"].to_pylist(), got["y"].to_pylist(), strict=True))  # rows come in any order
    x = np.frombuffer(b"".join(v for v, _ in order), np.float32).reshape(-1, TERMS)
    return Voters.fit(x, np.array([y for _, y in order]))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, voters: int = VOTERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Quality of every row of ``docs`` as ``labels`` (``id_col``, ``label_col``) marks it.

    About ``voters`` labelled rows whose crc32 fold is not ``held`` are broadcast as latent vectors; every
    text is compared with all of them.  Rows: ``id_col, held_out, score`` (weighted share of label 1
    among the nearest), ``predicted`` (1 at ``threshold`` or more).  Null and empty texts, and texts
    without words, have a term of their own and are scored like others; without labels every score is
    0; an id labelled twice counts with its lower label; null ids are in fold 0 and unlabelled; repeated
    rows all come back; an empty table gives no rows; other columns are not looked at.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = learn(named, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")), folds, held, voters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            s = model.vote(np.stack([terms(t) for t in b.column(1).to_pylist()]))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    marked = named.withColumn("held_out", fold(F.col("id"), folds) == held)
    return marked.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
