"""Language identification of multilingual texts by mixture inference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, rows

#: Buckets that byte trigrams are hashed to, labelled documents per language that the model is fitted
#: on (expected number), added to each count, and the cost of one more language in units of log(trigrams).
BUCKETS, PER_LANGUAGE, SMOOTHING, PENALTY = 1 << 16, 600, 0.5, 4.0
ITERATIONS, NONE = 40, "und"
#: Languages whose sampling rates are broadcast at most: texts are not shuffled by language.
MOST_LANGUAGES = 10_000
#: Shares below this are no share at all; whether small ones stay, the penalised likelihood decides.
NO_SHARE = 1e-3
_no_letters = regex.compile(r"\P{L}+")


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's lower-cased letters, runs of other characters as one space."""
    letters = _no_letters.sub(" ", text.lower()).strip() if text else ""
    if not letters:
        return np.empty(0, np.uint32)
    b = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def sample(docs: DataFrame, lang_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of the text: the same in every run."""
    rate = cut(docs.groupBy(F.col(lang_col).alias("_lang")).agg((F.lit(per_language) / F.count(F.lit(1))).alias("_rate")))
    side = F.broadcast(rate) if rate.count() <= MOST_LANGUAGES else rate
    found = docs.join(side, F.col(lang_col) == F.col("_lang")).where(F.pmod(F.xxhash64("text", "id"), F.lit(1_000_003)) < F.col("_rate") * 1_000_003)
    return found.drop("_lang", "_rate")


class Mixture:
    """Trigram distributions of languages, and the mixture of them that explains a text best."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = PENALTY):
        self.languages, self.penalty = languages, penalty
        smooth = counts + SMOOTHING
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T)  # bucket x language

    def fit(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the columns of ``p`` by expectation-maximisation, and the log likelihood."""
        k = p.shape[1]
        if k == 1:
            return np.ones(1), float(n @ np.log(p[:, 0]))
        share, weight = np.full(k, 1 / k), n / n.sum()
        for _ in range(ITERATIONS):
            new = share * ((weight / (p @ share)) @ p)
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        share /= share.sum()
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The languages kept and their proportions, largest first; none for a text without letters.

        All languages are fitted, those of no weight go, and then the smallest goes as long as the
        likelihood, less ``penalty * log(trigrams)`` for each language, does not fall.
        """
        buckets, n = np.unique(trigrams(text), return_counts=True)
        if not len(buckets) or not self.languages:
            return [], np.empty(0)
        p, cost = self.p[buckets], self.penalty * np.log(n.sum() + 1)
        share, _ = self.fit(p, n)
        keep = np.argsort(-share, kind="stable")
        keep = keep[share[keep] >= min(NO_SHARE, share.max())]
        share, best = self.fit(p[:, keep], n)
        while len(keep) > 1:
            less = np.delete(np.arange(len(keep)), np.argmin(share))
            s, value = self.fit(p[:, keep[less]], n)
            if value + cost < best:
                break
            keep, share, best = keep[less], s, value
        order = np.argsort(-share, kind="stable")
        return keep[order].tolist(), share[order]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, penalty: float = PENALTY) -> Mixture:
    """Fits the trigram counts of each value of ``lang`` on a bounded sample of rows ``(id, text, lang)``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in rows(batches):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(used)), pa.array(used, pa.int32()), pa.array(n[used])], names=["lang", "bucket", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = sample(known, "lang", per_language).mapInArrow(count, "lang string, bucket int, n long")
    got = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    row = {x: i for i, x in enumerate(languages)}
    counts[[row[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Mixture(languages, counts, penalty)


def _model(docs: DataFrame, folds: int, held: int, per_language: int, penalty: float, id_col: str, text_col: str, lang_col: str) -> Mixture:
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return learn(named.where(fold(F.col("id"), folds) != held), per_language, penalty)


def identify(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Languages of every row of ``docs``.

    The model (trigram distributions of the values of ``lang_col``) is fitted on about
    ``per_language`` rows of each language whose crc32 fold is not ``held``; ``id_col`` and
    ``lang_col`` are not inputs of a prediction.  Rows: ``id_col, held_out, lang_pred`` (the language
    with the largest share, ``und`` for null texts and texts without letters, or if nothing could
    be learned), ``score`` (that share, 0 for ``und``), ``languages`` and ``shares`` (the selected set, the
    largest first).  Ties go to the language that sorts first; repeated rows all come back; an empty table
    gives no rows; a null id is in fold 0; other columns are not looked at.
    """
    model = _model(docs, folds, held, per_language, penalty, id_col, text_col, lang_col)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found = [model.infer(t) for t in b.column(1).to_pylist()]
            names = [[model.languages[k] for k in keep] for keep, _ in found]
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array([x[0] if x else NONE for x in names], pa.string()), pa.array([float(s[0]) if len(s) else 0.0 for _, s in found]), pa.array(names, pa.list_(pa.string())), pa.array([s.tolist() for _, s in found], pa.list_(pa.float64()))],
                names=["id", "held_out", "lang_pred", "score", "languages", "shares"],
            )

    schema = "id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (fold(F.col(id_col), folds) == held).alias("held_out"))
    return picked.mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which a language is found, unchanged; rows that ``identify`` calls ``und`` go.

    Null and empty texts and texts without letters go, and all rows where nothing can be learned (no row with a
    language); repeated rows stay or go together; a null id is an id like any other; an empty table gives no rows.
    """
    model = _model(docs, folds, held, per_language, penalty, id_col, text_col, lang_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text_col):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([bool(model.infer(t)[0]) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
