"""Alignment of the tokens of two tokenizers, by a dictionary of their groups."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, delete, rows, shared_dir

BYTES, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text of a slice, unless one text is longer, and units that a worker remembers after one.
SLICE, REMEMBERED = 16_000_000, 400_000
#: Characters of a unit from which on it is encoded by itself, and by a tokenizer whose time does not grow with the square.
LONG = 256
#: Units encoded together.
TOGETHER = 2000
#: A text in parts that both tokenizers encode as they do in the text: a part ends before a blank or a line feed between
#: other characters than white space.  No token of either goes over that place, and none of their patterns looks over it.
UNIT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
_pairs: dict[tuple, Pair] = {}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ranges of ``sizes`` one after another."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte of their value, which compresses well where they are small."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def overlaps(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions of two lists of token sizes over the same bytes whose ranges overlap."""
    i = j = 0
    left, right, out = int(a[0]), int(b[0]), []
    while True:
        out.append((i, j))
        if left <= right:
            i, step = i + 1, left
            if left == right:
                j += 1
                if i < len(a):
                    right += int(b[j])
            if i == len(a):
                return out
            left += int(a[i])
        else:
            j += 1
            right += int(b[j])


class Pair:
    """Two tokenizers, and what a worker knows of units: their token numbers, groups and the groups' text."""

    def __init__(self, bytes_path: str, ranks_path: str, pieces_path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(bytes_path)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = self._entries(self.slow.get_vocab())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.forget()

    @staticmethod
    def _entries(vocab: dict[str, int]) -> list[bytes]:
        """The bytes of each entry: printable bytes stand for themselves, the others for characters from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        out = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            out[i] = bytes(byte[c] for c in text)
        return out

    @classmethod
    def of(cls, *paths: str) -> Pair:
        if paths not in _pairs:
            _pairs[paths] = cls(*paths)
        return _pairs[paths]

    def forget(self) -> None:
        """Starts anew: nothing is known."""
        self.known: dict[str, int] = {}
        self.groups: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.empty((0, 3), np.int64)  # tokens of both and groups of each unit; -1: its bytes differ
        self.start, self.flat = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode_a(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if len(text) < LONG else self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_b(self, text: str) -> list[int]:
        """Ids of a unit; B puts a blank before a text, which is the unit's own or goes again."""
        return self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def learn(self, units: list[str]) -> None:
        """Encodes new units, many of them at once where they end without white space and are short."""
        plain = [u for u in units if len(u) < LONG and not u[-1].isspace()]
        parts = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)] + [[u] for u in units if len(u) >= LONG or u[-1].isspace()]
        for part in parts:
            self._learn(part)

    def _learn(self, units: list[str]) -> None:
        whole = "".join(units)
        a = np.array(self.fast.encode_ordinary(whole) if len(units) > 1 else self.encode_a(whole), np.int64)
        b = np.array(self.encode_b(whole), np.int64)
        raw = [u.encode() for u in units]
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(raw) or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != b"".join(raw):
            if len(units) > 1:
                half = len(units) // 2
                self._learn(units[:half])
                self._learn(units[half:])
                return
            self._add(units, [""], np.array([[-1, -1, 0]]), [])
            return
        ends = np.cumsum([len(x) for x in raw])
        ea, eb = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(ea, eb, assume_unique=True)
        at, bt = (np.searchsorted(e, common, "right").tolist() for e in (ea, eb))
        sa, sb, i, j, found = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, []
        for x, y in zip(at, bt, strict=True):
            found.append(f"{sa[i] if x - i == 1 else ','.join(sa[i:x])}|{sb[j] if y - j == 1 else ','.join(sb[j:y])}")
            i, j = x, y
        each = [np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (ea, eb, common)]
        last = np.cumsum(each[2]).tolist()
        self._add(units, [";".join(found[i:j]) for i, j in zip([0, *last], last, strict=False)], np.stack(each, 1), found)

    def _add(self, units: list[str], text: list[str], counts: np.ndarray, found: list[str]) -> None:
        first = len(self.text)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.text += text
        groups = self.groups
        own = np.array([groups.setdefault(g, len(groups)) for g in found], np.int64)
        self.new.append((counts, own))

    def rows(self, units: list[str]) -> np.ndarray:
        """The number of each unit."""
        at = list(map(self.known.get, units))
        new = list(dict.fromkeys(u for u, i in zip(units, at, strict=True) if i is None))
        if new:
            self.new: list[tuple[np.ndarray, np.ndarray]] = []
            self.learn(new)
            counts, own = (np.concatenate(x) for x in zip(*self.new, strict=True))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts[:, 2]) - counts[:, 2]))
            self.counts, self.flat = np.concatenate((self.counts, counts)), np.concatenate((self.flat, own))
            at = [self.known[u] if i is None else i for u, i in zip(units, at, strict=True)]
        return np.array(at, np.int64)


SENT = "slice long, kind int, id long, n_a long, n_b long, n_groups long, sha string, idx long, key string, n long, one binary, two binary"
_NAMES = [x.split()[0] for x in SENT.split(", ")]
_TYPES = dict(zip(_NAMES, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True))


def batch(n: int, /, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], names=_NAMES)


def encoded(paths: tuple[str, ...], slice_bytes: int = SLICE) -> Callable:
    """Encodes slices of texts.  Of each: a row for each text (kind 0: its units and how often it has them), one that has the
    groups of its units (kind 1), and one for each of its groups (kind 2: how often it comes)."""

    def flush(pair: Pair, held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        units = [u for _, u, _ in held]
        sizes = np.array([len(u) for u in units])
        used, at = np.unique(np.concatenate(units), return_inverse=True)
        key, times = np.unique(np.repeat(np.arange(len(held)), sizes) * len(used) + at, return_counts=True)
        doc, unit = key // max(1, len(used)), key % max(1, len(used))
        bounds = np.searchsorted(doc, np.arange(len(held) + 1))
        size = pair.counts[used, 2]
        flat = pair.flat[ragged(pair.start[used], size)]
        groups, local = np.unique(flat, return_inverse=True)
        n = np.bincount(local, np.repeat(np.bincount(unit, times, len(used)), size), len(groups)).astype(np.int64)
        counts = [pair.counts[u].sum(0) for u in units]
        some = [(planes(np.diff(unit[i:j], prepend=0)), planes(times[i:j])) for i, j in zip(bounds, bounds[1:], strict=False)]
        yield batch(len(held), slice=[number] * len(held), kind=[0] * len(held), id=[i for i, _, _ in held], n_a=[int(c[0]) for c in counts], n_b=[int(c[1]) for c in counts], n_groups=[int(c[2]) for c in counts], sha=[s for _, _, s in held], one=[x for x, _ in some], two=[y for _, y in some])
        yield batch(1, slice=[number], kind=[1], one=[planes(size)], two=[planes(local)])
        names = np.array(list(pair.groups), object)[groups] if len(groups) else []
        for k in range(0, len(groups), 100_000):
            part = slice(k, k + 100_000)
            m = len(groups[part])
            yield batch(m, slice=[number] * m, kind=[2] * m, idx=np.arange(k, k + m), key=pa.array(names[part], pa.string()), n=n[part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, n, number = Pair.of(*paths), [], 0, TaskContext.get().partitionId() << 33
        for b in rows(batches):
            each = [UNIT.findall(" " + t) if t else [] for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in each])
            every = pair.rows([u for x in each for u in x])  # new units of many texts are encoded together
            for key, size, units in zip(b.column(0).to_pylist(), pc.binary_length(b.column(1).fill_null("")).to_pylist(), np.split(every, ends[:-1]), strict=True):
                if (pair.counts[units, 0] < 0).any():
                    units = units[:0]  # B's blank is a character of its own too, which it takes for a blank: the bytes are fewer
                sha = hashlib.sha256(";".join(map(pair.text.__getitem__, units.tolist())).encode()).hexdigest() if len(units) else ""
                held.append((key, units, sha))
                n += size
                if n >= slice_bytes or len(held) >= 100_000:
                    yield from flush(pair, held, number)
                    held, n, number = [], 0, number + 1
            if len(pair.known) > REMEMBERED:
                if held:
                    yield from flush(pair, held, number)
                    held, n, number = [], 0, number + 1
                pair.forget()
        if held:
            yield from flush(pair, held, number)
        if len(pair.known) > REMEMBERED // 4:
            pair.forget()  # the worker lives on, perhaps for other work

    return run


def expanded(paths: tuple[str, ...]) -> Callable:
    """From groups ``(gid, key, freq)``: ``(gid, a, b, m, c)``, each pair of ids that a group links, how often it does, and that times ``freq``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(*paths)
        for got in batches:
            for k in range(0, got.num_rows, 10_000):
                b = got.slice(k, 10_000)
                out: dict[tuple[int, int, int], int] = {}
                for gid, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    one, two = (list(map(int, side.split(","))) for side in key.split("|"))
                    links = overlaps(pair.a_size[one], pair.b_size[two]) if len(one) > 1 and len(two) > 1 else [(i, j) for i in range(len(one)) for j in range(len(two))]
                    for i, j in links:
                        out[gid, one[i], two[j]] = out.get((gid, one[i], two[j]), 0) + 1
                freq = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
                columns = ([g for g, _, _ in out], [x for _, x, _ in out], [y for _, _, y in out], list(out.values()), [freq[g] * m for (g, _, _), m in out.items()])
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["gid", "a", "b", "m", "c"])

    return run


def group_values(groups: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """``(gid, best, total)`` of the distinct groups (gid, key, freq): links that are the highest of their B id, and the sum of the links' counts."""
    links = cut(groups.mapInArrow(expanded(paths), "gid long, a long, b long, m long, c long"))
    pairs = cut(links.groupBy("a", "b").agg(F.sum("c").alias("count")))
    highest = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("highest")))  # a row for an entry of B's vocabulary
    known = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("is_best"))
    return links.join(known, ["a", "b"]).groupBy("gid").agg(F.sum(F.col("m") * F.col("is_best")).alias("best"), F.sum(F.col("m") * F.col("count")).alias("total"))


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def told(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a slice's texts, from the values of its groups."""
    kind = texts["kind"].to_numpy()
    best, total = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers["idx"].to_numpy()
    best[at], total[at] = answers["best"].to_numpy(), answers["total"].to_numpy()
    unit = int(np.flatnonzero(kind == 1)[0])
    size, flat = numbers(texts["one"][unit].as_py()), numbers(texts["two"][unit].as_py())
    best, total = sums(best[flat], size), sums(total[flat], size)
    own = texts.filter(pa.array(kind == 0))
    found = []
    for one, two in zip(own["one"], own["two"], strict=True):
        units, times = np.cumsum(numbers(one.as_py())), numbers(two.as_py())
        found.append((int((best[units] * times).sum()), int((total[units] * times).sum())))
    n_a, n_b, n_groups = (own[c].to_numpy() for c in ("n_a", "n_b", "n_groups"))
    columns = (own["id"], n_a, n_b, n_groups, n_a + n_b - n_groups, [x for x, _ in found], [y for _, y in found], own["sha"])
    kinds = (pa.int64(),) * 7 + (pa.string(),)
    return pa.table([c.cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, paths: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """Aligns the tokens of a blank and each text by a byte-level tokenizer A and a piece tokenizer B.

    Byte offsets where tokens of both end cut them into groups; in a group all tokens are linked whose bytes overlap.  An
    id pair counts how many links of the corpus hold it.  Rows: ``id_col, n_a, n_b, n_groups, n_links, n_best`` (links
    whose count is the highest of their B id, ties included), ``count_sum`` (over links) and ``groups_sha256`` (of
    ``a1,a2|b1;a3|b2,b3``).  ``paths``: A's file, its ranks, B's model.

    Texts fall into units that both tokenizers encode by themselves; a worker encodes a unit once.  Texts are taken
    in slices of bounded bytes, whose distinct groups are written with their frequencies.  Over the corpus each distinct
    group is expanded to its links once, which count its frequency; what that gives for a group is joined back to
    the groups of the slices, and meets the texts of a slice there.  A frequent group makes a row for each slice only.

    Null and empty texts, and those with B's character for a blank, whose bytes B changes, have zeros and an empty
    digest; special tokens inside texts are plain text; repeated rows and null ids come as often as they are; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    paths = tuple(paths or map(public_tokenizers.path, (BYTES, RANKS, PIECES)))
    place = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    try:
        picked.mapInArrow(encoded(paths, slice_bytes), SENT).write.option("compression", "zstd").parquet(f"{place}/slices")
        sent = spark.read.parquet(f"{place}/slices")
        own = sent.where("kind = 2").select("slice", "idx", "key", "n")
        sent_groups = own.groupBy("key").agg(F.sum("n").alias("freq"))
        sent_groups.withColumn("gid", F.monotonically_increasing_id()).select("gid", "key", "freq").write.option("compression", "zstd").parquet(f"{place}/groups")
        groups = spark.read.parquet(f"{place}/groups")
        values = groups.select("gid", "key").join(group_values(groups, paths), "gid").select("key", "best", "total")
        answers = own.select("slice", "idx", "key").join(values, "key").select(F.col("slice").alias("own"), "idx", "best", "total")
        texts = sent.where("kind < 2").select("slice", "kind", "id", "n_a", "n_b", "n_groups", "sha", "one", "two")
        out = cut(texts.groupBy("slice").cogroup(answers.groupBy("own")).applyInArrow(told, RESULT))
    finally:
        delete(spark, place)
    return out.withColumnRenamed("id", id_col)
