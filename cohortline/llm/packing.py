"""Best-fit packing of token sequences, in bounded space."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, rows

#: Tokens of a sequence, the id that ends a document and the open bins of a packer.
CAPACITY, END_ID, OPEN_BINS = 2048, 0, 4096
#: Sequences that a packer makes on average, and pieces that arrive longest first before the next such run.
SEQUENCES, RUN = 16384, 8192
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers in a task and from task to task, and the longest such word in characters.
REMEMBERED, STAYING, LONGEST = 400_000, 100_000, 256
#: ASCII punctuation that is cut off the end of a word before the word is looked up.
TAIL = ".,;:!?|*&%$#"
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as unsigned 32-bit numbers.

    The vocabulary's tokenizer drops white space and never joins text across it, so a text's ids are
    those of its chunks between ASCII white space, one after another.  The different chunks of many texts are
    found at once, each is a word and the punctuation after it, and the ids of short words are remembered
    as rows of a table.  New words are encoded together and their ids parted again.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = separator, self.tokenizer.token_to_id(separator)
        # the same vocabulary and merges without normalising and patterns, for words that these leave as they are
        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        suffix, ids = bare["model"]["end_of_word_suffix"], bare["model"]["vocab"]
        self.last = np.zeros(max(ids.values()) + 1, bool)
        self.last[[k for t, k in ids.items() if t.endswith(suffix)]] = True
        # row 0 is no token, row 1 the end of a document
        self.known: dict[str, int] = {"": 0}
        self.start, self.size, self.ids = np.array([0, 0]), np.array([0, 1]), np.array([END_ID], "<u4")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def cut(chunks: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
        """Each chunk's word, and the punctuation after it where the tokenizer surely parts them too.

        A-Z are lowered in ASCII chunks alone: in others the tokenizer composes letters before it lowers
        them.  A chunk that may hold a special token, which the tokenizer looks for first, stays as it is.
        """
        same = pc.or_(pc.not_equal(pc.binary_length(chunks), pc.utf8_length(chunks)), pc.match_substring(chunks, "<|"))
        low = pc.if_else(same, chunks, pc.ascii_lower(chunks))
        at, raw = _parts(low)
        left = pc.binary_length(pc.ascii_rtrim(low, characters=TAIL)).to_numpy()
        final = raw[np.minimum(at[:-1] + np.maximum(left - 1, 0), len(raw) - 1)]
        after = np.diff(at) - left
        parted = (after > 0) & (left > 0)
        odd = np.flatnonzero(parted & (final > 127))
        parted &= _ALNUM[final]
        for i, word in zip(odd.tolist(), low.take(pa.array(odd)).to_pylist(), strict=True):
            parted[i] = stays_letter(word.rstrip(TAIL)[-1])
        after = np.where(parted, after, 0)
        return _strings(raw, at[:-1], np.diff(at) - after), _strings(raw, at[1:] - after, after)

    @staticmethod
    def simple(word: str) -> bool:
        """Whether a word is lower-case Latin letters in composed form: one run of letters that nothing changes."""
        return word.isalpha() and (word.isascii() or max(word) < "\u0250" and is_normalized("NFC", word)) and word == word.lower()

    def learn(self, words: list[str]) -> None:
        """Adds these words to the table; those that are too long to be remembered come last."""
        simple, other, whole = [], [], []
        for w in words:
            (simple if self.simple(w) else whole if "<|" in w or len(w) > LONGEST else other).append(w)
        simple.sort(key=len)  # long ones last
        if simple and len(simple[-1]) > LONGEST:
            whole += [w for w in simple if len(w) > LONGEST]
            simple = [w for w in simple if len(w) <= LONGEST]
        whole.sort(key=len)
        found = [*self._learn(simple, "\n", self.bare), *self._learn(other, self.separator, self.tokenizer)]
        each = [self.plain(w) for w in whole]
        found += [(x, np.array([len(x)])) for x in each]
        ids, sizes = (np.concatenate(c) for c in zip(*found, strict=True))
        self.known.update(zip((*simple, *other, *whole), range(len(self.size), len(self.size) + len(sizes)), strict=True))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size, self.ids = np.concatenate((self.size, sizes)), np.concatenate((self.ids, ids))

    def _learn(self, words: list[str], separator: str, tokenizer: Tokenizer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Encodes words together; the ids of all and the number of each, parted at word ends or separators."""
        for k in range(0, len(words), 2000):
            ids = np.array(tokenizer.encode_batch_fast([separator.join(words[k : k + 2000])], add_special_tokens=False)[0].ids, "<u4")
            if tokenizer is self.bare:
                yield ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            else:
                parts = np.flatnonzero(ids == self.mark)
                yield np.delete(ids, parts), np.diff(parts, prepend=-1, append=len(ids)) - 1

    def keep(self, most: int, latest: bool = True) -> None:
        """Drops all words but the latest ``most``, or the earliest, which are the frequent ones, and, of these, the long ones."""
        start = max(1, len(self.known) - most) if latest else 1
        held = [(w, i) for w, i in islice(self.known.items(), start, start + most) if len(w) <= LONGEST]
        rows_ = np.array([0, 1, *(i for _, i in held)])
        self.ids, self.size = self.ids[ragged(self.start[rows_], self.size[rows_])], self.size[rows_]
        self.start = np.cumsum(self.size) - self.size
        self.known = {"": 0} | {w: k for k, (w, _) in enumerate(held, 2)}

    def rows(self, words: pa.StringArray) -> np.ndarray:
        """The row of each word in the table."""
        coded = words.dictionary_encode()
        many = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.known.get, many))
        new = [w for w, i in zip(many, at, strict=True) if i is None]
        if new:
            self.learn(new)
            at = [self.known[w] if i is None else i for w, i in zip(many, at, strict=True)]
        return np.array(at, np.int64)[coded.indices.to_numpy()]

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by the end id, and where each text ends; null is empty."""
        split = pc.ascii_split_whitespace(column.fill_null(""))
        ends, coded = split.offsets.to_numpy()[1:] - split.offsets[0].as_py(), split.flatten().dictionary_encode()
        word, tail = (self.rows(part) for part in self.cut(coded.dictionary))
        # the ids of each different chunk, the end of a document as the last
        both = np.stack((np.append(word, 1), np.append(tail, 0)), axis=1).ravel()
        sizes = self.size[both]
        ids, size = self.ids[ragged(self.start[both], sizes)], sizes.reshape(-1, 2).sum(1)
        chunk = np.insert(coded.indices.to_numpy(), ends, len(word))
        each = size[chunk]
        out = ids[ragged((np.cumsum(size) - size)[chunk], each)]
        if len(self.known) > REMEMBERED:  # the older half goes; what is frequent is soon back
            self.keep(REMEMBERED // 2)
        elif len(next(reversed(self.known))) > LONGEST:
            self.keep(len(self.known))
        return out, np.cumsum(each)[ends + np.arange(len(ends))]


def stays_letter(c: str) -> bool:
    """Whether normalising leaves this last character of a word a letter: not so if it parts a mark from it."""
    return c.isalpha() and is_normalized("NFC", c) and c.lower().isalpha()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _parts(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings."""
    _, offsets, raw = column.buffers()
    return np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64), np.frombuffer(raw if raw is not None and raw.size else b"\0", np.uint8)


def _strings(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw[ragged(starts, sizes)]))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)``: each document's ids and the end id, cut where longer than ``capacity``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in rows(batches, most_rows=4096):
            ids, ends = encoder.encode(b.column(1))
            raw, first = memoryview(ids.tobytes()), 0
            out: list[tuple] = []
            for key, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                for i, at in enumerate(range(first, end, capacity)):
                    n = min(capacity, end - at)
                    out.append((key, i, at - first, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                first = end
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])
        encoder.keep(STAYING, latest=False)  # the worker lives on, perhaps for other work

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class Packer:
    """Online best-fit with at most ``open_bins`` open bins.

    Bit ``f`` of ``free`` is set while an open bin has exactly ``f`` tokens free.  A piece goes to the
    open bin with the least room that it fits in, found by shifting the bitset, or to a new bin; one bin
    more than allowed closes the fullest open bin.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.count, self.made, self.closed = 0, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.free ^= 1 << room
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of 1 to ``capacity`` tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.closed += 1
        return number, self.capacity - room


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens, one row per piece.

    A document's tokens are its ids by the tokenizer file ``path`` (a parameter; special tokens are not
    added) and then id 0; only documents longer than ``capacity`` are cut, each piece but the last being
    full.  Rows: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``; offsets in a
    sequence have no gaps.  Pieces are dealt to packers of about ``SEQUENCES`` sequences each and arrive
    there in runs of about ``RUN``, each run longest first (a sort that spills), so that a run's short
    pieces fill what its long ones leave before the fullest bins have to close.
    Null and empty texts are documents of one token; repeated rows and null ids are packed as often as
    they come; an empty table gives no rows; no other column is looked at.
    """
    made = cut(pieces(docs, path or public_tokenizers.path(VOCABULARY), capacity, id_col, text_col))
    total, number = made.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    packers = max(1, -(-total // (capacity * SEQUENCES)))
    runs = max(1, -(-number // (packers * RUN)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                number, offset = zip(*map(packer.place, b.column(3).to_pylist()), strict=True)
                yield pa.record_batch([*b.columns, pa.array([base + n for n in number], pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    turn = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(runs))
    dealt = made.repartition(packers).sortWithinPartitions(turn, F.desc("length"), id_col, "piece", "ids_crc32")
    return dealt.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
