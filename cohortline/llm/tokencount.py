"""Token counts that follow edits: a tree of pre-tokens per document, re-encoded only where it was touched."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a leaf, pre-tokens whose counts a worker remembers, and the longest of these in characters.
LEAF, REMEMBERED, LONGEST = 64, 400_000, 256
#: What the registered query masks: words with a digit or an at sign.
PRIVATE, MASK = re.compile(r"[^\s]*[0-9@][^\s]*"), "[masked]"
_counters: dict[str, Counter] = {}


class Counter:
    """Pre-tokens of a text by the vocabulary's pattern, and their numbers of tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def count(self, pieces: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, long = self.known, []
        for p in set(pieces).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
            if len(p) > LONGEST:
                long.append(p)
        out = list(map(known.__getitem__, pieces))
        for p in long:
            del known[p]
        return out


class TokenTree:
    """A segment tree over leaves of pre-tokens; each node has the characters and tokens below it.

    An edit re-encodes from the white-space run or pre-token before it (a pre-token may grow, and a run of
    white space depends on what follows) up to the first old boundary after it: the pattern looks only
    ahead, so that from a common boundary on the old pre-tokens hold.  Sums change on the paths from
    the touched leaves to the root.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        pieces = counter.pattern.findall(text)
        self._fill(pieces, counter.count(pieces))

    @classmethod
    def kept(cls, leaves: list[list[str]], counts: list[list[int]], counter: Counter) -> TokenTree:
        """The tree of leaves that were counted before; nothing is encoded, and no leaf is touched yet."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        tree._set(leaves, counts)
        tree.touched = set()
        return tree

    def _fill(self, pieces: list[str], counts: list[int]) -> None:
        self._set([pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]], [counts[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]])

    def _set(self, leaves: list[list[str]], counts: list[list[int]]) -> None:
        self.leaves, self.counts = leaves, counts
        self.touched = set(range(len(leaves)))
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        empty = [0] * (self.size - len(self.leaves))
        self.chars = [0] * self.size + [sum(map(len, x)) for x in self.leaves] + empty
        self.tokens = [0] * self.size + list(map(sum, self.counts)) + empty
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf of the character at ``at`` and the leaf's first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return min(k - self.size, len(self.leaves) - 1), start

    def edit(self, a: int, b: int, new: str) -> None:
        """Puts ``new`` in place of the characters ``[a, b)``."""
        if not 0 <= a <= b <= self.chars[1]:
            raise ValueError("the edit is outside of the text")
        if not self.chars[1]:
            pieces = self.counter.pattern.findall(new)
            self.encoded += len(pieces)
            self._fill(pieces, self.counter.count(pieces))
            return
        first, start = self._leaf(max(a - 1, 0))
        last, _ = self._leaf(min(b, self.chars[1] - 1))
        while True:
            window = [p for leaf in self.leaves[first : last + 1] for p in leaf]
            ends = list(accumulate(map(len, window)))
            j = bisect_left(ends, max(a - start, 1))  # the piece that ends at or holds the character before the edit
            while j > 0 and (ends[j] >= a - start or window[j].isspace()):
                j -= 1
            if first > 0 and (j == 0 or window[j].isspace()):
                first -= 1
                start -= sum(map(len, self.leaves[first]))
                continue
            begin = ends[j] - len(window[j])
            old, cut = "".join(window[j:]), a - start - begin
            stop = b - start - begin
            text = old[:cut] + new + old[stop:]
            shift = len(text) - len(old)
            old_ends = {e - begin + shift: k for k, e in enumerate(ends) if e - begin >= stop}
            pieces, after = [], None
            for m in self.counter.pattern.finditer(text):
                if last < len(self.leaves) - 1 and m.end() >= len(text):
                    break
                pieces.append(m[0])
                if m.end() >= cut + len(new) and m.end() in old_ends:
                    after = old_ends[m.end()]
                    break
            if after is None and last < len(self.leaves) - 1:
                last += 1
                continue
            break
        after = len(window) - 1 if after is None else after
        counts = [c for leaf in self.counts[first : last + 1] for c in leaf]
        self.encoded += len(pieces)
        window[j : after + 1], counts[j : after + 1] = pieces, self.counter.count(pieces)
        self._put(first, last, window, counts)

    def _put(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        n = last - first + 1
        if len(pieces) > 4 * LEAF * n:  # leaves have grown too large: make all anew from the counts at hand
            before, behind = range(first), range(last + 1, len(self.leaves))
            self._fill([p for k in before for p in self.leaves[k]] + pieces + [p for k in behind for p in self.leaves[k]], [c for k in before for c in self.counts[k]] + counts + [c for k in behind for c in self.counts[k]])
            return
        step = -(-len(pieces) // n)
        for i in range(n):
            own, k = slice(i * step, (i + 1) * step), self.size + first + i
            self.leaves[first + i], self.counts[first + i] = pieces[own], counts[own]
            self.touched.add(first + i)
            chars, tokens = sum(map(len, pieces[own])) - self.chars[k], sum(counts[own]) - self.tokens[k]
            while k:
                self.chars[k] += chars
                self.tokens[k] += tokens
                k //= 2


def masks(text: str) -> list[tuple[int, int, str]]:
    """Edits ``(from, to, new)`` that mask words with digits or at signs, the last one first."""
    return [(*m.span(), MASK) for m in PRIVATE.finditer(text)][::-1]


def count(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = masks, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every row of ``docs`` before and after edits.

    ``edits`` gives the edits of a text in the order in which they are made, each in characters of the text
    as it is then.  Rows: ``id_col, n_tokens, n_edits, n_tokens_after, n_pieces`` (pre-tokens before)
    and ``n_reencoded`` (pre-tokens encoded again for the edits).  Null and empty texts have no tokens;
    repeated rows all come back, and null ids; an empty table gives no rows; no other column is looked at.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in rows(batches):
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = TokenTree(text or "", counter)
                before, pieces, todo = tree.total, sum(map(len, tree.leaves)), edits(text) if text else []
                for edit in todo:
                    tree.edit(*edit)
                out.append((key, before, len(todo), tree.total, pieces, tree.encoded))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_reencoded"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, n_tokens long, n_edits long, n_tokens_after long, n_pieces long, n_reencoded long").withColumnRenamed("id", id_col)
