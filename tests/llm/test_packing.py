import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortline.llm import packing

SCHEMA = "doc_id long, text string, piece string, length string, id int"
ODD = ["<|endoftext|> a<|startoftext|>b it's 12 \x1c x\x1fy É́ İSTANBUL ΣΑΣ", "don't I'LL'VE a\x85b c d", "x" * 700 + " " + "y." * 300, "Word, word. WORD!!! a*** 3,5% … é! ™!", "", "  \n", None]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def whole(t):
    return np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, texts):
    """Pieces make the documents' ids again, and sequences have neither gaps nor overlaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in texts.items():
        ids = whole(text)
        parts = sorted(by_doc[key], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in parts] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts]
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(by_sequence)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    made = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert made <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_odd_texts_repeats_and_null_ids(spark):
    data = [(k, t, "x", None, 1) for k, t in enumerate(ODD)]
    rows = packing.pack(spark.createDataFrame(data, SCHEMA)).collect()
    check(rows, dict(enumerate(ODD)))
    twice = packing.pack(spark.createDataFrame([(1, "a", "", "", 0), (1, "a", "", "", 0), (None, "b", "", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.length, r.offset) for r in twice) == sorted((r.doc_id or -1, 2, o) for r, o in zip(twice, (r.offset for r in twice), strict=True)) and {r.offset for r in twice} == {0, 2, 4}
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_at_capacity(spark):
    for n, lengths in ((2047, [2048]), (2048, [2048, 1]), (4095, [2048, 2048])):
        rows = packing.pack(spark.createDataFrame([(1, "a " * n, "", "", 0)], SCHEMA)).collect()
        assert sorted((r.length for r in rows), reverse=True) == lengths


def encoded(encoder, many):
    ids, ends = encoder.encode(pa.array(many, pa.string()))
    return [x.tolist() for x in np.split(ids, ends)[:-1]]


def test_remembering_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    for _ in range(2):
        assert encoded(encoder, ODD) == [whole(t).tolist() for t in ODD]
    assert encoded(encoder, []) == []
    assert not any(len(c) > packing.LONGEST for c in encoder.known)


def test_every_letter_before_punctuation():
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    letters = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.isalpha()]
    many = [f"{x}{c}{packing.TAIL[k % len(packing.TAIL)]}" for k, c in enumerate(letters) for x in ("", "H")]
    for k in range(0, len(many), 20_000):
        plain = encoder.tokenizer.encode_batch_fast(many[k : k + 20_000], add_special_tokens=False)
        assert encoded(encoder, many[k : k + 20_000]) == [[*x.ids, 0] for x in plain]


def test_letters_that_compose_or_decompose():
    rng = random.Random(3)
    pool = "aAbBhHjJtTwWyYİIiıſKÅ\u0331\u030c\u0308\u030a\u0307\u0301éÉßΣσς'<|>.,;:!?|*&%$#()- \xa0\u2003\t\u0958\u0959१2½①s"
    many = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    many += ["BELEDİYESİ.", "J\u030c H\u0331.", "<|ENDOFTEXT|> <|endoftext|>x. A<|endoftext|>."]
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    assert encoded(encoder, many) == [[*encoder.plain(t).tolist(), 0] for t in many]


def test_fullest_bins_close_and_little_room_is_lost():
    """Lengths as in the corpus: full pieces, long and short ones; one sequence in 2,000 lost at most."""
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(6.6, 1.0, 300_000).astype(int) + 1, 2048)
    packer = packing.Packer()
    for k in range(0, len(lengths), packing.RUN):
        for n in np.sort(lengths[k : k + packing.RUN])[::-1].tolist():
            packer.place(n)
            assert packer.count <= packing.OPEN_BINS
    assert packer.made > packing.OPEN_BINS and packer.closed > 0
    assert packer.made <= 1.0005 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("bins", [1, 3, 1000])
def test_best_fit_against_a_plain_one(bins):
    rng = random.Random(bins)
    packer, open_, made = packing.Packer(100, bins), [], 0
    for _ in range(3000):
        n = rng.randint(1, 100)
        fits = [f for _, f in open_ if f >= n]
        number, offset = packer.place(n)
        if fits:
            mine = next(x for x in open_ if x[0] == number)
            assert mine[1] == min(fits) and offset == 100 - mine[1]
            open_.remove(mine)
        else:
            assert (number, offset) == (made, 0)
            mine, made = (made, 100), made + 1
        if mine[1] - n:
            open_.append((number, mine[1] - n))
        if len(open_) > bins:  # the fullest closes; among equals the packer chooses
            low = min(f for _, f in open_)
            gone = next(x for x in open_ if x[1] == low and x[0] not in packer.bins[low])
            open_.remove(gone)
        assert sorted(open_) == sorted((b, f) for f, own in enumerate(packer.bins) for b in own)
