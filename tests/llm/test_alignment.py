import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cohortline.llm import alignment, catalog

SCHEMA = "doc_id long, text string, n_a string, idx int, key int"
PATHS = tuple(map(public_tokenizers.path, (alignment.BYTES, alignment.RANKS, alignment.PIECES)))


def byte_of():
    """Characters of the byte-level vocabulary, by the rule that printable bytes stand for themselves."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute(rows):
    """Rows by the definition: whole texts encoded, all pairs of tokens compared, counts by pair of ids."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    byte, name = byte_of(), {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each, count = [], Counter()
    for key, text in rows:
        own = (" " + text).encode() if text else b""
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta, tb = [bytes(byte[c] for c in name[i]) for i in ia], [piece(i) for i in ib]
        if b"".join(ta) != own or b"".join(tb) != own:
            ia, ib, ta, tb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        common, groups, links, i, j = sorted(set(ea) & set(eb)), [], [], 0, 0
        for end in common:
            x, y = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            links += [(ia[p], ib[q]) for p in range(i, x) for q in range(j, y) if max(ea[p] - len(ta[p]), eb[q] - len(tb[q])) < min(ea[p], eb[q])]
            i, j = x, y
        count.update(links)
        each.append((key, ia, ib, groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(k, len(ia), len(ib), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, ia, ib, g, x in each]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two  blanks "), (6, "a\r\nb\rc \r d"), (7, "tab\tend\t"), (8, "x▁y"), (9, "<|endoftext|> <s> </s> <unk> <0x41>"), (10, "Ünïcodé 日本語 🙂🙃 é"), (11, " no break line 　wide"),
    (12, "don't we'll I'VE"), (13, "a" * 700 + " " + "ab" * 400), (14, "\nfirst"), (15, "end \n x"), (16, "twice"), (16, "twice"), (None, "no id"), (17, "\x00\x1c \x85z"), (18, "1234567890 12 3.14,15;16"), (19, "▁"), (20, "\n\n\n   \n deep"),
]


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_texts_against_the_definition(spark):
    docs = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in ODD], SCHEMA).repartition(3)
    assert collected(alignment.align(docs)) == sorted(brute(ODD), key=str)
    assert collected(alignment.align(docs, slice_bytes=40)) == sorted(brute(ODD), key=str)
    assert alignment.align(docs.limit(0)).count() == 0


def test_query_against_the_definition(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = catalog.op11_alignment(spark, sf_dir)
    assert collected(df) == sorted(brute(rows), key=str)
    assert df.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]


@pytest.mark.parametrize("long", [False, True])
def test_very_long_words(spark, long):
    text = " ".join(["x" * 40_000, "y", "word " * 20_000]) if long else "z" * 300
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert collected(alignment.align(docs)) == brute([(1, text)])


def test_units_encode_as_whole_texts(spark, sf_dir):
    pair = alignment.Pair(*PATHS)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect():
        units = alignment.UNIT.findall(" " + r.text) if r.text else []
        assert "".join(units) == (" " + r.text if r.text else "")
        assert [i for u in units for i in pair.encode_b(u)] == (pair.b.encode(r.text) if r.text else [])
        assert [i for u in units for i in pair.encode_a(u)] == (pair.slow.encode(" " + r.text).ids if r.text else [])
    assert not any("\n" in pair.b.id_to_piece(i) or "▁" in pair.b.id_to_piece(i).lstrip("▁") for i in range(pair.b.vocab_size()))


def test_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = sorted({*rng.integers(1, 30, 6).tolist(), 30}), sorted({*rng.integers(1, 30, 6).tolist(), 30})
        a, b = (np.diff(e, prepend=0) for e in ends)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ends[0][i] - a[i], ends[1][j] - b[j]) < min(ends[0][i], ends[1][j])]
        assert sorted(alignment.overlaps(a, b)) == want
