import random

import public_tokenizers
import pytest

from cohortline.llm import catalog, tokencount

SCHEMA = "doc_id long, text string, n_tokens string, id int"
BITS = [" ", "  ", "\n", "a", "'s", "'", "12", "é", "...", "word", " x\n\n", "don't", "　", "@"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(public_tokenizers.path(tokencount.VOCABULARY))


def plain(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_random_edits_against_full_encoding(counter):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(rng.choice((0, 3, 40, 900))))
        tree = tokencount.TokenTree(text, counter)
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice((0, 0, 1, 2, 5, 30, 400)))
            new = "".join(rng.choice(BITS) for _ in range(rng.choice((0, 1, 2, 5, 300))))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == plain(counter, text) and tree.chars[1] == len(text)
            assert [p for leaf in tree.leaves for p in leaf] == counter.pattern.findall(text)
    with pytest.raises(ValueError):
        tree.edit(0, len(text) + 1, "")


def test_an_edit_encodes_little(counter):
    text = "The quick brown fox. " * 5000
    tree = tokencount.TokenTree(text, counter)
    tree.edit(50_000, 50_010, "something else")
    assert 0 < tree.encoded < 20


def test_whole_table(spark, sf_dir, counter):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.op4_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id]
        masked = tokencount.PRIVATE.sub(tokencount.MASK, t)
        assert (r.n_tokens, r.n_tokens_after) == (plain(counter, t), plain(counter, masked)) and r.n_edits == len(tokencount.PRIVATE.findall(t))


def test_odd_rows(spark, counter):
    data = [(1, None, "x", 0), (2, "", "x", 0), (3, "a1 " * 20_000, "x", 0), (4, "x", "x", 0), (4, "x", "x", 0), (None, "me@x.org", "x", 0)]
    got = [(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in tokencount.count(spark.createDataFrame(data, SCHEMA)).collect()]
    mask = "[masked] " * 20_000
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, plain(counter, "a1 " * 20_000), 20_000, plain(counter, mask)), (4, 1, 0, 1), (4, 1, 0, 1), (None, plain(counter, "me@x.org"), 1, plain(counter, "[masked]"))]
    assert tokencount.count(spark.createDataFrame([], SCHEMA)).count() == 0
