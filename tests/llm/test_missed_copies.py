import random

import numpy as np
import pyarrow as pa
import pytest

from cohortline.llm import nearcopies
from cohortline.llm.simhash import majority

from .test_nearcopies import slow


def corpus(seed):
    """Groups of copies with changed words, and of texts that are each a word longer than the one before."""
    rng, rows = random.Random(seed), []
    for _ in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 9, 14, 30, 90]))]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for i in rng.sample(range(len(own)), rng.choice([0, 0, 1, len(own) // 40])):
                own[i] = f"c{rng.randrange(9)}"
            rows.append(" ".join(own + [f"m{k}" for k in range(rng.choice([0, 0, 1, 2, len(own) // 6]))]))
    return [(k, t) for k, t in enumerate(rows)]


def kept(spark, rows):
    return sorted(r.doc_id for r in nearcopies.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_a_pair_whose_fingerprints_are_far_apart(spark):
    """Four shingles of five: a Jaccard of 0.8, but 26 bits of the fingerprints differ."""
    text = " ".join(f"w26613x{i}" for i in range(8))
    one, two = (nearcopies.shingles(t.encode()) for t in (text, f"{text} more"))
    assert len(np.intersect1d(one, two)) == 4 and len(np.union1d(one, two)) == 5 and (majority([one]) ^ majority([two])).bit_count() == nearcopies.DISTANCE + 1
    assert kept(spark, [(7, text), (3, f"{text} more"), (5, "some other text of more than five words")]) == [3, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost_without_bands_and_fingerprints(spark, monkeypatch, seed):
    """With fingerprints that must be equal nearly all links are left to the prefixes."""
    monkeypatch.setattr(nearcopies, "DISTANCE", 0)
    rows = corpus(seed)
    want = slow(rows)
    assert kept(spark, rows) == want and len(want) < len(rows) - 10


def test_told_tokens_are_enough_for_every_pair():
    for x in range(1, 130):
        for y in range(1, 130):
            for both in range(1, min(x, y) + 1):
                if 9 * both >= 4 * (x + y):
                    (tx, least), (ty, _) = nearcopies.prefix(x), nearcopies.prefix(y)
                    assert min(both, min(x, tx) - (x - both), min(y, ty) - (y - both)) >= least  # own tokens first is the worst order


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_tokens_that_other_components_have(cut):
    rng = np.random.default_rng(cut)
    token, component = rng.integers(0, 25, 70), rng.integers(0, 6, 70)
    order = np.lexsort((component, token))
    whole = pa.record_batch([pa.array(token[order]), pa.array(component[order])], names=["token", "component"])
    got = {}
    for b in nearcopies.elsewhere(whole.slice(i, cut) for i in range(0, 70, cut)):
        for k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[k] = got.get(k, 0) + c
    pairs = set(zip(token.tolist(), component.tolist(), strict=True))
    want = {k: sum(any(t == u and k != j for u, j in pairs) for t, i in pairs if i == k) for k in range(6)}
    assert got == {k: c for k, c in want.items() if c}
