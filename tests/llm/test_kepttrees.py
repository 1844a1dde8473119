import random
import shutil

import public_tokenizers
import pytest

from cohortline.llm import kepttrees, tokencount

DOCS, EDITS = "doc_id long, text string, copy string", "doc_id long, seq int, start long, stop long, new string"


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(public_tokenizers.path(tokencount.VOCABULARY))


def texts(spark, place):
    out = {}
    for r in kepttrees.newest(spark, place, "pieces").where("pieces is not null").orderBy("id", "copy", "leaf").collect():
        out[r.id, r.copy] = out.get((r.id, r.copy), "") + "".join(r.pieces)
    return out


def made(text, edits):
    for a, b, new in edits:
        text = text[:a] + new + text[b:]
    return text


def random_edits(rng, text):
    out = []
    for _ in range(rng.randint(1, 4)):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice((0, 1, 7, 60, 3000)))
        out.append((a, b, rng.choice(("", "x1 ", "  \n", "a longer insertion, twice. " * rng.choice((2, 900))))))
        text = made(text, out[-1:])
    return out


def test_rounds_of_edits_against_full_encoding(spark, sf_dir, counter, tmp_path):
    rng, place = random.Random(4), str(tmp_path / "trees")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = {r.doc_id: r.text or "" for r in docs.collect()}
    kepttrees.keep(docs, place)
    for version in (1, 2, 3):
        edited = rng.sample(sorted(now), 12)
        todo = {i: random_edits(rng, now[i]) for i in edited}
        assert kepttrees.apply_edits(spark.createDataFrame([(i, k, *e) for i, es in todo.items() for k, e in enumerate(es)], EDITS), place) == version
        now |= {i: made(now[i], es) for i, es in todo.items()}
        written = spark.read.parquet(f"{place}/version={version}")
        assert {r.id for r in written.select("id").distinct().collect()} == set(edited)  # nothing of the others
    got = kepttrees.totals(spark, place).collect()
    assert {r.id: (r.n_tokens, r.n_chars) for r in got} == {i: (len(counter.encoding.encode_ordinary(t)), len(t)) for i, t in now.items()}
    assert {i: t for (i, _), t in texts(spark, place).items()} == now
    kepttrees.compact(spark, place, f"{place}2")
    assert texts(spark, f"{place}2") == texts(spark, place) and kepttrees.versions(spark, f"{place}2") == [0]
    assert sorted(kepttrees.totals(spark, f"{place}2").collect()) == sorted(got)


def test_an_edit_of_a_long_text_writes_and_encodes_little(spark, tmp_path):
    place = str(tmp_path / "trees")
    kepttrees.keep(spark.createDataFrame([(1, "The quick brown fox. " * 20_000, ""), (2, "other", "")], DOCS), place)
    kepttrees.apply_edits(spark.createDataFrame([(1, 0, 50_000, 50_010, "something else")], EDITS), place)
    (n, encoded) = spark.read.parquet(f"{place}/version=1").selectExpr("count(*)", "sum(reencoded)").first()
    assert n <= 2 and 0 < encoded < 20
    plan = kepttrees.leaves(spark, place).where("part in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_odd_rows(spark, counter, tmp_path):
    place = str(tmp_path / "trees")
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "b"), (3, "three", "a"), (None, "me", "a")]
    kepttrees.keep(spark.createDataFrame(rows, DOCS), place)
    assert kepttrees.totals(spark, place).count() == 5
    edits = [(1, 0, None, None, "new text"), (2, 0, -5, 99, None), (3, 1, 0, 1, "O"), (3, 0, 3, 999, "!"), (None, None, None, None, "you"), (77, 0, 0, 1, "nobody")]
    kepttrees.apply_edits(spark.createDataFrame(edits, EDITS), place)
    assert sorted((str(i), t) for (i, _), t in texts(spark, place).items()) == [("1", "new text"), ("2", ""), ("3", "Ohr!"), ("3", "One!"), ("None", "you")]
    kepttrees.apply_edits(spark.createDataFrame([], EDITS), place)
    assert kepttrees.versions(spark, place) == [0, 1, 2] and kepttrees.totals(spark, place).count() == 5
    with pytest.raises(ValueError):
        kepttrees.keep(spark.createDataFrame(rows, DOCS), place)
    empty = str(tmp_path / "empty")
    kepttrees.keep(spark.createDataFrame([], DOCS), empty)
    assert kepttrees.totals(spark, empty).count() == 0
    with pytest.raises(ValueError):
        kepttrees.leaves(spark, str(tmp_path / "nowhere"))


def test_a_killed_round_is_not_seen(spark, counter, tmp_path):
    place = str(tmp_path / "trees")
    kepttrees.keep(spark.createDataFrame([(1, "one two", "")], DOCS), place)
    kepttrees.apply_edits(spark.createDataFrame([(1, 0, 0, 3, "1")], EDITS), place)
    (tmp_path / "trees" / "version=1" / "_SUCCESS").unlink()
    assert list(texts(spark, place).values()) == ["one two"]
    assert kepttrees.apply_edits(spark.createDataFrame([(1, 0, 4, 7, "2")], EDITS), place) == 1
    assert list(texts(spark, place).values()) == ["one 2"]
    shutil.rmtree(place)
