import zlib

import numpy as np
import pytest

from cohortline.llm import catalog, langid

SCHEMA = "doc_id long, text string, lang string, score string, languages int"
EN, DE = "the cat sat on the mat with the other cats and then they went home together in the rain ", "der hund und die katze sind nicht auf dem dach weil das wetter schlecht ist und es regnet "


def test_held_out_accuracy(spark, sf_dir):
    got = catalog.op10_language(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


@pytest.fixture(scope="module")
def model():
    counts = np.stack([np.bincount(langid.trigrams(t * 3), minlength=langid.BUCKETS) for t in (DE, EN)]).astype(float)
    return langid.Mixture(["de", "en"], counts)


def test_mixtures(model):
    assert model.infer(EN)[0] == [1] and model.infer(DE)[0] == [0]
    keep, share = model.infer(EN * 4 + DE * 2)
    assert keep == [1, 0] and share[0] == pytest.approx(len(EN) * 4 / (len(EN) * 4 + len(DE) * 2), abs=0.1)
    assert model.infer(None)[0] == model.infer("123 ...")[0] == model.infer("")[0] == model.infer("½ ² ① Ⅷ ٣ _ \u0301")[0] == []
    assert model.infer("é")[0] and model.infer("中")[0] and model.infer("ª")[0]
    assert langid.Mixture([], np.empty((0, langid.BUCKETS))).infer(EN)[0] == []


def test_a_short_passage_in_a_second_language_is_found(model):
    sure = langid.Mixture(model.languages, np.stack([np.bincount(langid.trigrams(t * 3000), minlength=langid.BUCKETS) for t in (DE, EN)]).astype(float))
    keep, share = sure.infer(EN * 100 + DE)
    assert keep == [1, 0] and share[1] < 0.02
    assert sure.infer(EN * 100)[0] == [1]


def test_selected_set_has_the_best_penalised_likelihood(model):
    for text in (EN, DE, EN * 3 + DE, EN + DE * 9, EN[:30] + DE[:200]):
        buckets, n = np.unique(langid.trigrams(text), return_counts=True)
        value = {k: model.fit(model.p[buckets][:, list(k)], n)[1] - len(k) * model.penalty * np.log(n.sum() + 1) for k in ((0,), (1,), (0, 1))}
        assert tuple(sorted(model.infer(text)[0])) == max(value, key=value.get)


def test_em_reaches_the_best_mixture(model):
    buckets, n = np.unique(langid.trigrams(EN * 3 + DE), return_counts=True)
    p = model.p[buckets]
    share, value = model.fit(p, n)
    grid = max(float(n @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0.001, 0.999, 999))
    assert value >= grid - 0.5 and share.sum() == pytest.approx(1)


def test_odd_rows(spark):
    data = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x", 1) for i in range(1, 40)] + [(100, None, "en", "", 0), (101, "", None, "", 0), (102, "12 !", "de", "", 0), (103, EN * 500, None, "", 0), (103, EN, "de", "", 0), (None, DE, "en", "", 0), (104, "é", None, "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in langid.identify(df).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[100] == got[101] == got[102] == ["und"] and got[103] == ["en", "en"] and got[None] == ["de"] and got[104][0] in ("de", "en")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(data) - 3
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty).count() == langid.keep_identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, EN, None, "", 0)], SCHEMA)
    assert langid.identify(unlabelled).first().lang_pred == "und"
