import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cohortline.llm import catalog, packing, toxicity

from .test_decontaminate import brute
from .test_nearcopies import slow
from .test_packing import check


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage leaves, written and read again."""
    place, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{place}/{k}")
        out.append(spark.read.parquet(f"{place}/{k}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_named_and_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near copies", "decontamination", "packing"]
    assert all(df.columns == kept[0].columns for df in kept[:-1])
    assert [len(ids(df)) for df in kept[:-1]] == sorted((len(ids(df)) for df in kept[:-1]), reverse=True)


def test_toxic_documents_go(spark, sf_dir, kept):
    said = toxicity.score(kept[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(kept[1]) == ids(said.where("predicted = 0"))


def test_documents_without_letters_go(spark, sf_dir, kept):
    assert ids(kept[2]) == ids(kept[1].where(F.col("text").rlike(r"\p{L}")))
    more = kept[1].limit(3).union(kept[1].limit(1).withColumn("text", F.lit("12 !")).withColumn("doc_id", F.lit(-5).cast("long")))
    assert -5 not in ids(corpus_pipeline.drop_unidentified(spark, more, sf_dir))


def test_one_of_each_group_stays(spark, sf_dir, kept):
    rows = kept[2].orderBy("doc_id").collect()
    want = slow([(r.doc_id, r.text) for r in rows])  # five words, a Jaccard of 0.8, all pairs
    assert ids(kept[3]) == want
    copies = kept[2].limit(5).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    once = kept[2].union(copies).union(copies)
    assert ids(corpus_pipeline.drop_near_copies(spark, once, sf_dir)) == want


def test_no_document_holds_an_item(spark, sf_dir, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute([(r.doc_id, r.text) for r in kept[3].collect()], items)}
    assert ids(kept[4]) == sorted(set(ids(kept[3])) - leaks)


def test_what_is_left_is_packed(kept):
    check(kept[5].collect(), {r.doc_id: r.text for r in kept[4].collect()})


def test_the_whole_run_is_the_stages(spark, sf_dir, kept):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = corpus_pipeline.run(spark, sf_dir), kept[5]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert "pipeline" in __spark_entry__.queries() and set(catalog.queries()) <= set(__spark_entry__.queries())
    assert packing.pack(kept[4]).count() == got.count()


def test_stages_take_an_empty_table(spark, sf_dir, kept):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, kept[0].limit(0), sf_dir).count() == 0
