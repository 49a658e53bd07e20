import random

import pytest

import corpus_pipeline
from veldra.llm import classes, language, mixing, packing, quality, simhash


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    # By hand: decisions of the operators applied to the rows that are left.
    left = docs.collect()
    gone = {r.doc_id for r in language.identify(docs).collect() if not r.accepted}
    left = [r for r in left if r.doc_id not in gone]
    now = spark.createDataFrame(left, docs.schema)
    gone = {r.doc_id for r in quality.classify(now, labels).collect() if not r.accepted}
    assert gone
    left = [r for r in left if r.doc_id not in gone]
    now = spark.createDataFrame(left, docs.schema)
    copies = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(now).collect()}
    assert copies and not set(copies.values()) & set(copies)
    left = [r for r in left if r.doc_id not in copies]
    now = spark.createDataFrame(left, docs.schema)
    times = {r.doc_id: r.copies for r in mixing.mix_rates(now).collect()}
    left = [r for r in left for _ in range(times[r.doc_id])]
    want = sorted(tuple(r) for r in packing.pack(spark.createDataFrame(left, docs.schema)).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_near_dedup_is_the_same_however_many_texts(spark, monkeypatch):
    """Counts as of a table of 2^40 texts change nothing in what the stage keeps."""
    from tests.llm.test_simhash import SCHEMA, distant

    texts, want, fewer = distant(random.Random(9))
    assert any(pair not in fewer for pair in want)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    monkeypatch.setattr(type(docs), "count", lambda self: 1 << 40)
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert kept == set(range(len(texts))) - {b for _, b in want}


@pytest.mark.parametrize("most", [classes.FILTER, 0])
def test_near_dedup_is_the_same_with_and_without_a_filter(spark, monkeypatch, most):
    """More documents to drop than the filter takes change nothing, whatever the ids look like."""
    monkeypatch.setattr(classes, "FILTER", most)
    text = "the same words stand here in this very order more than once"
    rows = [(" 1", text), (" 2", text), ("+3", text), ("4", "another text of some other words"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").orderBy("doc_id").collect()] == [None, " 1", "4"]
    for kind in ("double", "decimal(12,2)"):
        numbers = docs.withColumn("doc_id", docs.doc_id.cast(kind))
        assert [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, numbers, "").orderBy("doc_id").collect()] == [None, 1, 4]
        with pytest.raises(Exception, match="doc_id must be a whole number"):
            corpus_pipeline.simhash_dedup(spark, numbers.withColumn("doc_id", (numbers.doc_id + 0.5).cast(kind)), "").collect()


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, "/root/testdata/sf0.01")
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(good & left) >= 0.99 * len(good)
