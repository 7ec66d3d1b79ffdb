"""Each stage of the pipeline acts on all that the one before it kept."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p
    from plotwise.llm import jaccard, quality, secrets
    from plotwise.session import stage

    if not os.path.isdir(SF):
        pytest.skip("data set not present")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    seen = {}
    for name, function in p.STAGES:
        after = stage(function(spark, before, SF), "test")
        seen[name] = (before, after)
        before = after
        if name != p.STAGES[-1][0]:
            assert after.columns == columns
    a, b = seen["quality classifier"]
    good = {r.doc_id for r in quality.classify(a, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in b.collect()} == good
    a, b = seen["n-gram Jaccard join"]
    assert {r.doc_id for r in b.collect()} == {r.class_id for r in jaccard.classes(a).collect()}
    a, b = seen["secret scans"]
    assert b.count() == a.count() and secrets.report(b).where("n_assign + n_access + n_hex > 0").isEmpty()
    a, b = seen["mixing sources"]
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}
    a, b = seen["SentencePiece encoding"]
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect())) and b.where("size(ids) = 0").isEmpty()
