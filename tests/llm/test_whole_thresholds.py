"""Counts and thresholds come from all trusted or learned documents, not from some of them."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import op7_quality as op7
from recordloom.llm import op10_langid as op10
from recordloom.operators.ordering import percentile


@pytest.mark.parametrize("share", [0.0, 0.001, 0.37, 0.999, 1.0])
def test_percentile_is_exact(spark, share):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=700), np.full(300, 0.25), [1e9, -1e9]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").cache()
    want = rows.select(F.percentile("v", F.lit(share))).first()[0]
    for held in (1, 10, 10_000):
        assert percentile(rows, "v", share, held) == pytest.approx(want, abs=1e-12)
    assert percentile(rows.filter("false"), "v", share) is None


def test_all_trusted_documents_count(spark):
    labels = spark.range(20_050).selectExpr("id as doc_id", "cast(1 as int) as quality").unionAll(spark.sql("select cast(null as long), 1"))
    ids = op7.trusted_ids(labels)
    assert ids.count() == 20_050  # more than were once taken
    docs = spark.range(20_049, 20_060).selectExpr("id as doc_id", "'some text' as text").unionAll(spark.sql("select cast(null as long), 'x'"))
    assert [r.doc_id for r in op7.trusted_rows(docs, ids).collect()] == [20_049]
    want = op7.feature_counts(docs.filter("doc_id = 20049"))
    for limit in (100, 100_000):  # by the filter, less what it should not let through, and by broadcast
        assert [r.doc_id for r in op7.trusted_rows(docs, ids, limit).collect()] == [20_049]
        assert (op7.trusted_counts(docs, ids, limit) == want).all() and want.sum() == 3


def test_what_a_crowded_filter_lets_through_is_taken_away(spark, monkeypatch):
    monkeypatch.setattr(op7, "narrowed", lambda rows, wanted, keys, limit=op7.BROADCAST_KEYS: rows)  # a filter that lets all through
    docs = spark.range(40).selectExpr("id as doc_id", "concat('word', id, ' text') as text")
    ids = spark.range(10).selectExpr("id * 3 as doc_id")
    monkeypatch.setattr(op7, "trusted_rows", lambda rows, wanted: rows.join(wanted, "doc_id", "left_semi"))
    assert (op7.trusted_counts(docs, ids, 5) == op7.feature_counts(docs.filter("doc_id % 3 = 0 and doc_id < 30"))).all()


def test_farthest_is_of_all_learned_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = op10.profiles(docs)
    assert "sample" not in inspect.signature(op10.farthest).parameters
    # many learned texts of a language whose profile they are far from, beyond the documents of a sample
    odd = spark.range(10_000, 14_000).selectExpr("id as doc_id", "'\u6f22\u5b57 \u4eee\u540d' as text", "'en' as lang", "'x' as source", "1L as n_chars")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    learned = both.filter(op10.learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    asked = []
    whole = op10._learned(both)
    assert whole.count() == learned.count() > op10.SAMPLE
    asked.append(op10.farthest(both, found))
    assert asked == [op10.PROFILE]
