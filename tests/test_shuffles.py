"""What the searches shuffle: documents once, texts once."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.clients import OfflineClient
from lectern.operators import retrieval as R
from lectern.operators import scoring as S
from lectern.plans import agent as A
from lectern.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_not_repeated_for_every_block(spark):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(60)], "id bigint, text string")
    asks = docs.select(F.col("id").alias("qid"))
    met = S.met(S.dealt(R.tokenized(docs, "text"), 60), asks, 60, 60, lambda *_: None, "qid bigint", block=2)
    assert plan(met).count("Generate explode") == 1  # of the blocks of queries alone


def test_answers_search_as_deep_as_asked_and_stop_when_accepted(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "hash table"), (1, "hash table"), (2, "tree")], "id bigint, text string")
    asks, depths = spark.createDataFrame([(7, "hash table")], "qid bigint, query string"), []
    monkeypatch.setattr(A, "bm25", lambda c, q, k=10: depths.append(k) or R.bm25(c, q, k))
    assert [r["used"] for r in A.answered(asks, chunks, None, OfflineClient()).collect()] == [[1]]
    assert depths == [10]


@pytest.mark.parametrize("name", ["fused_context", "context_whole", "context_numbering"])
def test_texts_are_told_apart_behind_the_join(spark, tiny, name):
    """There the rows lie by id, so that the texts are shuffled once."""
    shown = plan(registry.QUERIES[name](spark, tiny))
    assert shown.index("Aggregate") < shown.index("Join")


@pytest.mark.parametrize("name", ["book_first_chapter", "citation_display", "search_result_counts"])
def test_no_text_is_grouped(spark, tiny, name):
    lines = plan(registry.QUERIES[name](spark, tiny)).splitlines()
    assert not [x for x in lines if "Aggregate" in x and "content#" in x]
    assert not [x for x in lines if "snippet" in x]
