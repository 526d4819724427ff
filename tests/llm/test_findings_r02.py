"""What the second round's review found in the corpus operations."""

from pyspark.sql import functions as F

from cairn.llm import lmscore


def test_a_batch_sends_one_request_to_a_shard(spark, documents):
    """Whatever the tasks that its rows came in; and each batch's answers give the scores of the whole model."""
    docs = documents.select("doc_id", "text").repartition(7)
    dealt, asked = lmscore.requested(docs, 3, 10)
    pairs = asked.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n"))
    assert dealt.count() == docs.count() and dealt.select("batch").distinct().count() >= 10
    assert pairs.agg(F.max("n")).first()[0] == 1
    model, totals = lmscore.trained(docs.select("text"), tokens_per_shard=20_000)
    assert totals["bits"] > 0
    whole = {r["doc_id"]: r for r in lmscore.scored(docs, model, totals).collect()}
    parts = {r["doc_id"]: r for r in lmscore.scored(docs, model, totals, most_bytes=0, batch_rows=10).collect()}
    assert whole.keys() == parts.keys()
    assert all(whole[k][:3] == parts[k][:3] and all(abs(a - b) < 1e-6 for a, b in zip(whole[k][3:], parts[k][3:])) for k in whole)
