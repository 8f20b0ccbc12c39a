"""Few labelled rows: enough batches to learn from them, and no cut from a handful of texts kept apart."""

from tallgrass.llm import toxicity


def test_few_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    flagged = [r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("flagged").select("doc_id").collect()]
    caught, clean = (sum(toxic.get(i) == c for i in flagged) for c in (1, 0))
    assert 2 * caught >= sum(toxic.values()) and clean <= caught // 2
