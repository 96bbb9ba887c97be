"""The sample for the classifiers, where ids are repeated or have no document."""

from collections import Counter

from tracklane.llm.labels import sample


def test_sample_is_bounded_whatever_is_repeated(spark):
    docs = [(1, f"hot {i}") for i in range(400)] + [(i, f"text {i}") for i in range(2, 60)] + [(None, "no id")]
    labels = [(i, i % 2) for i in range(60)] * 3 + [(i, i % 2) for i in range(1000, 3000)]  # many without a document
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    got = sample(docs, labels, "toxic", 20).collect()
    assert Counter(r.label for r in got) == {0: 10, 1: 10}
    every = sample(docs, labels, "toxic", 4000).collect()
    texts = [r.text for r in every]
    assert len(texts) == len(set(texts)) > 40 and sum(t.startswith("hot") for t in texts) == 1
    again = sample(docs.repartition(2), labels, "toxic", 4000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, every))
