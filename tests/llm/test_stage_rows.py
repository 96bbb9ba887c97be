"""The near-copies stage on rows that share an id or have none."""

import random

import corpus_pipeline

WORDS = [f"w{i}" for i in range(400)]


def body(seed, n=80):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def test_near_copies_stage_goes_by_rows(spark):
    copied, near = " ".join(body(1)), " ".join([*body(1)[:-1], "other"])
    rows = [
        (3, copied), (3, copied),  # a row listed twice: one stays
        (7, near), (7, " ".join(body(2))),  # a near copy of 3 goes, the text of its own under the same id stays
        (None, " ".join(body(3))), (None, " ".join(body(3))), (None, copied),  # copies without an id
        (9, " ".join(body(4))), (None, " ".join(body(4))), (8, " ".join(body(4))),  # the smallest id stays
        (5, None), (5, ""), (None, None),  # no words: all stay
    ]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = corpus_pipeline.near_copies_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(3, copied), (7, " ".join(body(2))), (None, " ".join(body(3))), (8, " ".join(body(4))), (5, None), (5, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
