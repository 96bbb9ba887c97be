"""Personal data: base spans against plain Python, the trees against a plain walk, thresholds, redaction, long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracklane.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def base(df):
    return {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.candidates(df).select("doc_id", "base").collect()}


def card(pick, size=16):
    digits = "".join(pick.choice("0123456789") for _ in range(size - 1))
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def test_base_spans_against_plain_python(spark):
    pick = random.Random(4)
    bits = ["a.b@c-d.co.uk", "x@y", "@z.w", "a@b.c_d@e.f", "..%a@b..c", "1.2.3.4", "256.1.1.1", "000255.01.1.1", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "+1 (017) 555-7713",
            "+12", "+1 ((((", "+49.30.1234567-", " ", "-", "+", ".", "@", "é", "日本", "12", "7", "\n", "4111 1111 1111 1111", "4111-1111-1111-1112", "a", "(", ")"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(1, 14))) for _ in range(600)] + [card(pick, n) for n in range(13, 21)] + ["", None]
    assert base(table(spark, texts)) == {i: brute(t) for i, t in enumerate(texts)}


def test_trees_in_spark_and_in_python_give_one_score(spark):
    pick = random.Random(1)
    sizes = pii.FEATURES
    cells = [({f: pick.randrange(n) for f, n in sizes.items()}, pick.randrange(1, 9)) for _ in range(300)]
    cells = [(v, n, n if v["last"] == 2 and v["left"] != 1 else pick.randrange(n + 1) // 3) for v, n in cells]
    model = pii.fit(cells, cells)
    assert len(model.trees) == pii.Boosting().rounds
    rows = spark.createDataFrame([tuple(v.values()) for v, *_ in cells], ", ".join(f"{f} int" for f in sizes))
    got = [r[0] for r in rows.select(model.score(F.struct(*sizes))).collect()]
    assert got == pytest.approx([model.value(v) for v, *_ in cells])
    # Known ones are told from others.
    odds = sorted((model.value(v), k == n) for v, n, k in cells if k in (0, n))
    assert sum(k for _, k in odds[-30:]) > 27 and sum(k for _, k in odds[:30]) < 3


def test_first_split_is_the_best_one():
    cells = [({f: 0 for f in pii.FEATURES} | {"last": i % 3, "left": i % 2}, 10, 10 if i % 3 == 2 else 0) for i in range(6)]
    tree = pii.fit(cells, cells, pii.Boosting(rounds=1, depth=1)).trees[0]
    assert tree[:2] == ("last", 2) and tree[2] < 0 < tree[3]


def test_thresholds_are_calibrated():
    rule = pii.Boosting(precision=0.9, support=10)
    assert pii.threshold([(3.0, 10, 9), (2.0, 10, 10), (1.0, 10, 5), (0.5, 1, 1)], rule) == pytest.approx(2.0, abs=1e-3)
    assert pii.threshold([(3.0, 9, 9), (2.0, 10, 1)], rule) is None
    assert pii.threshold([], rule) is None


def spans(df, model=None):
    found = pii.candidates(df)
    model = model or pii.train(found)
    return {r["doc_id"]: [(s["start"], pii.KINDS[s["kind_no"]], s["end"]) for s in r["spans"]] for r in pii.select(found, model).collect()}, model


def test_unknown_ones_like_known_ones_are_added(spark):
    pick = random.Random(8)
    number = lambda: f"({pick.randrange(100, 999)}) {pick.randrange(100, 999)}-{pick.randrange(1000, 9999)}"
    texts = [f"please call +1 {number()} now" for _ in range(300)] + [f"order no. {pick.randrange(10**9, 10**10)} shipped" for _ in range(300)]
    texts += [f"mail to user{i}@mail.example.com today" for i in range(200)] + [f"on 2024-{1 + i % 12:02d}-{1 + i % 28:02d} at home" for i in range(100)]
    n = len(texts)
    texts += ["write to some.one [at] mail.example.com today", "order no. 1234567890 shipped", "on 2023-05-06 at home", "nothing at all.here", None, ""]
    got, model = spans(table(spark, texts))
    assert all(got[i] == [(s, pii.KINDS[k], e) for s, k, e in brute(t)] for i, t in enumerate(texts[:n]))
    assert got[n] == [(9, "likely_email", 39)]
    assert all(got[i] == [] for i in range(n + 1, len(texts)))
    assert model.thresholds[0] is not None


def test_all_generators_may_add(spark):
    flat = {f: 0 for f in pii.FEATURES}
    model = pii.Model((("kind", 3, 1.0, 0.0),), 0.0, (0.5, 0.5, 0.5))
    assert model.value(flat) == 1.0
    got, _ = spans(table(spark, ["a [at] b.c and 10 . 0 . 0 . 1 or 030 1234567 1.2.3.4 x@y 12.3456.789"]), model)
    # The number 030 1234567 runs into the base span behind it.
    assert got[0] == [(0, "likely_email", 10), (15, "likely_ip", 29), (45, "ip", 52), (53, "likely_email", 56), (57, "likely_number", 68)]


def test_nothing_known_adds_nothing(spark):
    got, model = spans(table(spark, ["call 030 1234567 or 12345678", "a [at] b.c", None]))
    assert set(map(tuple, got.values())) == {()} and model.thresholds == (None, None, None)
    assert spans(table(spark, []).limit(0))[0] == {}


def test_candidates_that_meet_each_other_or_a_base_span(spark):
    rows = spark.createDataFrame([([(0, 5), (7, 9), (10, 20)], [(5, 7), (8, 12), (30, 31)]), ([(1, 2)], []), ([], [(1, 2)])],
                                 "a array<struct<start:long,end:long>>, b array<struct<start:long,end:long>>")
    assert [r[0] for r in rows.select(pii._touching(F.col("a"), F.col("b"))).collect()] == [[False, True, True], [False], []]


def test_running_over_any_length(spark):
    for size in (0, 1, 4, 5, 70, 1100):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(size)) if size else F.array().cast("array<int>"), lambda x: x.cast("long")).alias("a"))
        got = df.select(pii.running(F.col("a"), lambda x, y: x + y, F.lit(0).cast("bigint"))).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, size + 1)]


def test_redacts_stretches(spark):
    span = "array<struct<start:bigint,kind_no:int,end:bigint>>"
    rows = [("0123456789", [(1, 0, 3), (2, 1, 5), (5, 0, 6), (8, 0, 10)]), ("äöü", [(0, 0, 1)]), ("abc", []), (None, []), ("x" * 9, [(0, 0, 9), (1, 2, 3), (4, 1, 5)])]
    df = spark.createDataFrame(rows, f"t string, s {span}")
    got = [r[0] for r in df.select(pii.redact(F.col("t"), F.col("s"), "#")).collect()]
    assert got == ["0##67#", "#öü", "abc", None, "#"]


def test_clashing_columns_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a@b.cd", 1, 2), (None, "a@b.cd", 1, 2), (3, None, 5, 6)], "doc_id long, text string, spans int, kind int")
    df = df.selectExpr("*", "1 as base", "2 as proposed", "3 as row", "4 as `start`")
    got = pii.select(pii.candidates(df), pii.Model((), 0.0, (None, None, None)))
    assert set(got.columns) == {"doc_id", "text", "kind", "row", "start", "base", "spans"}
    assert sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in got.collect()) == [(0, [(0, 0, 6)]), (0, [(0, 0, 6)]), (3, [])]


@pytest.mark.parametrize("text,want", [  # what the patterns find is plain here; Python's own search would be quadratic
    ("x" * 1_000_000, []), ("1" * 1_000_000, []), ("a" * 500_000 + "@", []), ("+1 (" * 100_000, []), ("1 " * 300_000, []), ("(1-" * 200_000, []),
    ("a@b.co " * 20_000, [(7 * i, 0, 7 * i + 6) for i in range(20_000)]), ("1.1." * 100_000, [(8 * i, 1, 8 * i + 7) for i in range(50_000)]),
], ids=range(8))
def test_very_long_texts_take_no_quadratic_time(spark, text, want):
    start = time.time()
    assert base(table(spark, [text]))[0] == want
    assert time.time() - start < 60
