"""Subspace join, VA-file, MinHash join and components against brute force."""

import math
import random

import numpy as np
import pytest

from tracklane.llm import minhash, subspace, vafile
from tracklane.llm.components import components
from tracklane.llm.minhash import NearCopies
from tracklane.llm.subspace import Alike
from tracklane.llm.vafile import VaFile


def groups(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({n for p in links for n in p}, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_of(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 20))
    rows = []
    for i in range(260):
        near = i % 3
        v = base[rng.integers(60)] + (rng.normal(size=20) * 0.25 if near else 0)
        rows.append((i, [float(x) for x in v], int(rng.integers(2))))
    odd = [
        (900, None, 1), (901, [0.0] * 20, 1), (902, [math.nan] + [1.0] * 19, 1), (903, [None] + [1.0] * 19, 1), (904, rows[0][1], None),
        (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2]), (907, [1e200] * 20, 0), (908, [1e-200] * 20, 0), (3, rows[3][1], rows[3][2]), (909, [], 1),
    ]
    return rows + odd


def usable(v, label):
    return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("part", [4096, 16])
def test_subspace_links(spark, part):
    rows = vectors_of(5)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, weight int, rep string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in subspace.links(frame, Alike(block_width=4, part=part)).collect()), key=str)
    n, fit = len(rows), [i for i, (k, v, label) in enumerate(rows) if k is not None and usable(v, label)]
    pairs = [
        (i, j) for i in fit for j in fit if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.93
    ]
    count = [sum(i in p for p in pairs) for i in range(n)]
    ids = groups({r[0] for r in rows if r[0] is not None}, [(rows[i][0], rows[j][0]) for i, j in pairs])
    want = [(k, count[i], ids.get(k), k is None or ids[k] == k) for i, (k, _, _) in enumerate(rows)]
    assert len(pairs) > 100 and got == sorted(want, key=str)


def test_subspace_links_of_nothing(spark):
    assert subspace.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    only = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in subspace.links(only).collect()] == [(1, 0, 1, True)]


def brute_top(rows, k, asks):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fit:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rule", [VaFile(), VaFile(k=3, rows=16, queries=2, together=1)])
def test_vafile(spark, rule):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(1 if i % 2 else 6)]) for i in range(150)]
    rows += [(200 + i, rows[4][1]) for i in range(9)]  # ties
    rows += [(300, None), (301, [math.nan] * 12), (302, [None] + [1.0] * 11), (305, [1.0, 2.0]), (310, [3.0, 4.0]), (None, [1.0] * 12), (320, [0.0] * 12), (330, [1e6] * 12)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % 5 == 0, rule).collect())
    assert got == brute_top(rows, rule.k, lambda q: q % 5 == 0)


def test_vafile_of_nothing(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vafile.top_k(frame, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<double>")
    assert vafile.top_k(one, F.col("vec_id") % 5 == 0).count() == 0


def test_vafile_leaves_out_empty_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(5, []), (10, [1.0, 2.0]), (11, [2.0, 1.0]), (15, []), (16, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % 5 == 0).collect())
    assert got == brute_top([r for r in rows if r[1]], 5, lambda q: q % 5 == 0) and len(got) == 1


def text_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, common = [], " ".join(rng.choice(words) for _ in range(60))
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        for c in range(rng.choice([1, 1, 2, 5])):
            copy = list(body)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (" " + common if i % 4 == 0 else "")))
    long = " ".join(rng.choice(words) for _ in range(20_000))
    rows += [(len(rows) + i, t) for i, t in enumerate(
        [None, "", "  \n ", "One two", "one TWO", "one\x0btwo three", long, long + " end", "É ß", "é ß", "a b c d", "A b c D", "a b c d", "x y z k l", rows[0][1]]
    )]
    return rows + [(None, rows[0][1]), (5, rows[9][1])]


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


@pytest.mark.parametrize("words", [4, 5])
def test_minhash_join(spark, words):
    rows = text_rows(words)
    frame = spark.createDataFrame([(*r, "x", 1, b"p") for r in rows], "doc_id long, text string, rep string, component int, print binary").repartition(3)
    got = sorted((tuple(r) for r in minhash.near_copies(frame, NearCopies(words=words)).collect()), key=str)
    sets = [shingles(t, words) for _, t in rows]
    links = [
        (rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0])
        and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    ids = groups({r[0] for r in rows if r[0] is not None}, links)
    want = [(k, len(s), ids.get(k), k is None or ids[k] == k) for (k, _), s in zip(rows, sets)]
    assert len(links) > 50 and got == sorted(want, key=str)


def test_minhash_of_nothing(spark):
    assert minhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in minhash.near_copies(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1, True)]


def test_minhash_seldom_misses_a_pair_at_the_limit():
    rule = NearCopies()
    p = rule.threshold / 100
    missed = sum(math.comb(rule.coordinates, k) * p**k * (1 - p) ** (rule.coordinates - k) for k in range(rule.matches))
    assert missed < 1 / 29_000_000


def edited(rng, body, edits):
    copy = list(body)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**9)}"
    return copy


def test_a_group_of_near_misses_does_not_meet_in_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    body = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    # All below 80 % of each other (six edits and more), and most above the signatures' 22 of 48.
    rows = [(i, " ".join(edited(rng, body, rng.choice([6, 7, 8])))) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " end") for i in range(0, 400, 9)]
    met, alike = [], minhash._alike

    def counted(pairs, *more):
        met.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(minhash, "_alike", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in minhash.near_copies(frame, NearCopies(words=4)).collect())
    sets = [shingles(t, 4) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    ids = groups([r[0] for r in rows], links)
    assert got == [(k, len(s), ids[k], ids[k] == k) for (k, _), s in sorted(zip(rows, sets), key=lambda x: x[0][0])]
    assert 40 < len(links) < 200 and sum(met) < 5 * len(rows)
