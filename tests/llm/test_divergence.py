"""The divergence audit against plain Python on whole numbers."""

import re
from collections import Counter, defaultdict

import pytest

from tracklane.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, holders=3, unit=10**9, ranks=200):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in held[lang].items() if n >= holders]
        sources = sorted(s for g, s in counts if g == lang)
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, total: 1 + unit * (n + 1) // (total + len(kept))
        p = {s: {t: share(counts[lang, s][t], totals[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(totals.values())) for t in kept}
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    ("en", "a", "The cat, the CAT; the dog-house. ÀB àb x1y Z\x00q"), ("en", "a", "cat cat dog the Ünder"), ("en", "b", "the\tcat\x7fsat Ünder"),
    ("en", "b", "dog the cat " * 400), ("en", "c", None), ("en", "d", ""), ("en", None, "cat the dog Ünder straße"), (None, "a", "solo"),
    (None, "b", None), ("de", "a", "ein ein ein"), ("de", "b", "ein Haus"), ("de", "b", "ein Haus"), ("de", "b", "ein Haus"), ("en", "e", "unkept words only"),
    ("one", "only", "alle alle"), ("one", "only", "alle alle"), ("one", "only", "alle meine"),
]


def test_cuts_like_the_pattern():
    for text in ["", "a1B", "Zz\x80 ÄÖ é-É", "\x00@[`{\x7f", "日本 語x"]:
        assert [t.decode() for t in divergence.terms(text.encode())] == [t.translate(LOWER) for t in TERM.findall(text)]


def test_against_plain_python(spark):
    assert found(divergence.audit(table(spark, ROWS))) == brute(ROWS)


def test_sends_on_what_it_holds_and_pairs_in_parts(spark):
    rule = divergence.Audit(entries=3, held_bytes=40, pairs=2, holders=2, ranks=2)
    assert found(divergence.audit(table(spark, ROWS), rule)) == brute(ROWS, 2, ranks=2)


def test_many_sources_ties_and_clashing_columns(spark):
    rows = [("xx", f"s{i}", " ".join(f"w{c}" for c in "abcdefg"[: 1 + i % 7]) + " same" * (i % 4)) for i in range(70)] * 2
    docs = table(spark, rows)
    for name in ("term", "n", "docs", "p", "q", "rank", "value", "item", "no"):
        docs = docs.selectExpr("*", f"1 as `{name}`")
    assert found(divergence.audit(docs)) == brute(rows)


def test_numbers_beyond_a_long(spark):
    share = divergence._share
    df = spark.createDataFrame([(4 * 10**18, 4 * 10**18 + 7)], "n long, whole long")
    want = 1 + 10**9 * (4 * 10**18 + 1) // (4 * 10**18 + 7)
    assert df.select(share(df.n, df.whole, divergence.Audit())).first()[0] == want


@pytest.mark.parametrize("rows", [[], [("en", "a", None)], [("en", "a", ""), ("en", "b", "x" * 300_000)]])
def test_few_or_no_terms(spark, rows):
    assert found(divergence.audit(table(spark, rows))) == brute(rows)
