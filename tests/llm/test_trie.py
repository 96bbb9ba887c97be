"""The prefix trie against plain Python, its parentheses against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracklane.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (c % 20 if c >= 0 else -(-c % 20))  # the remainder has the sign of c, as in SQL
        out[c] = own.get(root, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = set()

    def sums(path):
        words = len(WORD.findall(path[-1][1])) if path else 0
        leaves, saved = (0 if kids[path] else 1), (len(members[path]) - 1) * words
        for k in kids[path]:
            more = sums(k)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(convs[c]) == len(path)))
        out.add((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
        return leaves, saved

    if convs:
        sums(())
    return out


def found(spark, rows, layout=trie.Layout(), partitions=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    got = [tuple(r) for r in trie.trie(*trie.rebuilt(df), layout).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talk(seed, convs, vocabulary, longest):
    pick = random.Random(seed)
    return [
        (c, t, "user" if t % 2 == 0 else "assistant", " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(1, 3))))
        for c in convs for t in range(pick.randrange(1, longest))
    ]


@pytest.mark.parametrize("block", [4, 256])
def test_findclose_and_rank_against_a_stack(block):
    pick = random.Random(block)
    for size in (1, 2, 7, 300, 3000):
        bits, depth, left = [1], 1, size
        while depth:
            up = left > 0 and (depth == 1 or pick.random() < 0.5 + 0.3 * (size % 2))
            bits.append(int(up))
            left, depth = left - up, depth + (1 if up else -1)
            if not left and depth == 1 and bits[-1] == 0:
                break
        bits += [0] * (2 * sum(bits) - len(bits))
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        pairs = trie.Parentheses(np.array(bits, np.uint8), block)
        opens = np.array(sorted(close))
        assert pairs.findclose(opens, 17).tolist() == [close[i] for i in sorted(close)]
        assert pairs.rank_leaves(np.arange(len(bits) + 1)).tolist() == [sum(bits[j : j + 2] == [1, 0] for j in range(i)) for i in range(len(bits) + 1)]


def test_shared_heads_and_random_talk(spark):
    rows = talk(1, range(60), ["a", "b"], 7)
    assert found(spark, rows) == brute(rows)


def test_many_shards_share_spines(spark):
    rows = talk(2, range(0, 400, 3), ["a", "b b"], 9)
    for leaves, entries in ((1, 1), (2, 5), (7, 1000)):
        assert found(spark, rows, trie.Layout(chunk=2, leaves=leaves, entries=entries), 7) == brute(rows)


def test_long_and_equal_conversations_in_chunks(spark):
    long_ = [(c, t, "user", f"turn {t}") for c in (20, 40, 60) for t in range(95)]
    rows = long_ + [(80, t, "user", f"turn {t}") for t in range(60)] + [(100, t, "user", f"turn {t if t < 50 else -t}") for t in range(90)]
    rows += [(c, t, "assistant", "same") for c in range(200, 260) for t in range(3)]
    assert found(spark, rows, trie.Layout(chunk=8, leaves=4, entries=9)) == brute(rows)


def test_nulls_ties_repeats_empty_and_very_long_texts(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 1, "assistant", "b"), (7, 0, "", ""), (8, 3, "user", "x \t\x0b y z"),
        (None, 0, "user", "lost"), (-3, 0, "user", "hi"), (-3, 1, None, "w " * 200_000), (61, 0, "user", "a"), (62, 0, "user", "a"), (21, 2, "r", "t"),
    ]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(5, 0, "user", "x")], [(1, 0, "user", "one turn that its head takes")]])
def test_no_or_one_conversation(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = talk(3, range(30), ["a", "b"], 5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "m", "n", "path", "part", "id", "digest", "words", "tail"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    assert {tuple(r) for r in trie.trie(*trie.rebuilt(df)).collect()} == brute(rows)
