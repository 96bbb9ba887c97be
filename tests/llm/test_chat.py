"""Prefix-target expansion against plain Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklane.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string"
ROWS = [
    (1, 2, "assistant", "two"), (1, 1, "user", "one"), (1, 3, "user", "</s>[INST] x"), (1, 4, "assistant", r"<\s> [\\/INST] back\slash"),
    (2, 1, "user", None), (2, 2, "system", "no reply"), (3, 1, None, "nobody"), (3, None, "assistant", "first"),
    (4, 1, "assistant", ""), (4, 1, "assistant", ""), (None, 1, "assistant", "lost"), (5, 1, "assistant", "y" * 50_000), (5, 2, "us<s>er", "ü😀"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        body = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(spark):
    got = chat.digests(chat.expand(frame(spark))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == by_hand(ROWS)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    rows = chat.expand(frame(spark)).where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in rows] == [0, 1] and [r.complete for r in rows] == [False, True]
    assert rows[1].text.startswith(rows[0].text)
    assert rows[0].text[rows[0].loss_start : rows[0].loss_end] == "two"
    assert rows[0].text == "<s>[INST] user [/INST] one</s><s>[INST] assistant [/INST] two</s>"
    assert len(re.findall("<s>", rows[1].text)) == 4


def test_turns_behind_the_last_reply_are_kept_without_loss(spark):
    rows = chat.expand(frame(spark)).where("conv_id in (2, 5)").orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.complete, r.loss_start) for r in rows] == [(2, True, None), (5, False, 28), (5, True, None)]


def test_empty_table(spark):
    assert chat.digests(chat.expand(frame(spark, []))).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "\\", "s>", "/s>", "[", "]", "/INST]", "INST]", "a"]), max_size=12).map("".join), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in rows.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t and not re.search(r"</?s>|\[/?INST\]", e)
