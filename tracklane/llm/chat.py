r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all earlier turns as context, and only that reply trainable. Turns read
``<s>[INST] role [/INST] text</s>``. Where a role or text holds a control string, or one with backslashes behind
its first character, it gets one backslash more there; taking one away gives the text back.

The examples of a conversation are its prefixes, so their total length grows with the square of its turns; that
is what the operator asks for. They are made in a stream: a task holds one prefix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
GUARDED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
FLUSH_CHARS = 1 << 22


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, "$1$2$3")


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text): conv_id, ``example`` (from 0), ``text``, ``loss_start``
    and ``loss_end`` (code points of the trainable part, its end exclusive), ``complete`` (holds all turns).

    Turns are taken in ascending order, null first; equal ones by role and text. Null roles and texts are empty.
    Rows without a conversation form one. Turns behind the last reply, or a conversation without any, give one
    more example without a trainable part, so that the output holds every turn.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(
            "conv_id", (F.col("role") == "assistant").alias("reply"),
            F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST] ")).alias("head"), escape(F.col("text")).alias("text"),
        )
    )
    names = ["conv_id", "example", "text", "loss_start", "loss_end", "complete"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        chars, id_type = 0, None
        now, prefix, example, held = None, None, 0, None

        def flushed() -> pa.RecordBatch:
            nonlocal out, chars
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out, chars = [[] for _ in names], 0
            return batch

        def put(row: tuple, complete: bool) -> None:
            nonlocal chars
            for column, value in zip(out, (*row, complete)):
                column.append(value)
            chars += len(row[2])

        def closed() -> None:
            """The last example of a conversation."""
            if prefix is not None:
                put(held or (now, example, prefix, None, None), True)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, reply, head, body in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix is None or conv != now:
                    closed()
                    now, prefix, example, held = conv, "", 0, None
                elif held:
                    put(held, False)
                    held = None
                start = len(prefix) + len(head)
                prefix = f"{prefix}{head}{body}</s>"
                if reply:
                    held = (now, example, prefix, start, start + len(body))
                    example += 1
                if chars >= FLUSH_CHARS:
                    yield flushed()
        closed()
        if out[0]:
            yield flushed()

    schema = f"conv_id {kind}, example bigint, text string, loss_start bigint, loss_end bigint, complete boolean"
    return rows.mapInArrow(run, schema)


def digests(examples: DataFrame) -> DataFrame:
    """What each conversation's examples hold, read back from their texts and masks."""
    loss = unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))"))
    turn = r"(?s)<s>\[INST\] (.*?) \[/INST\] (.*?)</s>"
    turns = unescape(F.regexp_replace("text", turn, "$1\n$2\n"))
    whole = F.col("complete")
    parts = examples.select(
        "conv_id", "example", F.char_length("text").alias("chars"), loss.alias("loss"),
        F.when(whole, F.regexp_count("text", F.lit("<s>"))).alias("n_turns"), F.when(whole, F.sha2(turns, 256)).alias("turns_sha256"),
    )
    in_order = F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    return (
        parts.groupBy("conv_id")
        .agg(
            F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
            F.concat_ws("", F.transform(in_order, lambda p: p["loss"])).alias("loss"), F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        )
    )
