"""JSON datasets of any size, each file read by as many tasks as it has byte ranges.

Spark cuts text files at a separator; with ``}`` as the separator the pieces of a range are small, and no range starts
inside a character or an escape. What a range does to the state of a JSON reader (inside a string or not, depth) is
worked out for both states it may start in; one row per range, put together in file order, tells the state
that each range really starts in. Then

* the keys of an envelope are read from what lies outside nested values, to find the range of its ``rawLogs``;
* every range cuts its own rows, in a stream. A row that goes on in the next range is put together afterwards.

The driver holds a few numbers per range, as it does anyway to plan a scan. Row numbers come from counts per range.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklane.session import settle
from tracklane.sources.jsontext import row_spans

BLOCK = 4 << 20
TASK_BYTES = 32 << 20
RANGE_SETTING = "spark.sql.files.maxPartitionBytes"
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[list(b"{}[],")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
ROWS = "rawLogs"


class Marks:
    """Brackets and commas of a block of JSON text, and whether each is outside strings if the block starts outside."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(self.bytes == 0x22)
        if len(quotes):
            plain = np.where(self.bytes == 0x5C, -1, np.arange(len(self.bytes)))
            before = np.concatenate([[-1], np.maximum.accumulate(plain)])[quotes]  # last place before that is no backslash
            quotes = quotes[(quotes - 1 - before) % 2 == 0]
        self.at = np.flatnonzero(_STRUCTURE[self.bytes])
        self.outside = np.searchsorted(quotes, self.at) % 2 == 0
        self.flips = len(quotes) % 2 == 1

    def of(self, inside: bool) -> np.ndarray:
        """Places of marks outside strings."""
        return self.at[self.outside != inside]


@dataclass
class Effect:
    """What a range does if it starts inside a string or not; its last ``}`` is left out, the text may end without."""

    inside: bool
    depth: int = 0
    lowest: int = 0
    commas: int = 0  # at the lowest depth

    def take(self, marks: Marks) -> None:
        places = marks.of(self.inside)
        steps = _STEP[marks.bytes[places]]
        depths = self.depth + np.cumsum(steps)
        if len(depths):
            low = min(int(depths.min()), self.lowest)
            at_low = int(((depths == low) & (steps == 0)).sum())
            self.commas = at_low + (self.commas if low == self.lowest else 0)
            self.lowest, self.depth = low, int(depths[-1])
        self.inside ^= marks.flips


@dataclass
class Start:
    """State at the start of a range; ``ends`` says whether its last piece is followed by a ``}``."""

    inside: bool
    depth: int
    ends: bool = True


@dataclass
class File:
    """How a file is to be read. ``form``: rows are values at the top (``values``), elements of an array at the top
    (``array``) or of ``rawLogs`` (``envelope``, between ``first`` and ``last``: range start and place in the range)."""

    form: str
    starts: dict[int, Start] = field(default_factory=dict)
    first: tuple[int, int] | None = None
    last: tuple[int, int] | None = None
    error: str | None = None

    def sent(self) -> tuple:
        """The file as plain values and arrays: what tasks get is read there without this package, once in every task."""
        at = sorted(self.starts)
        states = [(x.inside, x.depth, x.ends) for x in map(self.starts.get, at)]
        return self.form, self.first, self.last, np.array(at, np.int64), np.array(states, np.int64).reshape(-1, 3)


class Range:
    """One range of a file as it was sent; ``state`` is None if the file has no such range."""

    def __init__(self, file: tuple | None, start: int):
        self.state = None
        if file is None:
            return
        self.form, self.first, self.last, starts, states = file
        i = int(np.searchsorted(starts, start))
        if i < len(starts) and starts[i] == start:
            inside, depth, ends = states[i].tolist()
            self.state = Start(bool(inside), depth, bool(ends))
            self.is_first, self.is_last = i == 0, i == len(starts) - 1


def _pieces(spark: SparkSession, path: str, range_bytes: int | None) -> DataFrame:
    """Pieces in file order. Where ranges are small, a task reads several, one after the other."""
    text = spark.read.option("lineSep", "}").text(path)
    if range_bytes is not None and range_bytes < TASK_BYTES:
        tasks = -(-text.rdd.getNumPartitions() * range_bytes // TASK_BYTES)
        text = text.coalesce(max(tasks, spark.sparkContext.defaultParallelism))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[tuple[bytes, bool]]]]:
    """(file, start, blocks) of the ranges in a task; a block is bytes and whether it is the last. The last block ends
    before the ``}`` of its last piece."""
    rows = ((f, s, v) for b in batches for f, s, v in zip(*(c.to_pylist() for c in b.columns)))
    held = next(rows, None)

    def blocks(file: str, start: int) -> Iterator[tuple[bytes, bool]]:
        nonlocal held
        parts, size = [], 0
        while True:
            value, held = held[2], next(rows, None)
            parts.append(value)
            size += len(value) + 1
            if held is None or held[:2] != (file, start):
                yield b"}".join(parts), True
                return
            if size >= BLOCK:
                yield b"}".join([*parts, b""]), False
                parts, size = [], 0

    while held is not None:
        file, start = held[:2]
        made = blocks(file, start)
        yield file, start, made
        for _ in made:  # whatever was not read
            pass


_EFFECT = "inside{0} boolean, depth{0} bigint, lowest{0} bigint, commas{0} bigint"


def _effects(spark: SparkSession, path: str, range_bytes: int | None) -> dict[str, list[tuple]]:
    """Per file, its ranges in order: (start, first sign, effect from outside, effect from inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, blocks in _ranges(batches):
            both, sign = (Effect(False), Effect(True)), b""
            for data, _ in blocks:
                marks = Marks(data)
                sign = sign or data.lstrip()[:1]
                for e in both:
                    e.take(marks)
            numbers = {f"{n}{i}": [getattr(e, n)] for i, e in enumerate(both) for n in ("inside", "depth", "lowest", "commas")}
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "sign": [sign.decode("utf-8", "replace")], **numbers})

    schema = f"file string, start bigint, sign string, {_EFFECT.format(0)}, {_EFFECT.format(1)}"
    found = defaultdict(list)
    for r in _pieces(spark, path, range_bytes).mapInArrow(run, schema).collect():
        found[r["file"]].append((r["start"], r["sign"], Effect(*r[3:7]), Effect(*r[7:11])))
    return {file: sorted(rows, key=lambda r: r[0]) for file, rows in found.items()}


def composed(ranges: list[tuple]) -> File:
    """The form of a file and the state at the start of each of its ranges."""
    sign = next((s for _, s, *_ in ranges if s), "")
    out, inside, depth, commas = File("values"), False, 0, 0
    for i, (start, _, *effects) in enumerate(ranges):
        effect, last = effects[inside], i == len(ranges) - 1
        out.starts[start] = Start(inside, depth)
        if depth + effect.lowest < 0:
            out.error = "more brackets close than open"
        elif depth + effect.lowest == 0:
            commas += effect.commas
        inside, depth = effect.inside, depth + effect.depth
        if not last:
            depth -= not inside
            if depth < 0:
                out.error = "more brackets close than open"
        elif depth == 0 and not inside:
            out.starts[start].ends = False
        elif inside or depth != 1:
            out.error = "the text ends inside a value"
    if not sign:
        out.error = out.error or "empty"
    if not commas and sign in "{[" and sign:
        out.form = "array" if sign == "[" else "envelope"
    return out


def _skeletons(spark: SparkSession, path: str, files: dict[str, File], range_bytes: int | None) -> None:
    """Finds ``rawLogs`` in files that are one object, from what lies outside their nested values."""
    wanted = {f: x.sent() for f, x in files.items() if x.form == "envelope" and not x.error}
    if not wanted:
        return
    sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, blocks in _ranges(batches):
            state = Range(sent.value.get(file), start).state
            if state is None:
                continue
            inside, depth, base, out = state.inside, state.depth, 0, []
            for data, last in blocks:
                data = data + b"}" if last and state.ends else data
                marks = Marks(data)
                places = marks.of(inside)
                depths = depth + np.cumsum(_STEP[marks.bytes[places]])
                before = np.concatenate([[depth], depths[:-1]]) if len(depths) else depths
                outer = depth <= 1
                at = 0
                for place, opens in zip(places[(before <= 1) != (depths <= 1)].tolist(), (depths > before)[(before <= 1) != (depths <= 1)].tolist()):
                    if opens:
                        out.append((base + at, data[at : place + 1]))
                    at, outer = place, not opens
                if outer:
                    out.append((base + at, data[at:]))
                inside, depth, base = inside ^ marks.flips, int(depths[-1]) if len(depths) else depth, base + len(data)
            yield pa.RecordBatch.from_pydict({  # ranges of a task have one schema, with nothing found too
                "file": pa.array([file] * len(out), pa.string()), "start": pa.array([start] * len(out), pa.int64()),
                "at": pa.array([a for a, _ in out], pa.int64()), "text": pa.array([t for _, t in out], pa.binary()),
            })

    places = F.sort_array(F.collect_list(F.struct("start", "at", "text")))
    found = _pieces(spark, path, range_bytes).mapInArrow(run, "file string, start bigint, at bigint, text binary").groupBy("file").agg(places.alias("parts"))
    for r in found.select("file", "parts").toLocalIterator():  # keys and plain values of an envelope
        whole, spots = b"", []
        for p in r["parts"]:
            spots.append((len(whole), p["start"], p["at"]))
            whole += bytes(p["text"])
        _locate(files[r["file"]], whole, spots)


_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\[')


def _locate(file: File, text: bytes, spots: list[tuple[int, int, int]]) -> None:
    marks = Marks(text)
    opens = {int(p) for p in marks.of(False) if text[p : p + 1] == b"["}

    def place(at: int) -> tuple[int, int]:
        offset, start, rel = max(s for s in spots if s[0] <= at)
        return start, rel + at - offset

    for m in _KEY.finditer(text):
        at = m.end() - 1
        if at in opens and json.loads(b'"' + m[1] + b'"') == ROWS:
            file.first, file.last = place(at), place(text.index(b"]", at))


def _plans(spark: SparkSession, path: str, range_bytes: int | None) -> dict[str, File]:
    files = {name: composed(ranges) for name, ranges in _effects(spark, path, range_bytes).items()}
    _skeletons(spark, path, files, range_bytes)
    return files


_STRETCH = {"file": pa.string(), "start": pa.int64(), "seq": pa.int64(), "no": pa.int64(), "opens": pa.bool_(), "closes": pa.bool_(), "row": pa.bool_(), "text": pa.binary()}


class Cutter:
    """Cuts one range into stretches: rows, or parts of one at the edges of the range, and what lies around them."""

    def __init__(self, name: str, start: int, file: Range):
        self.name, self.start, self.file, self.state = name, start, file, file.state
        self.out: list[tuple] = []
        self.seq = self.no = 0
        self.closes = file.form == "values" and file.is_last
        self.opened = file.form == "values" and file.is_first
        self.in_rows = {
            "values": True, "array": self.state.depth > 0, "envelope": file.first is not None and file.first < (start, 0) <= file.last,
        }[file.form]

    def _put(self, text: bytes, closes: bool) -> None:
        opens = self.opened and self.in_rows
        self.out.append((self.name, self.start, self.seq, self.no if opens else -1, opens, closes and self.in_rows, self.in_rows, text))
        self.seq, self.no = self.seq + 1, self.no + opens
        self.opened = self.in_rows

    def _cuts(self, marks: Marks, places: np.ndarray, depths: np.ndarray, base: int) -> list[tuple[int, str]]:
        """(place, kind) in order; kind: a comma between rows, or the bracket before the first or behind the last."""
        level = {"values": 0, "array": 1, "envelope": 2}[self.file.form]
        signs = marks.bytes[places]
        found = [(p, ",") for p in places[(depths == level) & (signs == 0x2C)].tolist()]
        if level == 1:
            found += [(p, "[") for p in places[(depths == 1) & (signs == 0x5B)].tolist()]
            found += [(p, "]") for p in places[(depths == 0) & (signs == 0x5D)].tolist()]
        elif level == 2:
            for kind, (start, at) in (("[", self.file.first), ("]", self.file.last)):
                if start == self.start and base <= at < base + len(marks.bytes):
                    found.append((at - base, kind))
        return sorted(found)

    def stretches(self, blocks: Iterator[tuple[bytes, bool]]) -> Iterator[pa.RecordBatch]:
        inside, depth, base, rest = self.state.inside, self.state.depth, 0, b""
        for data, last in blocks:
            data = data + b"}" if last and self.state.ends else data
            marks, at = Marks(data), 0
            places = marks.of(inside)
            depths = depth + np.cumsum(_STEP[marks.bytes[places]])
            for cut, kind in self._cuts(marks, places, depths, base):
                if kind == "[" and not self.in_rows:
                    self._put(rest + data[at : cut + 1], False)
                    rest, at, self.in_rows, self.opened = b"", cut + 1, True, True
                elif kind == "]" and self.in_rows:
                    self._put(rest + data[at:cut], True)
                    rest, at, self.in_rows = b"", cut, False
                elif kind == "," and self.in_rows:
                    self._put(rest + data[at:cut], True)
                    rest, at = b"", cut + 1
            rest += data[at:]
            if not self.in_rows and len(rest) > BLOCK:
                self._put(rest, False)
                rest = b""
            inside, depth, base = inside ^ marks.flips, int(depths[-1]) if len(depths) else depth, base + len(data)
            if len(self.out) >= 2000:
                yield self._flushed()
        self._put(rest, self.closes)  # an empty one too: the next range goes on from it
        yield self._flushed()

    def _flushed(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _STRETCH.values())], names=list(_STRETCH))


def _stretches(spark: SparkSession, path: str, files: dict[str, File], range_bytes: int | None) -> DataFrame:
    sent = spark.sparkContext.broadcast({n: f.sent() for n, f in files.items() if not f.error})  # a few numbers per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, blocks in _ranges(batches):
            file = Range(sent.value.get(name), start)
            if file.state is not None:
                yield from Cutter(name, start, file).stretches(blocks)

    return _pieces(spark, path, range_bytes).mapInArrow(run, "file string, start bigint, seq bigint, no bigint, opens boolean, closes boolean, row boolean, text binary")


def _joined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches put together in order; what is put together is one row, or one envelope without its rows."""
    listed = F.sort_array(F.collect_list(F.struct("start", "seq", "no", "text")))
    return parts.groupBy(*keys).agg(listed.alias("parts")).select(
        *keys, F.get("parts", F.lit(0))["start"].alias("start"), F.get("parts", F.lit(0))["no"].alias("no"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["text"])).alias("text"),
    )


@dataclass(frozen=True)
class Cut:
    """``rows``: file, pos, row, error (a row is null where there is an error, its pos where it is about the file).
    ``around``: file and ``text``, a dataset without its rows. ``ranges``: how many were read."""

    rows: DataFrame
    around: DataFrame
    ranges: int


def cut(spark: SparkSession, path: str, range_bytes: int | None = None) -> Cut:
    """Rows of every dataset under ``path``: the elements of ``rawLogs`` of an envelope or of an array, one object, or
    several values separated by commas. Ranges have ``range_bytes``, or as many as Spark gives a task. All scans of the
    files are done when this returns."""
    if range_bytes is None:
        return _cut(spark, path)
    before = spark.conf.get(RANGE_SETTING)
    spark.conf.set(RANGE_SETTING, str(range_bytes))
    try:
        return _cut(spark, path, range_bytes)
    finally:
        spark.conf.set(RANGE_SETTING, before)


def _cut(spark: SparkSession, path: str, range_bytes: int | None = None) -> Cut:
    files = _plans(spark, path, range_bytes)
    whole = {name for name, f in files.items() if f.form == "envelope" and f.first is None}
    for name in whole:
        files[name].form = "values"  # one row, or what its rawLogs is instead of an array
    found = settle(_stretches(spark, path, files, range_bytes))
    rows = found.where("row")
    edges = rows.where("NOT (opens AND closes)")
    group = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("start", "seq"))  # two of a range at most
    edges = _joined(edges.withColumn("group", group), ["file", "group"])
    every = rows.where("opens AND closes").select("file", "start", "no", "text").unionByName(edges.select("file", "start", "no", "text"))
    sizes = rows.groupBy("file", "start").agg(F.sum(F.col("opens").cast("bigint")).alias("n"))
    before = settle(sizes.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before")))
    placed = every.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("no")).alias("pos"), F.col("text").cast("string").alias("text"))

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, pos, text in zip(batch["file"], batch["pos"], batch["text"]):
                text = text.strip(" \t\r\n")
                if not text and pos == 0:
                    continue  # the only place of an empty array
                error = _problem(text)
                spans = row_spans(text) if not error and file in whole else [(0, len(text))]
                out += [(file, pos + i, None if error else text[a:b], error) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["file", "pos", "row", "error"])

    schema = "file string, pos bigint, row string, error string"
    good = placed.mapInPandas(checked, schema)
    around = _joined(found.where("NOT row"), ["file"]).select("file", F.col("text").cast("string").alias("text"))

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [(f, None, None, p) for f, t in zip(batch["file"], batch["text"]) if t.strip() and (p := _problem(t))]
            yield pd.DataFrame(bad, columns=["file", "pos", "row", "error"])

    broken = spark.createDataFrame([(n, None, None, f.error) for n, f in files.items() if f.error], schema)
    return Cut(good.unionByName(around.mapInPandas(framed, schema)).unionByName(broken), around, sum(len(f.starts) for f in files.values()))


def _problem(text: str) -> str | None:
    try:
        json.loads(text)
    except ValueError as e:
        return str(e)
    return None
