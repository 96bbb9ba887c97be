"""Ordered scans over per-vehicle histories of any length.

A window over ``partitionBy(vehicle)`` puts a whole vehicle into one task. That is right for a normal
history and fails when one vehicle (or the "unknown vehicle" bucket) holds a large share of all rows.
So the rows per key are counted first. Where no key is long, a scan is one plain window. Otherwise the
long histories are cut into *chunks* that follow each other in time and windows run per ``(key, chunk)``:

1. rows are windowed inside their chunk (one shuffle on ``(key, chunk)``);
2. the last row of each chunk gives the chunk's closing state (one row per chunk);
3. a small window over those rows gives the state each chunk starts from;
4. that state is joined back on ``(key, chunk)``, which needs no new shuffle of the big side.

Results do not depend on whether or how a history is cut.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000
CHUNK = "_chunk"
WHOLE = "_whole"
_KEY = "_key"
_PARTS = 1_000_000
# Size bound of the broadcast lists of long histories and busy slots. It only limits how many of them
# are cut, never which rows are returned.
LIST_ROWS = 50_000


@dataclass(frozen=True)
class Track:
    """How one history is keyed, ordered and cut.

    ``time`` must be an integer column; ``ties`` make the order total. A history of more than
    ``max_rows`` rows is cut at every ``slot`` of time, and slots above ``max_rows`` are cut further
    over their own time range.
    """

    keys: tuple[str, ...] = ("vehicle_id",)
    time: str = "event_ms"
    ties: tuple[str, ...] = ("event_id",)
    slot: int = DAY_MS
    max_rows: int = 2_000_000

    def by(self, **changes) -> "Track":
        return replace(self, **changes)


def _stand_in(dtype: T.DataType) -> Column:
    """A value that takes the place of a NULL key, so that joins on keys keep those rows."""
    if isinstance(dtype, T.StringType):
        return F.lit("\x00")
    return F.lit(-(2**62)).cast(dtype) if isinstance(dtype, T.LongType) else F.lit(-(2**31)).cast(dtype)


def key_columns(track: Track) -> list[str]:
    return [f"{_KEY}{i}" for i in range(len(track.keys))]


def keyed(df: DataFrame, track: Track) -> DataFrame:
    """Add NULL-free copies of the key columns, fit for joins."""
    keys = key_columns(track)
    if all(k in df.columns for k in keys):
        return df
    safe = [F.coalesce(F.col(k), _stand_in(df.schema[k].dataType)).alias(a) for k, a in zip(track.keys, keys)]
    return df.select("*", *safe)


def chunked(df: DataFrame, track: Track) -> DataFrame:
    """Add NULL-free key columns and, if some history is long, the chunk number (rising with time)."""
    if CHUNK in df.columns or WHOLE in df.columns:
        return df
    keys = key_columns(track)
    base = keyed(df, track)
    slotted = base.select("*", F.coalesce(F.expr(f"`{track.time}` div {track.slot}"), F.lit(-(2**40))).alias("_cut_slot"))
    long = _small_list(
        slotted.groupBy(*keys).agg(F.count("*").alias("_cut_n")).filter(F.col("_cut_n") > track.max_rows), [*keys]
    )
    if long is None:
        return base.select("*", F.lit(True).alias(WHOLE))
    span = F.col("_cut_hi") - F.col("_cut_lo") + 1
    busy = _small_list(
        slotted.join(F.broadcast(long), keys, "left_semi").groupBy(*keys, "_cut_slot")
        .agg(F.count("*").alias("_cut_n"), F.min(track.time).alias("_cut_lo"), F.max(track.time).alias("_cut_hi"))
        .filter((F.col("_cut_n") > track.max_rows) & (F.col("_cut_hi") > F.col("_cut_lo")))
        # four times as many parts as needed, to take up uneven spread inside the slot
        .withColumn("_cut_step", F.greatest(F.ceil(span / (F.ceil(F.col("_cut_n") / track.max_rows) * 4)), F.lit(1))),
        [*keys, "_cut_slot", "_cut_lo", "_cut_step"],
    )
    cut = slotted.join(F.broadcast(long.withColumn("_cut_long", F.lit(True))), keys, "left")
    part = F.lit(0)
    if busy is not None:
        cut = cut.join(F.broadcast(busy), [*keys, "_cut_slot"], "left")
        part = F.expr(f"least(coalesce((`{track.time}` - _cut_lo) div _cut_step, 0), {_PARTS - 1})")
    chunk = F.when(F.col("_cut_long"), F.col("_cut_slot") * _PARTS + part).otherwise(F.lit(0))
    return cut.select(*base.columns, chunk.alias(CHUNK))


def _small_list(counts: DataFrame, columns: list[str]) -> DataFrame | None:
    """The fullest ``LIST_ROWS`` groups as a small table, fit for a broadcast; None if there are none.

    Groups have more than ``max_rows`` rows each, so even the largest tables have few of them. A group
    left out of the list is only cut less finely.
    """
    rows = counts.orderBy(F.desc("_cut_n")).limit(LIST_ROWS).select(*columns).collect()
    return counts.sparkSession.createDataFrame(rows, counts.select(*columns).schema) if rows else None


def unchunked(df: DataFrame) -> DataFrame:
    """Drop the helper columns of :func:`chunked`."""
    return df.drop(*[c for c in df.columns if c in (CHUNK, WHOLE) or c.startswith(_KEY)])


def lane_columns(df: DataFrame, track: Track) -> list[str]:
    """The columns windows over a chunked history are partitioned by."""
    return [*key_columns(track), CHUNK] if CHUNK in df.columns else key_columns(track)


def _order(track: Track, reverse: bool = False) -> list[Column]:
    cols = [F.col(c) for c in (track.time, *track.ties)]
    return [c.desc() if reverse else c.asc() for c in cols]


def scan(
    df: DataFrame,
    track: Track,
    prior: dict[str, tuple[Column, Column | None]] | None = None,
    running: dict[str, Column] | None = None,
    prior_max: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """One pass in time order over every history.

    * ``prior``: ``{name: (value, condition)}`` - value of the latest *earlier* row that meets the
      condition (any row if it is None); NULL when there is none. A NULL value on such a row counts.
    * ``running``: ``{name: number}`` - running sum up to and including the row.
    * ``prior_max``: ``{name: value}`` - largest value on earlier rows.
    * ``first``: ``{name: value}`` - value on the first row of the history.

    ``reverse`` walks from the end, so ``prior`` then looks at later rows and ``first`` is the last row.
    """
    prior, running, prior_max, first = prior or {}, running or {}, prior_max or {}, first or {}
    base = chunked(df, track)
    lanes = lane_columns(base, track)
    inside = Window.partitionBy(*lanes).orderBy(*_order(track, reverse))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = CHUNK in base.columns

    marks = {n: F.when(F.lit(True) if c is None else c, F.struct(v.alias("v"))) for n, (v, c) in prior.items()}
    local = base.select(
        *[F.col(c) for c in base.columns],
        *[m.alias(f"_m_{n}") for n, m in marks.items()],
        *[v.alias(f"_r_{n}") for n, v in running.items()],
        *[v.alias(f"_x_{n}") for n, v in prior_max.items()],
        *[F.struct(v.alias("v")).alias(f"_f_{n}") for n, v in first.items()],
    )
    windowed = local.select(
        *local.columns,
        *[F.last(f"_m_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in prior],
        *[F.sum(f"_r_{n}").over(upto).alias(f"_s_{n}") for n in running],
        *[F.max(f"_x_{n}").over(before).alias(f"_t_{n}") for n in prior_max],
        *[F.first(f"_f_{n}").over(upto).alias(f"_g_{n}") for n in first],
        *([F.lead(F.lit(1)).over(inside).isNull().alias("_last")] if cut else []),
    )
    if not cut:
        return windowed.select(
            *base.columns,
            *[F.col(f"_p_{n}")["v"].alias(n) for n in prior],
            *[F.col(f"_s_{n}").alias(n) for n in running],
            *[F.col(f"_t_{n}").alias(n) for n in prior_max],
            *[F.col(f"_g_{n}")["v"].alias(n) for n in first],
        )
    keys = key_columns(track)
    closing = windowed.filter("_last").select(
        *keys,
        CHUNK,
        *[F.coalesce(F.col(f"_m_{n}"), F.col(f"_p_{n}")).alias(f"_cp_{n}") for n in prior],
        *[F.col(f"_s_{n}").alias(f"_cs_{n}") for n in running],
        *[F.greatest(F.col(f"_x_{n}"), F.col(f"_t_{n}")).alias(f"_ct_{n}") for n in prior_max],
        *[F.col(f"_g_{n}").alias(f"_cf_{n}") for n in first],
    )
    chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    earlier = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    opening = closing.select(
        *keys,
        CHUNK,
        *[F.last(f"_cp_{n}", ignorenulls=True).over(earlier).alias(f"_op_{n}") for n in prior],
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_os_{n}") for n in running],
        *[F.max(f"_ct_{n}").over(earlier).alias(f"_ot_{n}") for n in prior_max],
        *[F.first(f"_cf_{n}").over(earlier).alias(f"_of_{n}") for n in first],
    )
    return windowed.join(opening, [*keys, CHUNK], "left").select(
        *base.columns,
        *[F.coalesce(F.col(f"_p_{n}"), F.col(f"_op_{n}"))["v"].alias(n) for n in prior],
        *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_os_{n}"), F.lit(0))).alias(n) for n in running],
        *[F.greatest(F.col(f"_t_{n}"), F.col(f"_ot_{n}")).alias(n) for n in prior_max],
        *[F.coalesce(F.col(f"_of_{n}"), F.col(f"_g_{n}"))["v"].alias(n) for n in first],
    )


def runs(df: DataFrame, track: Track, ident: str, previous: dict[str, str] | None = None) -> DataFrame:
    """Number the runs of equal ``ident`` (NULL equals NULL) inside each history.

    Adds ``run_idx`` (0-based), ``run_start`` (first row of a run), ``null_run_idx`` (0-based count
    over NULL runs, set on their rows) and, for ``previous = {new: column}``, the value of that column
    on the row just before, if that row belongs to the same run.
    """
    previous = previous or {}
    base = chunked(df, track)
    keys, lanes = key_columns(track), lane_columns(base, track)
    cut = CHUNK in base.columns
    inside = Window.partitionBy(*lanes).orderBy(*_order(track))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct(F.col(ident).alias("id"), *[F.col(c).alias(n) for n, c in previous.items()])

    local = base.select(
        *base.columns,
        row.alias("_row"),
        F.lag(row).over(inside).alias("_prev"),
        *([F.first(F.struct(F.col(ident).alias("id"))).over(upto).alias("_first"),
           F.lead(F.lit(1)).over(inside).isNull().alias("_last")] if cut else []),
    )
    # the first row of a chunk is settled below, once the row before it is known
    changed = F.col("_prev").isNotNull() & ~F.col("_prev.id").eqNullSafe(F.col(ident))
    local = local.select(
        "*", changed.cast("long").alias("_brk"), (changed & F.col(ident).isNull()).cast("long").alias("_nbrk")
    ).select("*", F.sum("_brk").over(upto).alias("_b"), F.sum("_nbrk").over(upto).alias("_nb"))
    if cut:
        closing = local.filter("_last").select(*keys, CHUNK, "_row", "_first", "_b", "_nb")
        by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
        earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
        edge = closing.select("*", F.lag("_row").over(by_chunk).alias("_before"))
        fresh = F.col("_before").isNull() | ~F.col("_before.id").eqNullSafe(F.col("_first.id"))
        edge = edge.select(
            "*", fresh.cast("long").alias("_fresh"), (fresh & F.col("_first.id").isNull()).cast("long").alias("_nfresh")
        )
        past = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
        opening = edge.select(
            *keys, CHUNK, "_before", "_fresh",
            (past(F.col("_fresh") + F.col("_b")) + F.col("_fresh")).alias("_ob"),
            (past(F.col("_nfresh") + F.col("_nb")) + F.col("_nfresh")).alias("_onb"),
        )
        joined = local.join(opening, [*keys, CHUNK], "left")
        before = F.coalesce(F.col("_prev"), F.col("_before"))
        fresh = F.col("_fresh") == 1
    else:
        # a history's first row opens its first run
        null_start = F.first(F.col(ident).isNull().cast("long")).over(upto)
        joined = local.select("*", F.lit(1).alias("_ob"), null_start.alias("_onb"))
        before = F.col("_prev")
        fresh = F.lit(True)
    starts = (F.col("_brk") == 1) | (F.col("_prev").isNull() & fresh)
    return joined.select(
        *base.columns,
        (F.col("_ob") + F.col("_b") - 1).alias("run_idx"),
        starts.alias("run_start"),
        F.when(F.col(ident).isNull(), F.col("_onb") + F.col("_nb") - 1).alias("null_run_idx"),
        *[F.when(~starts, before[n]).alias(n) for n in previous],
    )
