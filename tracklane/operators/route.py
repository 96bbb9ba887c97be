"""Routes: decoded paths, distances along a path, and traffic intervals."""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions import geo
from tracklane.plans.history import Track, scan

# Fixed values
NO_DATA, NORMAL = "STYLE_NO_DATA", "STYLE_NORMAL"

NUMBERS = T.ArrayType(T.DoubleType())
POINTS = pa.list_(pa.struct([("latitude", pa.float64()), ("longitude", pa.float64())]))
DECODED = "points array<struct<latitude: double, longitude: double>>, error string"


def _s2_points(text: str) -> list[tuple[float, float]] | None:
    """Points of the compact spherical form: version byte 1, count, then unit vectors."""
    if not re.fullmatch(r"[A-Za-z0-9_\-+/=]+", text):
        return None
    try:
        raw = base64.urlsafe_b64decode(text.replace("+", "-").replace("/", "_").rstrip("=") + "=" * (-len(text.rstrip("=")) % 4))
    except ValueError:
        return None
    if len(raw) < 5 or raw[0] != 1:
        return None
    (n,) = struct.unpack_from("<I", raw, 1)
    if n == 0 or len(raw) != 5 + 24 * n:
        return None
    xyz = np.frombuffer(raw, dtype="<f8", count=3 * n, offset=5).reshape(-1, 3)
    lat = np.degrees(np.arctan2(xyz[:, 2], np.hypot(xyz[:, 0], xyz[:, 1])))
    return list(zip(lat.tolist(), np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0])).tolist()))


def _varint_points(text: str) -> list[tuple[float, float]] | None:
    """Points of the delta text form: 5-bit groups, zig-zag signs, 1e-5 degrees."""
    codes = [ord(c) - 63 for c in text]
    if any(c < 0 or c > 63 for c in codes):
        return None
    deltas, value, shift = [], 0, 0
    for c in codes:
        value |= (c & 31) << shift
        shift += 5
        if c < 32:
            deltas.append(-(value >> 1) - 1 if value & 1 else value >> 1)
            value, shift = 0, 0
    if shift or len(deltas) % 2 or not deltas:
        return None
    total = np.cumsum(np.array(deltas, dtype=np.int64).reshape(-1, 2), axis=0)
    return [(a / 1e5, o / 1e5) for a, o in total.tolist()]


# Braces, and a named coordinate with its number; names may be quoted or bare.
_LIST_TOKEN = re.compile(r"""[{}]|["']?\b(latitude|longitude)\b["']?\s*:\s*([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)(?=\s*[,}\s])""")


def _listed_points(text: str) -> list[tuple[float, float]] | None:
    """Points written out as objects: the two coordinates that stand between the braces of each."""
    points, open_ = [], []
    for token in _LIST_TOKEN.finditer(text):
        if token[0] == "{":
            open_.append({})
        elif token[0] == "}":
            if not open_:
                return None
            found = open_.pop()
            if len(found) == 2 and not open_:
                points.append((found["latitude"], found["longitude"]))
        elif open_:
            open_[-1][token[1]] = float(token[2])
    return None if open_ else points or None


# The usual object of a list: both coordinates and nothing else.
_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
_PAIR = rf"""\{{\s*["']?latitude["']?\s*:\s*{_NUMBER}\s*,\s*["']?longitude["']?\s*:\s*{_NUMBER}\s*\}}"""
_LAT, _LNG = "\x01", "\x02"  # signs around the numbers of a pair
_ODD = "[{}\x01\x02]"


def _plain_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of all texts at once: which are lists whose objects are all of the usual form, how many points each of them has
    (0 for the others), and the coordinates. No brace is left between the objects then, so ``_listed_points`` gives the same."""
    marked = pc.replace_substring_regex(texts, pattern=_PAIR, replacement=f"{_LAT}\\1{_LNG}\\2{_LAT}")
    parts = pc.split_pattern(marked, _LAT)  # between, pair, between, pair, ..., between
    sizes = np.asarray(pc.fill_null(pc.list_value_length(parts), 0))
    flat, firsts = parts.flatten(), np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    is_pair = (np.arange(len(row)) - firsts[row]) % 2 == 1
    odd = np.zeros(len(sizes), bool)
    odd[row[~is_pair][np.asarray(pc.match_substring_regex(flat.filter(pa.array(~is_pair)), _ODD))]] = True
    odd |= np.asarray(pc.fill_null(pc.match_substring_regex(texts, f"[{_LAT}{_LNG}]"), False))
    starts = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"^\s*[\[{]"), False))
    plain = starts & ~odd & (sizes > 1)
    pairs = pc.split_pattern(flat.filter(pa.array(is_pair & plain[row])), _LNG).flatten()
    try:
        numbers = np.asarray(pairs.cast(pa.float64()))
    except pa.ArrowInvalid:  # a number beyond doubles
        return None
    return plain, np.where(plain, sizes // 2, 0), numbers[::2], numbers[1::2]


def decode_path(text: str | None) -> tuple[list[tuple[float, float]] | None, str | None]:
    """Points and error of one path. A list is told by its first sign, the compact form by its version byte and
    exact length; what is neither is read as delta text."""
    if text is None:
        return None, None
    text = text.strip()
    points = _listed_points(text) if text[:1] in ("[", "{") else None
    if points is None:
        points = _s2_points(text) or _varint_points(text)
    return (points, None) if points else (None, "not a path")


def decode_paths(path: Column) -> Column:
    """``{points, error}`` of an encoded path column (compact, delta text, JSON list or loose text)."""

    @F.arrow_udf(DECODED)
    def run(texts: pa.Array) -> pa.Array:
        none = np.zeros(0)
        plain, sizes, lats, lngs = _plain_lists(texts) or (np.zeros(len(texts), bool), np.zeros(len(texts), np.int64), none, none)
        other = np.flatnonzero(~plain)
        errors, void = pa.nulls(len(texts), pa.string()), None
        if len(other):
            done = [decode_path(t) for t in texts.take(pa.array(other)).to_pylist()]
            sizes = sizes.copy()
            sizes[other] = [len(points or ()) for points, _ in done]
            row = np.repeat(np.arange(len(texts)), sizes)
            both = np.empty((len(row), 2))
            both[plain[row], 0], both[plain[row], 1] = lats, lngs
            both[~plain[row]] = np.array([p for points, _ in done for p in points or ()], float).reshape(-1, 2)
            lats, lngs = both[:, 0], both[:, 1]
            void = np.zeros(len(texts), bool)
            void[other] = [points is None for points, _ in done]
            said = np.full(len(texts), None, object)
            said[other] = [error for _, error in done]
            errors = pa.array(said, pa.string())
        # Coordinates stay flat arrays of the batch, without an object for each point.
        pairs = pa.StructArray.from_arrays([pa.array(lats, pa.float64()), pa.array(lngs, pa.float64())], fields=list(POINTS.value_type))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        starts = pa.array(ends, pa.int32(), mask=None if void is None else np.append(void, False))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, pairs, POINTS), errors], names=["points", "error"])

    return run(path)


def route_of_row(api: Column, response_route: Column, request_route: Column, carried_route: Column) -> Column:
    """Route to show for a row: trip calls bring theirs, vehicle rows use their own or the carried one."""
    trip_call = F.lower(api).isin("gettrip", "updatetrip", "createtrip")
    return F.coalesce(F.when(trip_call, response_route), request_route, carried_route)


def path_measure(points: DataFrame, track: Track) -> DataFrame:
    """Length of the step to each path point and the distance from the start of its path."""
    steps = scan(points, track, prior={"_was": (F.struct("lat", "lng"), None)})
    step = F.coalesce(geo.distance_m(F.col("_was.lat"), F.col("_was.lng"), F.col("lat"), F.col("lng")), F.lit(0.0))
    steps = steps.select(*[c for c in steps.columns if c != "_was"], step.alias("step_m"))
    return scan(steps, track, running={"along_m": F.col("step_m")}).select(*points.columns, "step_m", "along_m")


# --- one route per row: the path and its stretches are arrays of that row -------------------------


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of an Arrow array, and which of them are there; those that are not are NaN."""
    return np.array(pc.fill_null(values.cast(pa.float64()), np.nan)), np.asarray(values.is_valid())


def _along(lats: np.ndarray, lngs: np.ndarray, sizes: np.ndarray, radius: float) -> np.ndarray:
    """Distance of each point from the start of its row's path; NaN from a point without coordinates on."""
    firsts = np.cumsum(sizes) - sizes
    with np.errstate(invalid="ignore"):
        lat, lng = np.radians(lats), np.radians(lngs)
        h = np.sin(np.diff(lat) / 2) ** 2 + np.cos(lat[:-1]) * np.cos(lat[1:]) * np.sin(np.diff(lng) / 2) ** 2
        steps = np.zeros(len(lats))
        steps[1:] = 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    steps[firsts[sizes > 0]] = 0.0
    for n in np.unique(sizes[sizes > 1]):  # rows of one size at a time, each summed from its own start
        at = firsts[sizes == n][:, None] + np.arange(n)
        steps[at] = np.cumsum(steps[at], axis=1)
    return steps


def measured(points: Column, radius: float = geo.EARTH_RADIUS_M) -> Column:
    """Array of ``{latitude, longitude, m}`` with each point's distance from the start, in one pass."""

    @F.arrow_udf(NUMBERS)
    def along(lats: pa.Array, lngs: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lats), 0)).astype(np.int64)
        m = _along(_flat(lats.flatten())[0], _flat(lngs.flatten())[0], sizes, radius)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.append(np.asarray(lats.is_null()), False))
        return pa.ListArray.from_arrays(starts, pa.array(m, mask=np.isnan(m)))

    m = along(points["latitude"].cast("array<double>"), points["longitude"].cast("array<double>"))
    return F.zip_with(points, m, lambda p, d: F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), d.alias("m")))


def _edges(line: Column) -> Column:
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, F.lit(1), n).alias("a"), F.slice(line, F.lit(2), n).alias("b"))


def travelled_m(line: Column, lat: Column, lng: Column) -> Column:
    """Distance along a measured line of the place on it closest to a point."""
    east = F.cos(F.radians(lat))

    def place(e):
        bx, by = (e["b"]["longitude"] - e["a"]["longitude"]) * east, e["b"]["latitude"] - e["a"]["latitude"]
        px, py = (lng - e["a"]["longitude"]) * east, lat - e["a"]["latitude"]
        size = bx * bx + by * by
        part = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / size))).otherwise(F.lit(0.0))

        def measure(t):
            gap = (px - t * bx) * (px - t * bx) + (py - t * by) * (py - t * by)
            return F.struct(gap.alias("gap"), (e["a"]["m"] + (e["b"]["m"] - e["a"]["m"]) * t).alias("m"))

        return let(part, measure)

    return F.array_min(F.transform(_edges(line), place))["m"]


def _first_of(owners: np.ndarray, lows: np.ndarray, highs: np.ndarray, size: int, none: int) -> np.ndarray:
    """The smallest of ``owners`` whose range ``[low, high)`` holds a place, for each of ``size`` places; ``none`` if there
    is none. Each range is two of a power of two, and those are halved down to single places."""
    level = np.frexp((highs - lows).astype(float))[1] - 1
    best = np.full(size, none, np.int64)
    for k in range(int(level.max(initial=-1)), -1, -1):
        here, half = level == k, 1 << k
        np.minimum.at(best, lows[here], owners[here])
        np.minimum.at(best, highs[here] - half, owners[here])
        if k:
            wide, half = best, half >> 1
            best = wide.copy()
            best[half:] = np.minimum(best[half:], wide[:-half])
    return best


def _search(values: np.ndarray, low: np.ndarray, high: np.ndarray, before) -> np.ndarray:
    """The first place in each ``[low, high)`` whose value is not ``before``; by halves, since values ascend there."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        go_on = before(values[middle], open_)
        low[open_[go_on]], high[open_[~go_on]] = middle[go_on] + 1, middle[~go_on]
    return low


def _ragged(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` for each size, one behind the other."""
    return np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _cut(points: pa.Array, styles: pa.Array, offsets: pa.Array, lengths: pa.Array, gone: pa.Array) -> pa.Array:
    """Intervals of all routes of a batch at once, in their order along each route."""
    rows = len(points)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(points), 0)).astype(np.int64)
    firsts, flat = np.cumsum(sizes) - sizes, points.flatten()
    names = [f.name.lower() for f in flat.type]
    fields = pc.struct_field(flat, [names.index("latitude")]), pc.struct_field(flat, [names.index("longitude")])
    places = [_flat(f) for f in fields]
    m = _along(places[0][0], places[1][0], sizes, geo.EARTH_RADIUS_M)
    total = np.zeros(rows)
    total[sizes > 0] = m[(firsts + sizes - 1)[sizes > 0]]
    total[np.isnan(total)] = 0.0

    # Stretches, the travelled part first: row, start, end.
    many = np.asarray(pc.fill_null(pc.list_value_length(offsets), 0)).astype(np.int64)
    start, known = _flat(offsets.flatten())
    start = np.where(known, start, 0.0)
    length, known = _flat(lengths.flatten())
    length[known & np.isnan(length)] = np.inf  # NaN is greater than any number
    far = np.asarray(gone)
    ahead = np.flatnonzero(far > 0)
    row = np.concatenate([ahead, np.repeat(np.arange(rows), many)])
    start = np.concatenate([np.zeros(len(ahead)), start])
    end = start + np.concatenate([far[ahead], length])
    listed = pa.chunked_array([pc.fill_null(styles.flatten(), NORMAL), pa.array([NO_DATA, NORMAL])]).combine_chunks()
    style_of = np.concatenate([np.full(len(ahead), len(listed) - 2), np.arange(len(listed) - 2), [len(listed) - 1]])
    short = sizes < 2
    plain = short | (many + (far > 0) == 0)

    # Cuts of each row, ascending, equal ones once; a row without stretches keeps its two ends, even if equal.
    cut_row = np.concatenate([np.arange(rows), np.arange(rows), row, row])
    cut = np.concatenate([np.zeros(rows), total, start, end])
    used = (cut <= total[cut_row]) & ~plain[cut_row]
    used[: 2 * rows] = True
    taken = np.flatnonzero(used)
    order = taken[np.lexsort((cut[taken], cut_row[taken]))]
    r, c = cut_row[order], cut[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | plain[r[1:]]
    number = np.full(len(cut), -1)
    number[order] = np.cumsum(new) - 1
    r, c = r[new], c[new]
    last = np.searchsorted(r, np.arange(rows), side="right") - 1  # cut of each row
    is_interval = np.ones(len(r), bool)
    is_interval[last] = False

    # A stretch covers the intervals from its start to its end, or to the row's.
    at = 2 * rows
    low, high = number[at : at + len(row)], number[at + len(row) :]
    high = np.where(high < 0, np.where(end > total[row], last[row], low), high)
    covers = (low >= 0) & (low < high)
    best = _first_of(np.flatnonzero(covers), low[covers], high[covers], len(r), len(row))
    style = np.where(short[r], len(listed) - 2, style_of[best])

    # The place of each cut, on the first step that reaches it, or else the last point.
    begin, stop = firsts[r], (firsts + sizes)[r]
    reach = _search(m, begin, stop, lambda x, i: x < c[i])
    beyond = _search(m, begin, stop, lambda x, i: x <= c[i])
    b = np.maximum(reach, begin + 1)
    lost = b >= stop
    b[lost] = np.maximum(stop - 1, 0)[lost]
    if len(m):
        lost |= np.isnan(m[b])
        b[lost] = (stop - 1)[lost]
        a = np.where(lost, b, b - 1)
        span = m[b] - m[a]
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where(span > 0, (np.maximum(c, 0.0) - m[a]) / span, 0.0)
    i = np.flatnonzero(is_interval)
    inner = np.where(short[r[i]], sizes[r[i]], np.maximum(reach[i + 1] - beyond[i], 0))
    edge = np.where(short[r[i]], 0, 1)
    long = inner + 2 * edge
    ends = np.concatenate([[0], np.cumsum(long)])
    source = np.where(short[r[i]], firsts[r[i]], beyond[i])
    inside = _ragged(ends[:-1] + edge, inner), _ragged(source, inner)
    outer = np.flatnonzero(edge)
    coordinates = []
    for value, there in places:
        out, known = np.empty(int(ends[-1])), np.ones(int(ends[-1]), bool)
        out[inside[0]], known[inside[0]] = value[inside[1]], there[inside[1]]
        if len(outer):
            on = value[a] + (value[b] - value[a]) * part
            on[lost], both = value[b[lost]], there[a] & there[b]
            for to, k in ((ends[outer], i[outer]), (ends[outer + 1] - 1, i[outer] + 1)):
                out[to], known[to] = on[k], both[k]
        coordinates.append(pa.array(out, mask=~known))
    blank = np.zeros(int(ends[-1]), bool)
    if flat.null_count:  # a point that is not there stays so in a path that is handed on
        blank[inside[0]] = np.asarray(flat.is_null())[inside[1]] & np.repeat(short[r[i]], inner)
    pairs = pa.StructArray.from_arrays(coordinates, fields=list(POINTS.value_type), mask=pa.array(blank))
    path_starts = pa.array(ends, pa.int32(), mask=np.append(np.asarray(points.is_null())[r[i]], False))
    found = pa.StructArray.from_arrays(
        [pa.array(c[i]), pa.array(c[i + 1]), listed.take(pa.array(style[i])), pa.ListArray.from_arrays(path_starts, pairs, POINTS)],
        names=["start_m", "end_m", "style", "path"],
    )
    per_row = np.concatenate([[0], np.cumsum(np.bincount(r[i], minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), found)


INTERVALS = "array<struct<start_m: double, end_m: double, style: string, path: array<struct<latitude: double, longitude: double>>>>"


def route_intervals(
    rows: DataFrame, points: str, stretches: str, lat: Column | None = None, lng: Column | None = None
) -> DataFrame:
    """Styled intervals of routes held in one row each: ``start_m, end_m, style, path`` beside the other columns.

    ``points`` is an array of ``{latitude, longitude}``, ``stretches`` one of ``{style, offsetmeters,
    lengthmeters}``. A known current point puts the travelled part, as ``STYLE_NO_DATA``, ahead of the
    other stretches. Intervals are worked out on arrays, many routes at a time; the work of a route grows with
    its points and stretches times the logarithm of their number.
    """
    keep = [c for c in rows.columns if c not in (points, stretches)]
    line, gone = rows, F.lit(0.0)
    if lat is not None:
        line = rows.select("*", measured(F.col(points)).alias("_line"))
        line = line.select("*", F.coalesce(travelled_m(F.col("_line"), lat, lng), F.lit(0.0)).alias("_gone"))
        gone = F.col("_gone")
    s = F.col(stretches)
    numbers = (s["offsetmeters"].cast("array<double>"), s["lengthmeters"].cast("array<double>"))
    cut = F.arrow_udf(_cut, INTERVALS)(F.col(points), s["style"].cast("array<string>"), *numbers, gone)
    return line.select(*keep, F.inline(cut))
