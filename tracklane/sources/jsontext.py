"""Where the log rows of one dataset text are."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"\s*")

def _item_spans(text: str, at: int, close: str) -> tuple[list[tuple[int, int]], int]:
    """Spans of the values between ``at`` and the closing sign, or the end of the text for an empty one."""
    spans, end = [], _SPACE.match(text, at).end()
    if close and text[end : end + 1] == close:
        return spans, end + 1
    decode = json.JSONDecoder().raw_decode
    while True:
        start = end
        _, end = decode(text, start)
        spans.append((start, end))
        end = _SPACE.match(text, end).end()
        sign = text[end : end + 1]
        if sign == close:
            return spans, end + len(close)
        if sign != ",":
            raise ValueError(f"expected a comma at character {end}")
        end = _SPACE.match(text, end + 1).end()


def _envelope_rows(text: str, at: int) -> tuple[int | None, int]:
    """Where the value of ``rawLogs`` of the object at ``at`` starts, and where the object ends."""
    decode, rows = json.JSONDecoder().raw_decode, None
    end = _SPACE.match(text, at + 1).end()
    while text[end : end + 1] != "}":
        name, end = decode(text, end)
        end = _SPACE.match(text, end).end()
        if not isinstance(name, str) or text[end : end + 1] != ":":
            raise ValueError(f"expected a name and a colon at character {end}")
        start = _SPACE.match(text, end + 1).end()
        value, end = decode(text, start)
        if name == "rawLogs" and value is not None:
            rows = start
        end = _SPACE.match(text, end).end()
        if text[end : end + 1] == ",":
            end = _SPACE.match(text, end + 1).end()
        elif text[end : end + 1] != "}":
            raise ValueError(f"expected a comma at character {end}")
    return rows, end + 1


def row_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the log rows in a dataset text: an envelope with ``rawLogs``, an array, one object, or several
    separated by commas. Raises ValueError on anything else."""
    start = _SPACE.match(text).end()
    if text[start : start + 1] == "{":
        rows, end = _envelope_rows(text, start)
        if _SPACE.match(text, end).end() == len(text):
            if rows is None:
                return [(start, end)]
            start = rows
            if text[start] != "[":
                return [(start, json.JSONDecoder().raw_decode(text, start)[1])]
            return _item_spans(text, start + 1, "]")[0]
    elif text[start : start + 1] == "[":
        spans, end = _item_spans(text, start + 1, "]")
        if _SPACE.match(text, end).end() == len(text):
            return spans
    return _item_spans(text, start, "")[0]
