"""What a Python worker remembers from task to task.

Spark uses workers again, also for other stages and other queries of a session. Encoders and shinglers remember words
they have met; only the one used last is kept, so that a worker never holds the memories of two.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable

_held: list[tuple[Hashable, object]] = []


def only(key: Hashable, make: Callable[[], object]):
    """What ``make`` gave for ``key``; what was kept for another key is dropped first."""
    if not _held or _held[0][0] != key:
        drop()
        _held.append((key, make()))
    return _held[0][1]


def drop() -> None:
    """For work that has a memory of its own, gone with its task."""
    if _held:
        _held.clear()
        gc.collect()  # encoders are parts of cycles
