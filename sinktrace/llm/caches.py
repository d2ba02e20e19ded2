"""What a Python worker remembers between tasks: the cache of one operator at a time, so that the stages of a pipeline do not add up."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The cache of this name, made if another one was held."""
    if name not in _KEPT:
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Hold none, for a task that needs none."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
