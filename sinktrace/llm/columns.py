"""Names of columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa


def without(keep: Iterable[str], *made: str) -> tuple[str, ...]:
    """The columns to carry along: one that has the name of a column that the operator makes gives way to it."""
    taken = {m.lower() for m in made}
    return tuple(c for c in keep if c.lower() not in taken)


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with as many underscores after it as make it new."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[Any]:
    """A column's values, some rows at a time, so that the Python values of a whole batch are never held at once."""
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()
