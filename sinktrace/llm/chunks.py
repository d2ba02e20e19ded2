"""Splitting a text at places where a byte-level pre-tokenizer always begins a new pre-token.

Between a character that is not white space and a following space or newline, the patterns of the
byte-level vocabularies used here end a match, and they look at nothing before that place. So a text may
be encoded chunk by chunk, and each different chunk once per worker. A pattern that lets a match run from
other characters into a newline (as ``[\\r\\n]*`` after punctuation does) is not of this kind:
``check_pattern`` raises for it.

A batch of texts is cut, and its different chunks found, in array operations on the UTF-8 bytes: chunks meet
by a hash, and each is then compared byte by byte with the one that stands for it. What stands is looked up in
a cache, and all that the cache lacks is made by one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    """The powers 0 to n of the hash's base."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))


def cuts(b: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a chunk begins: a space or newline after a character that is surely no white space.

    Characters beyond ASCII that share their first bytes with white space of any engine count as white space; so
    a place may be left out, and chunks be longer than they need be, but no place is wrong.
    """
    at = np.flatnonzero((b[1:] == 32) | (b[1:] == 10)) + 1
    last = b[at - 1]
    at, last = at[~_SPACES[last]], last[~_SPACES[last]]
    wide = np.flatnonzero(last >= 128)
    if len(wide):
        second, third = b[np.maximum(at[wide] - 2, 0)], b[np.maximum(at[wide] - 3, 0)]
        general = (third == 0xE2) & (second == 0x80) & (last[wide] >= 0x8C) & ~np.isin(last[wide], (0xA8, 0xA9, 0xAF))  # quotation marks and dashes
        unsure = (second == 0xC2) | np.isin(third, (0xE1, 0xE2, 0xE3, 0xEF)) & (second < 0xC0) & ~general
        at = np.delete(at, wide[unsure])
    return at


def chunks(text: str) -> list[str]:
    """The chunks of a text, in order; joined, they give the text."""
    raw = text.encode()
    bounds = [0, *cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)] if raw else [0]
    return [raw[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]


def ends_open(chunk: str) -> bool:
    """Whether a chunk ends in white space of any engine, so that a pre-token may go on after it."""
    return chunk[-1].isspace() or chunk[-1] in "\u180e\u200b\ufeff"


def check_pattern(findall: Callable[[str], list[str]]) -> None:
    """Raise if a pattern's matches can run over a place where chunks are cut: each pair of kinds of characters is tried."""
    kinds = ["a", "é", "語", "1", ".", "'s", "!?", "_", "🙂", "́", "\x00"]
    for left in kinds:
        for right in ("\n", " ", "\n\n", "  ", "\n ", " \n"):
            for after in ("", *kinds):
                whole = findall(left + right + after)
                if whole != findall(left) + findall(right + after):
                    raise ValueError(f"the pattern has a match over the end of {left!r} before {right!r}")


class _Recent:
    """Values by key. Of those that were not asked for lately the older generation is forgotten, so that about ``limit`` are held."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list[bytes], make: Callable[[list[bytes]], list]) -> list:
        """The values of the keys, which differ; those that are missing are made by one call."""
        if len(self.young) > self.limit // 2:
            self.old, self.young = self.young, {}
        values = list(map(self.young.get, keys))
        at = [k for k, v in enumerate(values) if v is None]
        if at:
            lacking = [keys[k] for k in at]
            found = dict(zip(lacking, map(self.old.get, lacking), strict=True))
            missing = [k for k, v in found.items() if v is None]
            if missing:
                found.update(zip(missing, make(missing), strict=True))
            self.young.update(found)
            for k, key in zip(at, lacking, strict=True):
                values[k] = found[key]
        return values


def _spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1 and so on, lengths[0] of them, then those from starts[1] on."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 and (not n or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(n, dtype=kind)
    return out


class ChunkCache:
    """Remembers what ``make`` gives for a chunk: a bytes value for each output, of which ``units`` has the sizes of an item.

    ``make`` takes a list of chunks and returns a tuple of bytes for each. About ``limit`` chunks are held,
    those of use lately, so a worker's memory is bounded and frequent chunks are made once. Some ``group`` bytes of text
    are cut together, and no more than twice as many.
    """

    def __init__(self, make: Callable[[list[str]], list[tuple[bytes, ...]]], units: tuple[int, ...] = (1,), limit: int = 400_000, group: int = 1 << 21):
        self.make, self.units, self.recent, self.group, self.power = make, units, _Recent(limit), group, _powers(2 * group)

    def _made(self, keys: list[bytes]) -> list[tuple[bytes, ...]]:
        return self.make([k.decode() for k in keys])

    def _group(self, texts: list[bytes]) -> list[tuple[memoryview, ...]]:
        raw = b"".join(texts)
        b, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(t) for t in texts])
        begins = np.zeros(len(b) + 1, bool)
        begins[0] = begins[cuts(b)] = begins[ends] = True
        starts = np.flatnonzero(begins[:-1])
        lengths = np.diff(np.append(starts, len(b)))
        power = self.power
        sums = np.zeros(len(b) + 1, np.uint64)
        np.multiply(b, power[: len(b)], out=sums[1:])
        np.cumsum(sums, out=sums)
        # Each chunk's sum, raised to the same power wherever the chunk begins.
        code = (sums[starts + lengths] - sums[starts]) * power[2 * self.group - starts] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, first, inv = np.unique(code, return_index=True, return_inverse=True)
        del sums
        stands = first[inv]
        # Byte by byte: a chunk that differs from the one that stands for it stands for itself.
        same = lengths == lengths[stands]
        if not same.all():
            stands = np.where(same, stands, np.arange(len(stands)))
        wrong = np.flatnonzero(b[_spread_out(starts[stands], lengths)] != b)
        if len(wrong) or not same.all():
            other = np.searchsorted(starts, wrong, "right") - 1
            stands[other] = other
            first, inv = np.unique(stands, return_inverse=True)
        keys = [raw[x:y] for x, y in zip(starts[first].tolist(), (starts + lengths)[first].tolist(), strict=True)]
        values = self.recent.look_up(keys, self._made)
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))  # a text's first chunk
        out = []
        for k, unit in enumerate(self.units):
            column = [v[k] for v in values]
            size = np.fromiter(map(len, column), np.int64, len(column)) // unit
            whole = size[inv]
            flat = np.frombuffer(b"".join(column), f"u{unit}")[_spread_out((np.cumsum(size) - size)[inv], whole)]
            places = (np.concatenate([[0], np.cumsum(whole)])[bounds] * unit).tolist()
            view = memoryview(flat.tobytes())
            out.append([view[x:y] for x, y in zip(places, places[1:], strict=False)])
        return list(zip(*out, strict=True))

    def _whole(self, raw: bytes) -> tuple[bytes, ...]:
        """A piece that has no safe place to cut it, chunk by chunk."""
        bounds = [0, *cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        values = self._made([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        return tuple(b"".join(v[k] for v in values) for k in range(len(self.units)))

    def many(self, texts: Iterable[str | None]) -> Iterator[tuple[memoryview, ...]]:
        """The outputs for each text, null being empty: those of its chunks, joined."""
        held, size = [], 0
        for text in texts:
            raw = (text or "").encode()
            if len(raw) > self.group:  # piece by piece, cut between a letter or digit and a space
                pieces, lo = [], 0
                while lo < len(raw):
                    hi = raw.find(b" ", lo + self.group // 2)
                    while hi > 0 and not raw[hi - 1 : hi].isalnum():
                        hi = raw.find(b" ", hi + 1)
                    hi = len(raw) if hi < 0 else hi
                    pieces.append(raw[lo:hi])
                    lo = hi
                if held:
                    yield from self._group(held)
                    held, size = [], 0
                done = [self._group([p])[0] if len(p) <= 2 * self.group else tuple(map(memoryview, self._whole(p))) for p in pieces]
                yield tuple(memoryview(b"".join(p[k] for p in done)) for k in range(len(self.units)))
                continue
            if size + len(raw) > 2 * self.group:
                yield from self._group(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw)
            if size > self.group:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)

    def __call__(self, text: str | None) -> tuple[bytes, ...]:
        """The outputs for one text."""
        return tuple(map(bytes, next(self.many([text]))))
