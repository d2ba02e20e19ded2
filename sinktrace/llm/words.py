"""Words of a text and 64-bit codes for them, shared by operators that count words or shingles."""

from __future__ import annotations

import numpy as np

from sinktrace.llm.caches import kept

_MULTIPLIER = 0x9E3779B97F4A7C15


class _Table(dict):
    """Codes of words; one that is not here comes from the older table, or is made."""

    def __init__(self, old: dict):
        import xxhash

        super().__init__()
        self.old, self.digest = old, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        code = self.old.get(word)
        if code is None:
            code = self.digest(word, 0)
        self[word] = code
        return code


class WordCodes:
    """The XXH64 value of each word that is asked for; about ``limit`` are held, those that were asked for lately."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.table = limit, _Table({})

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.table) > self.limit // 2:
            self.table.old = {}
            self.table = _Table(self.table)
        return np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))


def word_codes(limit: int = 250_000) -> WordCodes:
    """The table of this Python worker."""
    return kept(f"words {limit}", lambda: WordCodes(limit))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value."""
    x = x ^ np.uint64((seed * _MULTIPLIER + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_codes(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit code for each window of n words; windows of equal words have equal codes.

    Windows of 1, 2, 4 words and so on are joined up, so a window of n words takes some log2(n) steps.
    """
    count = len(codes) - n + 1
    if count <= 0:
        return codes[:0]
    join = lambda a, b: mixed(a * np.uint64(_MULTIPLIER) + b, seed)
    power, size, out, done = mixed(codes, seed), 1, None, 0
    while True:
        if n & size:
            part = power[done : done + count]
            out = part if out is None else join(out, part)
            done += size
        if 2 * size > n:
            return out
        power = join(power[: len(power) - size], power[size:])
        size *= 2
