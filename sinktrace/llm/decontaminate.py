"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared in lower case with runs of white space as one space. An item of m characters may occur
with up to k edits, k being ``edit_rate`` of m, and small enough for the lemma to bite: a region within k
edits of the item shares at least m - q + 1 - k*q of its character q-grams, all on diagonals (place in the
document less place in the item) at most k from one another's start. Shared q-grams are counted in
overlapping diagonal bands of each item; bands that reach the bound are verified by banded alignment.

The benchmark is dealt into blocks of about ``block_chars`` characters, whose indexes tasks build and write to the
shared folder. The documents are scanned once: a task reads one block after the other for each batch of
documents, and holds one.

Items of fewer than q characters have no q-gram: an automaton finds them, as whole words and without edits.

Defined cases: null and empty texts, and items without characters, match nothing; an item of q characters or
more that is too short for edits must occur exactly; an item without an id matches like others, with a null id;
items with equal text each match, equal rows once; repeated documents each match; of several regions the one with fewest edits, then the
first, is reported; a very long text is scanned in overlapping pieces.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.caches import kept
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import materialise, scratch, spread

Q, EDIT_RATE = 12, 0.05
_MULTIPLIER, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20
_PIECE = 1 << 19
MATCHES = "array<struct<item_id: bigint, distance: int, start: bigint, end: bigint>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and the place in the text of each."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    space = (codes <= 32) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x3000)
    at = np.flatnonzero(~space | ~np.concatenate([[False], space[:-1]]))
    out = codes[at]
    out[space[at]] = 32
    return out, at


def gram_codes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].astype(np.uint64)
    for k in range(1, q):
        out *= np.uint64(0x100000001B3)
        out += codes[k : k + n]
    return out


def align(pattern: np.ndarray, text: np.ndarray, width: int) -> tuple[int, int]:
    """Fewest edits between the pattern and any stretch of text that starts in the first ``width`` places, and where the first best one ends.

    Only diagonals 0 to ``width`` less one are filled in: place j of the text against place i of the pattern, with j - i on the diagonal.
    """
    m, far = len(pattern), len(pattern) + width
    padded = np.full(m + width, 0xFFFFFFFF, np.uint32)
    padded[: min(len(text), m + width)] = text[: m + width]
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(m):
        new = row + (padded[i : i + width] != pattern[i])  # a match or a substitution
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # the text lacks this character
        row = np.minimum.accumulate(new - steps) + steps  # the text has more characters
    ends = m + steps
    row[ends > len(text)] = far
    best = int(row.argmin())
    return int(row[best]), int(ends[best])


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list[int]
    items: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # ascending, distinct
    low: np.ndarray  # where the places of a gram begin
    item: np.ndarray  # by place
    offset: np.ndarray
    slots: np.ndarray
    q: int
    span: int = 0  # no region is longer
    short: list[tuple[int | None, str]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], q: int = Q, edit_rate: float = EDIT_RATE) -> Index:
        every_item = [(i, normalised((t or "").strip())[0]) for i, t in rows]
        found = [(i, c) for i, c in every_item if len(c) >= q]
        short = [(i, _text(c)) for i, c in every_item if 0 < len(c) < q]
        sizes = np.array([len(c) for _, c in found], np.int64)
        edits = np.clip(np.minimum(np.floor(sizes * edit_rate), (sizes - q) // q), 0, None).astype(np.int64) if len(found) else sizes
        codes = [gram_codes(c, q) for _, c in found]
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        grams, low = np.unique(every[order], return_index=True)
        slots = np.zeros(1 << _SLOTS, bool)
        slots[(grams * _MULTIPLIER) >> np.uint64(64 - _SLOTS)] = True
        span = int((sizes + 4 * edits + 4).max()) if len(found) else 0
        return cls([i for i, _ in found], [c for _, c in found], edits, sizes - q + 1 - edits * q, grams, np.append(low, len(every)), item[order], offset[order], slots, q, span, short)

    def _short_matches(self, whole: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """The first place of each short item that stands alone: item_id, start and end."""
        if not hasattr(self, "_automaton"):
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            of_text: dict[str, list[int | None]] = {}
            for i, t in self.short:
                of_text.setdefault(t, []).append(i)
            for t, ids in of_text.items():
                self._automaton.add_word(t, (t, ids))
            self._automaton.make_automaton()
        text, seen = _text(whole), set()
        for end, (t, ids) in self._automaton.iter(text):
            start = end + 1 - len(t)
            if t not in seen and not text[max(0, start - 1) : start].isalnum() and not text[end + 1 : end + 2].isalnum():
                seen.add(t)
                yield from ((i, start, end + 1) for i in ids)

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items and ranges of diagonals whose q-grams reach the bound."""
        grams = gram_codes(codes, self.q)
        at = np.flatnonzero(self.slots[(grams * _MULTIPLIER) >> np.uint64(64 - _SLOTS)])
        if len(at) < self.bound.min():
            return
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        known = self.grams[place] == grams[at]
        at, place = at[known], place[known]
        # A region has the bound's number of hits within the longest item's length: others need no closer look.
        least = int(self.bound.min())
        if len(at) < least:
            return
        dense = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= self.span)
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, dense + least, -1)
        near = np.cumsum(cover[:-1]) > 0
        at, place = at[near], place[near]
        if not len(at):
            return
        count = self.low[place + 1] - self.low[place]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.low[place], count)
        item, diagonal = self.item[step], np.repeat(at, count) - self.offset[step]
        width = 2 * self.edits + 1
        band = diagonal // width[item]
        key = (item << 40) + band + (1 << 39)
        keys, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        items = keys >> 40
        some = n >= self.bound[items]
        for i, b in zip(items[some].tolist(), ((keys[some] & ((1 << 40) - 1)) - (1 << 39)).tolist(), strict=True):
            yield i, int(b * width[i]), int((b + 2) * width[i])

    def matches(self, text: str | None) -> list[dict]:
        """The best region of each item within its edits: item_id, distance, and start and end in the text."""
        if not text or not (self.items or self.short):
            return []
        whole, where = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        for lo in range(0, max(1, len(whole)) if self.items else 0, _PIECE):
            codes = whole[lo : lo + _PIECE + self.span]
            for i, a, b in self._candidates(codes):
                if b <= 0 or i in best and best[i][0] == 0:  # before the text, or nothing can be better
                    continue
                item, k = self.items[i], int(self.edits[i])
                first = max(0, a - k)
                region = codes[first : b + len(item) + k]
                exact = _exact(region.tobytes(), item.tobytes())
                if exact >= 0:
                    found = (0, lo + first + exact // 4, lo + first + exact // 4 + len(item))
                else:
                    distance, end = align(item, region, min(len(region), b - first + k) or 1)
                    if distance > k:
                        continue
                    size = _anchored(item, region[:end], distance)
                    found = (distance, lo + first + end - size, lo + first + end)
                best[i] = min(best.get(i, found), found)
        out = [(self.ids[i], d, a, b) for i, (d, a, b) in sorted(best.items())]
        if self.short:
            out += [(i, 0, a, b) for i, a, b in self._short_matches(whole)]
        return [{"item_id": i, "distance": d, "start": int(where[a]), "end": int(where[b - 1]) + 1} for i, d, a, b in out]


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "replace")


def _exact(region: bytes, item: bytes) -> int:
    """Where the item's bytes begin in the region at a whole code point of four bytes, or -1."""
    at = region.find(item)
    while at > 0 and at % 4:
        at = region.find(item, at + 1)
    return at


def _anchored(item: np.ndarray, text: np.ndarray, distance: int) -> int:
    """The length of the shortest stretch at the text's end that is ``distance`` edits from the item."""
    m, n = len(item), min(len(text), len(item) + distance)
    a, b = item[::-1], text[len(text) - n :][::-1]
    steps = np.arange(n + 1)
    row = steps.copy()
    for i in range(m):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (b != a[i]), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(np.flatnonzero(row <= distance)[0])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_indexes(benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = 1_000_000) -> list[str]:
    """Write the benchmark's index to the shared folder in blocks of about ``block_chars`` characters, dealt by hash; returns the files."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = scratch(spark, "decontaminate")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, rows = TaskContext.get().taskAttemptId(), {}
        for batch in batches:  # a task has a few blocks
            for block, i, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text")), strict=True):
                rows.setdefault(block, []).append((i, text))
        for block, found in rows.items():
            index = Index.of(sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1])), q, edit_rate)
            uri = f"{out}/block-{block}-{attempt}"
            where, path = _open(uri)
            where.create_dir(_open(out)[1], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(pickle.dumps(index, 5))
            yield pa.RecordBatch.from_pydict({"block": [block], "uri": [uri]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))).repartition(n_blocks, "block")
    written = materialise(dealt.mapInArrow(write, "block long, uri string"), "decontaminate-blocks")
    return [r.uri for r in written.orderBy("block").collect()]  # one short row for each million characters


def _read(uri: str) -> Index:
    def read() -> Index:
        where, path = _open(uri)
        with where.open_input_file(path) as f:
            return pickle.loads(f.read())

    return kept(f"index {uri}", read)


def _matches(column: pa.Array, uris: list[str]) -> list[list[dict]]:
    """The matches of each text, block after block."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for uri in uris:
        index = _read(uri)
        for found, text in zip(out, texts_of(column), strict=True):
            found += index.matches(text)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark passage."""
    uris = write_indexes(benchmark, q, edit_rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not m for m in _matches(batch.column("text"), uris)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = 1_000_000, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of docs (or ``keep`` of them), then ``matches``: the benchmark passages that each text holds."""
    keep = without(docs.columns if keep is None else keep, "matches", "__text")
    found = docs.select(*keep, docs["text"].cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    uris = write_indexes(benchmark, q, edit_rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_matches(batch.column("__text"), uris), _MATCH_TYPE)], [*keep, "matches"])

    return found.mapInArrow(run, f"{fields}matches {MATCHES}")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id, distance (edits), start and end (characters of the text)."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = with_matches(spread(docs), benchmark, keep=("doc_id",))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
