"""Repeated passages by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of a document; a word is removed if a window that covers it has
the words of a window that starts earlier (in a smaller doc_id, or before it in the same document).

Only some suffixes are put into trees. The anchor of a window is the place in it whose prefix of
``prefix`` words has the smallest code; equal windows have the same anchor at the same place, so all
occurrences of a repeat meet at the suffixes of one prefix. Prefixes that occur in one document alone hold
no repeat between documents and are left out after a count. The others split the suffixes into groups: for
each suffix the words of the windows that it anchors, before and after it. A group that fits in memory
becomes one suffix tree, as sorted suffixes with the lengths of their common prefixes; its internal nodes
of ``window`` words or more are the repeats. A group over ``group_limit`` gets longer prefixes, up to the
whole window: then the suffixes of one prefix are equal, and an aggregation with partial sums finds the
first of them without gathering them.

Exact copies of a document (in words) are settled before by a count: but for the first, all their windows
repeat. Repeats within one document are found within its own row.

Windows of one document, and documents, are compared by 64-bit and 128-bit codes of their words; windows
of different documents by the words themselves.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; a null doc_id comes
first in the order; rows with the same doc_id and the same words are one document and have the same
result; rows with the same doc_id but other words are at one place in the order: a window at equal starts
is not earlier; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.columns import texts_of
from sinktrace.llm.words import mixed, window_codes, word_codes
from sinktrace.storage import materialise, partitions, spread

NO_DOC = -(2**63)  # stands for a null doc_id
WINDOW, PREFIX = 20, 6
_WORDS = 600_000  # words whose codes a worker holds


def anchors(codes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, as a place, the first of equals; and the code of every prefix."""
    grams = mixed(window_codes(codes, prefix, 3), 4)
    width, n = window - prefix + 1, len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), grams
    best, span = np.arange(len(grams)), 1  # the place of the smallest code among ``span`` places from each

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    while 2 * span <= width:
        best = smaller(best[: len(best) - span], best[span:])
        span *= 2
    return smaller(best[:n], best[width - span : width - span + n]), grams


def _words(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text, and a 128-bit code of their sequence."""
    import xxhash

    words = (text or "").encode().split()
    return words, xxhash.xxh128_digest(b" ".join(words))


def _some_equal(codes: np.ndarray) -> bool:
    ordered = np.sort(codes)
    return bool((ordered[1:] == ordered[:-1]).any())


def repeated_within(words: list[bytes], codes: np.ndarray, window: int) -> np.ndarray:
    """For each window of a document whether it occurs earlier in it. Windows meet by a code and are then compared word by word."""
    whole = window_codes(codes, window)
    if not _some_equal(whole):
        return np.zeros(len(whole), bool)
    _, first, inv = np.unique(whole, return_index=True, return_inverse=True)
    stands = first[inv]
    later = stands != np.arange(len(stands))
    last = -2
    for s in np.flatnonzero(later).tolist():
        f = int(stands[s])
        # next to a window that is equal one place before only the last word is new
        same = words[s + window - 1] == words[f + window - 1] if last == s - 1 and stands[s - 1] == f - 1 else words[s : s + window] == words[f : f + window]
        if not same:  # two sequences have one code: by the words alone
            seen: set[tuple[bytes, ...]] = set()
            return np.array([(w := tuple(words[i : i + window])) in seen or seen.add(w) is not None for i in range(len(stands))], bool)
        last = s
    return later


def _id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def prefixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """For rows (k, h, text): k, h, digest of the words, id (its first 64 bits), codes: the distinct codes of the prefixes that anchor a window,
    and again: whether a window may occur twice in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lists, again = [], [], []
            for text in texts_of(batch.column("text")):
                words, digest = _words(text)
                codes = word_codes(_WORDS).codes(words)
                found, grams = anchors(codes, window, prefix)
                digests.append(digest)
                again.append(_some_equal(window_codes(codes, window)))
                places = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found  # they ascend
                own = np.sort(grams[places])
                lists.append(own[np.concatenate([[True], own[1:] != own[:-1]])].view(np.int64) if len(own) else own.view(np.int64))
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            ids = pa.array([_id(d) for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(digests, pa.binary()), ids, pa.ListArray.from_arrays(offsets, flat), pa.array(again, pa.bool_())], ["k", "h", "digest", "id", "codes", "again"])

    return docs.mapInArrow(run, "k long, h long, digest binary, id long, codes array<long>, again boolean")


def contexts(found: DataFrame, window: int, prefix: int) -> DataFrame:
    """For rows (k, text, wanted: their digest's id and codes) the words around each suffix with a wanted prefix.

    Rows (code, k, id, start, before, words): ``words`` begin with the first window that the suffix anchors, at ``start``,
    and end with the last; ``before`` is the number of words before the suffix. Windows that occur earlier in the document are left out
    at either end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, wanted in zip(*(texts_of(batch.column(c)) for c in ("k", "text", "wanted")), strict=True):
                words, digest = _words(text)
                own = next((w["codes"] for w in wanted if w["id"] == _id(digest)), None)
                if own is None:
                    continue
                codes = word_codes(_WORDS).codes(words)
                at, grams = anchors(codes, window, prefix)
                first = ~repeated_within(words, codes, window)
                starts = np.flatnonzero(first & np.isin(grams[at], np.array(own, np.int64).view(np.uint64)))
                place = at[starts]  # ascends with the starts
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
                    lo, hi = int(starts[a]), int(starts[b - 1])
                    rows.append((int(grams[place[a]].view(np.int64)), k, _id(digest), lo, int(place[a]) - lo, b" ".join(words[lo : hi + window])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["code", "k", "id", "start", "before", "words"])

    return found.mapInArrow(run, "code long, k long, id long, start int, before int, words binary")


def deep_nodes(suffixes: list[tuple[list[bytes], int]], depth: int) -> Iterator[list[int]]:
    """The suffix tree of the suffixes (words, place), as a sorted list with common-prefix lengths: the leaves of each
    topmost internal node that is ``depth`` words deep or more."""
    order = sorted(range(len(suffixes)), key=lambda s: suffixes[s][0][suffixes[s][1] : suffixes[s][1] + depth])
    group = order[:1]
    for a, b in zip(order, order[1:], strict=False):
        (u, i), (v, j) = suffixes[a], suffixes[b]
        common = 0
        while common < depth and i + common < len(u) and j + common < len(v) and u[i + common] == v[j + common]:
            common += 1
        if common < depth:
            if len(group) > 1:
                yield group
            group = []
        group.append(b)
    if len(group) > 1:
        yield group


def tree_repeats(members: list[tuple[int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """Repeats in a group of suffixes (k, id, start, before, words): (k, id, first start, last start) of windows that start earlier elsewhere."""
    classes: dict[tuple[bytes, int], list[tuple[int, int, int]]] = {}
    for k, i, start, before, words in members:
        classes.setdefault((words, before), []).append((k, start, i))
    first = {c: min(x[:2] for x in at) for c, at in classes.items()}
    split = {c: c[0].split(b" ") for c in classes}
    earliest: dict[tuple[tuple[bytes, int], int], tuple[int, int]] = {(c, j): (first[c][0], first[c][1] + j) for c in classes for j in range(len(split[c]) - window + 1)}
    if len(classes) > 1:
        places = list(earliest)
        for leaves in deep_nodes([(split[c], j) for c, j in places], window):
            low = min(earliest[places[x]] for x in leaves)
            for x in leaves:
                earliest[places[x]] = low
    out = []
    for c, at in classes.items():
        low = [earliest[c, j] for j in range(len(split[c]) - window + 1)]
        for k, start, i in at:
            run = None
            for j, e in enumerate([*low, None]):
                later = e is not None and (k, start + j) > e
                if later and run is None:
                    run = j
                elif not later and run is not None:
                    out.append((k, i, start + run, start + j - 1))
                    run = None
    return out


def group_repeats(rows: DataFrame, window: int, group_limit: int) -> DataFrame:
    """Repeats among contexts: rows (k, id, lo, hi), the first and last start of a run of windows."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows come sorted by code. The last group of a batch may go on in the next.
        code, members, out = None, [], []

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k", "id", "lo", "hi"])
            out.clear()
            return batch

        for batch in batches:
            for c, *member in zip(*(batch.column(x).to_pylist() for x in ("code", "k", "id", "start", "before", "words")), strict=True):
                if c != code:
                    if len(members) > 1:
                        out += tree_repeats(members, window)
                    code, members = c, []
                members.append(tuple(member))
            yield sent()
        if len(members) > 1:
            out += tree_repeats(members, window)
        yield sent()

    spark = rows.sparkSession
    n = partitions(spark)
    rows = materialise(rows, "repeats-contexts")
    large = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("code")
    large = materialise(large, "repeats-large")
    some = not large.isEmpty()
    small = (rows.join(large, "code", "left_anti") if some else rows).repartition(n, "code").sortWithinPartitions("code")
    found = small.mapInArrow(trees, "k long, id long, lo int, hi int")
    if not some:
        return found
    # Longer prefixes for the large groups: one for each window, of all its words.
    text = F.split(F.decode("words", "UTF-8"), " ")
    whole = rows.join(large, "code", "left_semi").select("k", "id", "start", text.alias("w")).select("k", "id", "start", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("j"))
    whole = whole.select("k", "id", (F.col("start") + F.col("j")).alias("start"), F.sha2(F.concat_ws(" ", F.slice("w", F.col("j") + 1, window)), 256).alias("p"))
    low = whole.groupBy("p").agg(F.min(F.struct("k", "start")).alias("first"))
    later = whole.join(low, "p").where(F.struct("k", "start") > F.col("first"))
    return found.unionByName(later.select("k", "id", F.col("start").cast("int").alias("lo"), F.col("start").cast("int").alias("hi")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_limit: int = 20_000, with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256, removed (ranges of words), and kept_text if asked for."""
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)).alias("k"), docs["text"].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # A row's place is its id and the hash of its text, so that rows of one id (or of none) with other texts meet nowhere.
    place = ["k", "h"]
    marks = materialise(prefixes(keyed.select("k", "h", "text"), window, prefix), "repeats-prefixes")
    first = marks.groupBy("digest").agg(F.min("k").alias("first_k"))
    places = marks.select("k", "h", "digest").distinct().join(first, "digest")
    copies = places.where("k > first_k")
    alone = marks.join(first.withColumnRenamed("first_k", "k"), ["digest", "k"], "left_semi").dropDuplicates(["digest", "k"])
    codes = materialise(alone.select("k", "h", "id", F.explode("codes").alias("code")), "repeats-codes")
    several = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
    wanted = codes.join(several, "code", "left_semi").groupBy("k", "h", "id").agg(F.collect_list("code").alias("codes"))
    wanted = wanted.groupBy(*place).agg(F.collect_list(F.struct("id", "codes")).alias("wanted"))
    around = contexts(keyed.join(wanted, place).select("k", "text", "wanted"), window, prefix)
    runs = group_repeats(around, window, group_limit)
    spans = runs.groupBy("k", "id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    gone = copies.select(*place, F.lit(True).alias("copy")).distinct()
    # The runs of a text of one (k, id) go to every row with that text: its places, of which marks has one for each.
    of_rows = marks.select("k", "h", "id").distinct().join(spans, ["k", "id"]).select(*place, F.struct("id", "runs").alias("runs"))
    again = marks.where("again").select(*place, "again").distinct()
    told = of_rows.groupBy(*place).agg(F.collect_list("runs").alias("runs")).join(gone, place, "full").join(again, place, "full")
    met = keyed.join(told, place, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs_, copy, again_ in zip(*(texts_of(batch.column(c)) for c in ("text", "runs", "copy", "again")), strict=True):
                if not (runs_ or copy or again_):  # nothing goes
                    words = (text or "").encode().split()
                    kept = b" ".join(words)
                    rows.append((len(words), 0, hashlib.sha256(kept).hexdigest(), [], kept.decode() if with_text else None))
                    continue
                words, digest = _words(text)
                count = len(words)
                steps = np.zeros(count + 1, np.int64)
                if count >= window:
                    if copy:
                        later = np.arange(count - window + 1)
                    else:
                        later = repeated_within(words, word_codes(_WORDS).codes(words), window) if again_ else np.zeros(count - window + 1, bool)
                        for r in runs_ or ():
                            for x in r["runs"] if r["id"] == _id(digest) else ():
                                later[x["lo"] : x["hi"] + 1] = True
                        later = np.flatnonzero(later)
                    np.add.at(steps, later, 1)
                    np.add.at(steps, later + window, -1)
                gone_ = np.cumsum(steps[:-1]) > 0
                kept = b" ".join(np.array(words, object)[~gone_].tolist()) if gone_.any() else b" ".join(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone_, [0]])))
                ranges = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                rows.append((count, int(gone_.sum()), hashlib.sha256(kept).hexdigest(), ranges, kept.decode() if with_text else None))
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            names = ["n_words", "n_removed", "kept_sha256", "removed", "kept_text"][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array([r[i] for r in rows], types[i]) for i in range(len(names)))], ["k", *names])

    schema = "k long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>" + ", kept_text string" * with_text
    out = met.select("k", "text", "runs", "copy", "again").mapInArrow(finish, schema)
    return out.select(F.when(F.col("k") != NO_DOC, F.col("k")).alias("doc_id"), *out.columns[1:])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of documents: doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = """
WITH w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS words FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS s FROM w)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + 1, s + 21)) AS p FROM later
), cut AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id
"""
