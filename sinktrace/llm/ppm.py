"""Language-model scores by prediction by partial matching over bytes, and a word base score.

Training counts every byte with the ``order`` bytes before it (A-Z in lower case; an end symbol closes
each text). The counts are one trie, kept as a table of contexts and a table of context-symbol pairs for
each depth. A symbol is predicted from the longest context known; if the context has not seen it, the
model escapes to the next shorter one. Escape is estimated from the number of different symbols seen
(method C), and the symbols that a longer context has seen are excluded from the shorter ones. The
exclusions of a fixed trie can be summed in advance, so whole texts are scored in array operations.

The trie is dealt to blocks by how a context ends: by its last two bytes, and by one more for as long as an
ending has over an eighth of ``max_entries`` pairs. All contexts that a position can fall back to lie in its
block, but for those shorter than the ending, which go with every block: at most 66,000 of depths 0 and 1, and
those of the split endings. Tasks build the blocks and write them to the shared folder. The scores of the
most frequent keys, ``head_keys`` in number, are broadcast; so one scan of the documents scores most positions,
and sends the other keys, packed by block, to tasks that read that block. Nothing is read twice, and what is
sent doesn't depend on the number of blocks.

The base score gives each token log10((c + 1) / (N + V + 1)). The most frequent words, ``head`` in
number, are broadcast; the others meet their counts in a join on the word, so no hot key is shuffled.

Defined cases: a null text counts as empty: it has the end token alone; a null doc_id counts as the empty
text in the held-out rule; without training rows every token is unknown and N and V are 0; repeated rows
count, and are scored, as often as they occur; ties in word frequency are broken by the word.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import materialise, partitions, scratch, spread

SYMBOL_BITS, END, PAD, SYMBOLS = 9, 256, 257, 257
_CUT = 1 << 20


def keys_of(raw: bytes, order: int) -> Iterator[np.ndarray]:
    """A packed key for each symbol of a text, its context first; in pieces, so that a very long text needs little memory."""
    whole = np.frombuffer(raw, np.uint8)
    for lo in range(0, len(raw) + 1, _CUT):
        hi = min(lo + _CUT, len(raw) + 1)
        s = np.full(order + hi - lo, PAD, np.uint64)
        a, b = max(0, lo - order), min(hi, len(raw))
        s[order - (lo - a) : order - lo + b] = whole[a:b]
        if hi > len(raw):
            s[-1] = END
        key = s[: hi - lo].copy()
        for k in range(1, order + 1):
            key <<= np.uint64(SYMBOL_BITS)
            key |= s[k : k + hi - lo]
        yield key


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts or sums of counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def context_counts(docs: DataFrame, order: int) -> DataFrame:
    """Rows (key, n) over the texts of docs. A task sends each key once for some four million distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            if waiting:
                held.append(_tally(np.concatenate(waiting)))
                waiting.clear()
            if len(held) > 1:
                held[:] = [_tally(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]

        for batch in batches:
            for text in texts_of(batch.column("text")):
                for key in keys_of((text or "").encode().lower(), order):
                    waiting.append(key)
                    size += len(key)
                    if size > 2_000_000:
                        fold()
                        size = 0
                        if len(held[0][0]) > 4_000_000:
                            yield pa.RecordBatch.from_pydict({"key": held[0][0].astype(np.int64), "n": held[0][1].astype(np.int64)})
                            held.clear()
        fold()
        if held:
            yield pa.RecordBatch.from_pydict({"key": held[0][0].astype(np.int64), "n": held[0][1].astype(np.int64)})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Tables by depth. For a context: its key, log10 of what it costs to escape and of its total, plain and with the longer context's symbols excluded."""

    order: int
    pairs: list[np.ndarray]
    pair_log: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    low_total: list[np.ndarray]  # of the next shorter context, without the symbols seen here
    low_distinct: list[np.ndarray]
    unseen: int


def build(keys: np.ndarray, counts: np.ndarray, shallow_keys: np.ndarray, shallow_counts: np.ndarray, order: int, split: tuple[tuple[np.ndarray, np.ndarray], ...] = ()) -> Trie:
    """The trie of a block: its pairs at full depth, the corpus's counts of two-symbol keys for depths 0 and 1, and of the pairs of split endings for depths from 2 on."""
    pairs, numbers, contexts, total, distinct, low_total, low_distinct = ([] for _ in range(7))
    bits = np.uint64(SYMBOL_BITS)
    for k in range(order + 1):
        mask = np.uint64((1 << SYMBOL_BITS * (k + 1)) - 1)
        if k < 2:
            p, n = _tally(shallow_keys & mask, shallow_counts)
        elif k - 2 < len(split):  # a split ending's pairs lie in several blocks: its sums replace what is here
            here = ~np.isin((keys & mask) >> bits, split[k - 2][0] >> bits)
            p, n = _tally(np.concatenate([keys[here] & mask, split[k - 2][0]]), np.concatenate([counts[here], split[k - 2][1]]))
        else:
            p, n = _tally(keys & mask, counts)
        c = p >> bits
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
        pairs.append(p)
        numbers.append(n)
        contexts.append(c[first])
        total.append(np.add.reduceat(n, first) if len(first) else n[:0])
        distinct.append(np.diff(np.concatenate([first, [len(c)]])))
        if k:
            below = numbers[k - 1][np.searchsorted(pairs[k - 1], p & np.uint64((1 << SYMBOL_BITS * k) - 1))]
            at = np.searchsorted(contexts[k - 1], contexts[k] & np.uint64((1 << SYMBOL_BITS * (k - 1)) - 1))
            low_total.append(total[k - 1][at] - (np.add.reduceat(below, first) if len(first) else below[:0]))
            low_distinct.append(distinct[k - 1][at] - distinct[k])
        else:
            low_total.append(total[0][:0])
            low_distinct.append(distinct[0][:0])
    return Trie(order, pairs, [np.log10(n) for n in numbers], contexts, total, distinct, low_total, low_distinct, max(1, SYMBOLS - (int(distinct[0][0]) if len(distinct[0]) else 0)))


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def log_probabilities(trie: Trie, keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key's symbol in its context."""
    out = np.zeros(len(keys))
    left = np.arange(len(keys))
    total, distinct = np.full(len(keys), -1.0), np.zeros(len(keys))  # -1: no longer context was known
    bits = np.uint64(SYMBOL_BITS)
    for k in range(trie.order, -1, -1):
        key = keys[left] & np.uint64((1 << SYMBOL_BITS * (k + 1)) - 1)
        at, known = _find(trie.contexts[k], key >> bits)
        t, d = total[left], distinct[left]
        if known.any():
            fresh = known & (t < 0)
            t[fresh], d[fresh] = trie.total[k][at[fresh]], trie.distinct[k][at[fresh]]
            p, seen = _find(trie.pairs[k], key)
            weight = np.log10(np.maximum(t + d, 1))
            out[left[seen]] += trie.pair_log[k][p[seen]] - weight[seen]
            escape = known & ~seen & (d > 0)
            out[left[escape]] += np.log10(d[escape]) - weight[escape]
            if k:
                total[left[known]], distinct[left[known]] = trie.low_total[k][at[known]], trie.low_distinct[k][at[known]]
            left = left[~seen]
        if not len(left):
            return out
    out[left] -= np.log10(trie.unseen)
    return out


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Head:
    """The scores of frequent keys in two slotted tables; a key that finds both its slots taken is not in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, slot_bits: tuple[int, int] = (21, 20)):
        self.shift = [np.uint64(64 - b) for b in slot_bits]
        self.key = [np.full(1 << b, 2**64 - 1, np.uint64) for b in slot_bits]
        self.value = [np.zeros(1 << b) for b in slot_bits]
        for mix, shift, key, value in zip(_MIX, self.shift, self.key, self.value, strict=True):
            slot = (keys * mix) >> shift
            key[slot], value[slot] = keys, values
            rest = key[slot] != keys
            keys, values = keys[rest], values[rest]

    def score(self, keys: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum over the keys that are here, and the others."""
        out = 0.0
        for mix, shift, key, value in zip(_MIX, self.shift, self.key, self.value, strict=True):
            slot = (keys * mix) >> shift
            hit = key[slot] == keys
            out += float(value[slot[hit]].sum())
            keys = keys[~hit]
        return out, keys


def block_of(keys: np.ndarray, endings: list[np.ndarray], n_blocks: int) -> np.ndarray:
    """The block of each key, by its context's last two symbols, and one more for each level at which that ending is split."""
    context = keys >> np.uint64(SYMBOL_BITS)
    ending = context & np.uint64((1 << 2 * SYMBOL_BITS) - 1)
    left = np.arange(len(keys))
    for k, split in enumerate(endings, 3):
        left = left[np.isin(ending[left], split)]
        ending[left] = context[left] & np.uint64((1 << k * SYMBOL_BITS) - 1)
    return (((ending * _MIX[0]) >> np.uint64(20)) % np.uint64(n_blocks)).astype(np.int64)


def _symbols(n: int) -> F.Column:
    return F.lit((1 << n * SYMBOL_BITS) - 1)


def split_endings(contexts: DataFrame, order: int, limit: int) -> tuple[list[np.ndarray], tuple[tuple[np.ndarray, np.ndarray], ...]]:
    """The endings of two symbols and more that over ``limit`` pairs share, level by level, and the counts of their pairs.

    At each level they are at most the number of all pairs divided by the limit, with 257 pairs each.
    """
    endings, sums = [], []
    part = contexts
    for k in range(2, order):
        ending = F.shiftrightunsigned("key", SYMBOL_BITS).bitwiseAND(_symbols(k))
        many = part.groupBy(ending.alias("ending")).count().where(F.col("count") > limit).select("ending").toArrow()
        if not len(many):
            break
        split = np.sort(many.column("ending").to_numpy())
        part = part.join(F.broadcast(contexts.sparkSession.createDataFrame(many)), ending == F.col("ending"), "left_semi")
        n = part.groupBy(F.col("key").bitwiseAND(_symbols(k + 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        endings.append(split.astype(np.uint64))
        sums.append(_arrays(n))
    return endings, tuple(sums)


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.int64)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_blocks(contexts: DataFrame, order: int, head_keys: int, max_entries: int) -> tuple[list[str], list[np.ndarray], Head]:
    """Tasks build the trie's blocks and write them: their files, the split endings, and the scores of the most frequent keys."""
    spark = contexts.sparkSession
    tiers = contexts.groupBy(F.floor(F.log2("n") * 8).alias("tier")).agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n")).orderBy(F.desc("tier")).collect()  # a few hundred
    n_pairs, least, taken = sum(t["size"] for t in tiers), None, 0
    for t in tiers:
        taken += t["size"]
        if taken > head_keys:
            break
        least = t.n
    n_blocks = max(1, -(-n_pairs // max_entries))
    shallow = _arrays(contexts.groupBy(F.col("key").bitwiseAND(_symbols(2)).alias("key")).agg(F.sum("n").alias("n")).toArrow())
    endings, split = split_endings(contexts, order, max_entries // 8) if n_blocks > 1 else ([], ())
    low = spark.sparkContext.broadcast((shallow, split))
    out = scratch(spark, "ppm-trie")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = block_of(_arrays(batch)[0], endings, n_blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), batch.column("key"), batch.column("n")], ["block", "key", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, found = TaskContext.get().taskAttemptId(), {}
        for batch in batches:  # a task has a few blocks
            blocks, (keys, n) = batch.column("block").to_numpy(), _arrays(batch)
            for block in np.unique(blocks).tolist():
                found.setdefault(block, []).append((keys[blocks == block], n[blocks == block]))
        while found:
            block, parts = found.popitem()
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            trie = build(keys, n, *low.value[0], order, low.value[1])
            uri = f"{out}/block-{block}-{attempt}"
            where, path = _open(uri)
            where.create_dir(_open(out)[1], recursive=True)
            with where.open_output_stream(path) as f:
                pickle.dump(trie, f, 5)
            often = keys[n >= least] if least is not None else keys[:0]
            yield pa.RecordBatch.from_pydict({"block": [block], "uri": [uri], "keys": [often.tobytes()], "scores": [log_probabilities(trie, often).tobytes()]})

    dealt = contexts.mapInArrow(deal, "block long, key long, n long").repartition(n_blocks, "block")
    written = materialise(dealt.mapInArrow(write, "block long, uri string, keys binary, scores binary"), "ppm-blocks").collect()
    uris = [""] * n_blocks  # a block without pairs is met by keys that fall back to depth 1 or 0
    for r in written:
        uris[r.block] = r.uri
    keys, scores = (b"".join(r[c] for r in written) for c in ("keys", "scores"))
    if not all(uris):
        uri = f"{out}/block-none"
        where, path = _open(uri)
        where.create_dir(_open(out)[1], recursive=True)
        with where.open_output_stream(path) as f:
            pickle.dump(build(shallow[0][:0], shallow[1][:0], *shallow, order, split), f, 5)
        uris = [u or uri for u in uris]
    return uris, endings, Head(np.frombuffer(keys, np.uint64), np.frombuffer(scores, np.float64))


_PACK = [("block", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())]


def _packed(waiting: list[tuple[int, np.ndarray]], endings: list[np.ndarray], n_blocks: int) -> list[dict]:
    """The keys of some texts (place, keys) by block, with the places and how often each text has them."""
    if not waiting:
        return []
    found = [(i, *np.unique(keys, return_counts=True)) for i, keys in waiting]
    keys, counts = np.concatenate([k for _, k, _ in found]), np.concatenate([n for *_, n in found]).astype(np.uint32)
    rows = np.repeat(np.array([i for i, *_ in found], np.uint32), [len(k) for _, k, _ in found])
    blocks = block_of(keys, endings, n_blocks)
    order = np.lexsort((keys, blocks))
    cuts = np.searchsorted(blocks[order], np.arange(n_blocks + 1))
    return [{"block": b, "keys": keys[order[lo:hi]].tobytes(), "rows": rows[order[lo:hi]].tobytes(), "counts": counts[order[lo:hi]].tobytes()} for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]


def tail_scores(sent: DataFrame, uris: list[str]) -> DataFrame:
    """Rows (__row, tail_score) for packed keys (__row of the first text, block, keys, rows, counts)."""
    spark = sent.sparkSession
    ways = max(1, -(-2 * partitions(spark) // len(uris)))  # a block is read by several tasks, so that all have work
    dealt = sent.withColumn("way", F.pmod(F.xxhash64("__row"), F.lit(ways))).repartition(max(partitions(spark), len(uris)), "block", "way").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, trie = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["block"] != last:
                    trie = None
                    where, path = _open(uris[r["block"]])
                    with where.open_input_file(path) as f:
                        last, trie = r["block"], pickle.loads(f.read())
                keys, rows, n = (np.frombuffer(r[c], t) for c, t in (("keys", np.uint64), ("rows", np.uint32), ("counts", np.uint32)))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # they come sorted
                values = np.repeat(log_probabilities(trie, keys[first]), np.diff(np.concatenate([first, [len(keys)]])))
                some = np.flatnonzero(np.bincount(rows))
                yield pa.RecordBatch.from_pydict({"__row": r["__row"] + some, "tail_score": np.bincount(rows, values * n)[some]})

    return dealt.select("__row", "block", "keys", "rows", "counts").mapInArrow(run, "__row long, tail_score double")


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over the texts of docs: lower-cased words as bytes, and the empty word for each text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return rows

        for batch in batches:
            for text in texts_of(batch.column("text")):
                counts.update((text or "").encode().lower().split())
                counts[b""] += 1
                if len(counts) > 400_000:
                    yield sent()
        yield sent()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, training: DataFrame, order: int = 5, head: int = 100_000, max_entries: int = 2_000_000, head_keys: int = 2_000_000) -> DataFrame:
    """Columns of docs but text, then n_tokens, n_known, train_tokens, base_score and score, learned from the texts of ``training``."""
    spark = docs.sparkSession
    vocabulary = materialise(word_counts(training), "ppm-words")
    contexts = materialise(context_counts(training, order), "ppm-contexts")
    n_all, n_words = (x or 0 for x in vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first())
    top = vocabulary.orderBy(F.desc("n"), "word").limit(head).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)))
    uris, endings, table = write_blocks(contexts, order, head_keys, max_entries)
    often = spark.sparkContext.broadcast(table)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "head_known", "head_base", "head_score", "tail", "sent", "tail_known", "tail_base", "tail_score", "__row")
    keep = without(docs.columns, "text", *made)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__row"))
    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    types = [("head_score", pa.float64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_base", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))), ("sent", pa.list_(pa.struct(_PACK)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, denominator, keyed = frequent.value, n_all + n_words + 1, often.value
        for batch in batches:
            out, waiting, size, lo = [], [], 0, 0

            def told() -> pa.RecordBatch:
                """The rows so far, the first with the packed keys of all; rows of a batch are numbered one after another."""
                part = batch.slice(lo, len(out))  # noqa: B023
                lines = [(*line, None) for line in out]  # noqa: B023
                lines[0] = (*lines[0][:-1], _packed(waiting, endings, len(uris)))  # noqa: B023
                columns = [pa.array([x[i] for x in lines], t) for i, (_, t) in enumerate(types)]
                return pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keep, "__row")), *columns], [*keep, "__row", *(name for name, _ in types)])

            for text in texts_of(batch.column("text")):
                raw, total = (text or "").encode().lower(), 0.0
                rest = []
                for keys in keys_of(raw, order):
                    found, other = keyed.score(keys)
                    total += found
                    rest.append(other)
                    size += len(other)
                waiting.append((len(out), np.concatenate(rest)))
                counts = Counter(raw.split())
                counts[b""] = 1
                here = {w: n for w, n in counts.items() if w in known}
                c = np.array([known[w] for w in here] + [0], np.float64)
                n = np.array([*here.values(), 0], np.float64)
                out.append((total, int(sum(counts.values())), int(n.sum()), float(n @ np.log10((c + 1) / denominator)), [{"word": w, "k": k} for w, k in counts.items() if w not in known]))
                if size > 1_000_000 or len(out) == 4096:
                    yield told()
                    lo += len(out)
                    out, waiting, size = [], [], 0
            if out:
                yield told()

    fields = held + "__row long, head_score double, n_tokens long, head_known long, head_base double, tail array<struct<word: binary, k: bigint>>, sent array<struct<block: bigint, keys: binary, rows: binary, counts: binary>>"
    first = materialise(rows.select(*keep, "__row", "text").mapInArrow(run, fields), "ppm-scores")
    rare = first.select("__row", F.explode("tail").alias("t")).select("__row", "t.word", "t.k").join(vocabulary, "word", "left")
    n = F.coalesce("n", F.lit(0))
    words = rare.select("__row", F.when(n > 0, F.col("k")).otherwise(0).alias("tail_known"), (F.col("k") * F.log10((n + 1) / F.lit(float(n_all + n_words + 1)))).alias("tail_base"))
    sent = tail_scores(first.select("__row", F.explode("sent").alias("s")).select("__row", "s.*"), uris)
    sums = words.unionByName(sent, allowMissingColumns=True).groupBy("__row").agg(*(F.sum(c).alias(c) for c in ("tail_known", "tail_base", "tail_score")))
    added = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return first.drop("tail", "sent").join(sums, "__row", "left").select(
        *keep, "n_tokens", added("head_known", "tail_known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), added("head_base", "tail_base").alias("base_score"), added("head_score", "tail_score").alias("score")
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of documents, learned from those whose crc32 of doc_id is not 2 modulo 7."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, docs.where("not held_out"))
