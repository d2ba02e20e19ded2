"""Alignment of two tokenizers over a corpus: which tokens overlap, and how often each pair of token ids does.

A text is encoded by both tokenizers; byte offsets where tokens of both end cut it into groups. Texts are encoded
chunk by chunk (``chunks``): at a place where a chunk ends, tokens of both end, so groups and links lie within chunks.

For every pair of ids there is an inverted bitmap of the documents that link them. Documents come in blocks of at most
``BLOCK``; a pair's bitmap in a block is held as its non-zero 64-bit words and their places. A pair may be linked many
times in one document: multiplicity planes are bitmaps of the same kind, plane k holding the documents of which the
k-th binary digit of the multiplicity is one, and the bitmap of documents is the OR of a block's planes. Popcounts give
the documents, and popcounts weighted by 2**k the links, of each pair. The most frequent A id of each B id follows, and
the postings carry both back: a document gets a pair's scores as often as its planes say.

A pair in every document has one short row for each block, so no pair is a hot key; pairs meet as rows of blocks,
never as rows of links.

Defined cases: a text that is null or empty, or that one of the tokenizers does not give back byte for byte, has no
tokens: zeros and an empty digest; rows are numbered, so null, equal and repeated doc_ids have a row each; ties for the
highest count of a B id all count as best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.byte_bpe import byte_characters
from sinktrace.llm.caches import kept, release
from sinktrace.llm.chunks import ChunkCache, check_pattern, ends_open
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import materialise, partitions, spread

BLOCK, ENTRIES = 4096, 1 << 20


def identity_model(model: bytes) -> bytes:
    """A sentencepiece model as it is, but without the space that it puts before a text: chunks bring their own."""
    from sinktrace.llm.byte_bpe import _field

    # A later field of a protocol buffer overrides an earlier one, and messages merge: normaliser (3), add_dummy_prefix (3).
    return model + _field(3, _field(3, 0))


class Aligner:
    """Encodes chunks of space + text with both tokenizers and links their tokens by bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        raw = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = {i: bytes(map(raw.__getitem__, t)) if all(c in raw for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        with open(b_path, "rb") as f:
            self.b = sentencepiece.SentencePieceProcessor(model_proto=identity_model(f.read()))
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        for i in range(n):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁") or "\n" in piece:
                raise ValueError(f"the piece {piece!r} can run over a place where chunks are cut")
        split = self.a.pre_tokenizer.pre_tokenize_str
        check_pattern(lambda text: [t for t, _ in split(text)])

    def link(self, chunks: list[str]) -> list[tuple[bytes, ...]]:
        """For each chunk: its groups as text, each after a semicolon; its links, the A id above the B id; and numbers: A and B tokens, groups, whether bytes differ."""
        # Chunks that end in no white space are encoded a few hundred at a time, as one text: tokens end where chunks do.
        closed = [c for c in chunks if not ends_open(c)]
        made = dict(zip(closed, self._joined(closed), strict=True))
        rest = [c for c in chunks if c not in made or made[c] is None]
        made.update(zip(rest, self._apart(rest), strict=True))
        return [made[c] for c in chunks]

    def _joined(self, chunks: list[str], size: int = 400) -> list[tuple[bytes, ...]] | list[None]:
        """The same for chunks encoded together; nothing for any if the bytes of some differ."""
        texts = ["".join(chunks[k : k + size]) for k in range(0, len(chunks), size)]
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        raw = [c.encode() for c in chunks]
        whole = b"".join(raw)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        for f, table, sizes in zip(found, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True):
            ids = [i for x in f for i in x]
            if b"".join(map(table.__getitem__, ids)) != whole or not np.isin(ends, np.cumsum(sizes[np.array(ids, np.int64)]), assume_unique=True).all():
                return [None] * len(chunks)
        return self._linked(raw, *found)

    def _apart(self, chunks: list[str]) -> list[tuple[bytes, ...]]:
        """The same for chunks one by one; those that a tokenizer does not give back have no tokens."""
        raw = [c.encode() for c in chunks]
        found = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)], self.b.encode(chunks, num_threads=1)
        good = [all(b"".join(map(t.__getitem__, f[k])) == raw[k] for f, t in zip(found, (self.a_bytes, self.b_bytes), strict=True)) for k in range(len(raw))]
        at = [k for k, g in enumerate(good) if g]
        out = [(b"", b"", np.array([0, 0, 0, 1], np.uint32).tobytes())] * len(raw)
        for k, value in zip(at, self._linked([raw[k] for k in at], [found[0][k] for k in at], [found[1][k] for k in at]), strict=True):
            out[k] = value
        return out

    def _linked(self, raw: list[bytes], found_a: list[list[int]], found_b: list[list[int]]) -> list[tuple[bytes, ...]]:
        """Groups, links and numbers of chunks whose bytes are those of their tokens: all chunks as one row of bytes.

        Between two neighbouring ends of tokens, of either kind, lie bytes of one A and one B token; so each link is one such stretch.
        """
        if not raw:
            return []
        chunk_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a, b = (np.array([i for x in f for i in x], np.int64) for f in (found_a, found_b))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        cuts = ends[(end_a[in_a] == ends) & (end_b[in_b] == ends)]
        links = ((a[in_a] << 32) | b[in_b]).astype(np.uint64).tobytes()
        # The groups' text: A ids of a group, then its B ids, each after the character that parts it from what was before.
        group = np.concatenate([2 * np.searchsorted(cuts, end_a), 2 * np.searchsorted(cuts, end_b) + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([a, b])[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        mark = np.where(first, np.where(group & 1, ord("|"), ord(";")), ord(",")).astype(np.uint8)
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
        last = np.cumsum(digits + 1)
        text = np.empty(int(last[-1]), np.uint8)
        text[last - digits - 1] = mark
        rest = ids.copy()
        for k in range(int(digits.max())):
            some = digits > k
            text[(last - 1 - k)[some]] = 48 + rest[some] % 10
            rest //= 10
        # Where each chunk ends in the text, the links and the tokens.
        text_at = np.append(0, last)[np.searchsorted(cuts[group >> 1], chunk_ends, "right")].tolist()
        text = text.tobytes()
        link_at = (8 * np.searchsorted(ends, chunk_ends, "right")).tolist()
        numbers = np.stack([np.diff(np.searchsorted(e, chunk_ends, "right"), prepend=0) for e in (end_a, end_b, cuts)] + [np.zeros(len(raw), np.int64)], axis=1).astype(np.uint32).tobytes()
        out, t, k = [], 0, 0
        for i, (t_end, k_end) in enumerate(zip(text_at, link_at, strict=True)):
            out.append((text[t:t_end], links[k:k_end], numbers[16 * i : 16 * i + 16]))
            t, k = t_end, k_end
        return out


def _cache(a_path: str, b_path: str) -> ChunkCache:
    return kept(f"aligner {a_path} {b_path}", lambda: ChunkCache(Aligner(a_path, b_path).link, (1, 8, 4), limit=150_000, group=1 << 19))


def _rows(pairs: np.ndarray, place: np.ndarray, count: np.ndarray, block: int) -> pa.RecordBatch:
    """The bitmaps and planes of a block, from its entries: a pair, a document's place, the pair's multiplicity there."""
    order = np.argsort(pairs, kind="stable")  # places of a pair stay ascending
    pairs, place, count = pairs[order], place[order], count[order]
    parts: list[tuple[np.ndarray, ...]] = []

    def bitmaps(some: np.ndarray, weight: int, present: np.ndarray) -> None:
        """Rows of (pair, weight, present, words' places, words) for the entries ``some``; present says of each pair whether this bitmap is that of its documents."""
        p, w = pairs[some], place[some] >> 6
        bit = np.uint64(1) << (place[some] & 63).astype(np.uint64)
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        at = np.flatnonzero(new)
        words, of = np.bitwise_or.reduceat(bit, at), p[at]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        parts.append((of[first], np.full(len(first), weight), present[some][at][first], np.diff(np.append(first, len(of))), w[at], words))

    # A pair of which every document has multiplicity one has one bitmap, which is its first plane as well.
    begins = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    single = np.repeat(np.maximum.reduceat(count, begins) == 1, np.diff(np.append(begins, len(pairs))))
    for some, weight in [(single, 1), (~single, 0)] + [(~single & ((count >> k) & 1 == 1), 1 << k) for k in range(int(count.max()).bit_length())]:
        if some.any():
            bitmaps(some, weight, single | (weight == 0))
    pair, weight, present, size, at, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    fields = {
        "block": np.full(len(pair), block), "a": (pair >> np.uint64(32)).astype(np.int64), "b": (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), "weight": weight.astype(np.int64), "present": pa.array(present),
        "at": pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), "words": pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64))),
    }
    return pa.RecordBatch.from_pydict(fields)


def _encoded(docs: DataFrame, keep: tuple[str, ...], a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (block and place, columns ``keep``, numbers and digest) and rows of postings (block, a, b, weight, present, at, words), the other columns being null."""
    held = docs.select(*keep).schema
    doc_fields = [*keep, "block", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held) + "block long, place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a long, b long, weight long, present boolean, at array<int>, words array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, arrow = _cache(a_path, b_path), None

        def whole(part: pa.RecordBatch) -> pa.RecordBatch:
            """The row kind's columns, and nulls in the others."""
            return pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(len(part), f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if arrow is None:
                own = [pa.field(c, batch.schema.field(c).type) for c in keep]
                longs = [pa.field(c, pa.int64()) for c in ("block", "place", "n_a", "n_b", "n_groups", "n_links")]
                arrow = pa.schema([*own, *longs, pa.field("groups_sha256", pa.string()), *(pa.field(c, pa.int64()) for c in ("a", "b", "weight")), pa.field("present", pa.bool_()), pa.field("at", pa.list_(pa.int32())), pa.field("words", pa.list_(pa.int64()))])
            told: list[tuple] = []
            entries: list[tuple[np.ndarray, np.ndarray, int]] = []
            begin = 0

            def block(end: int, batch=batch) -> Iterator[pa.RecordBatch]:
                nonlocal begin, told, entries
                number = batch.column("__row")[begin].as_py()
                part = batch.slice(begin, end - begin).select(list(keep))
                numbers = np.array([t[:4] for t in told], np.int64)
                columns = [*part.columns, np.full(len(told), number), np.arange(len(told)), *numbers.T, pa.array([t[4] for t in told])]
                yield whole(pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], doc_fields))
                if entries:
                    place = np.repeat([e[2] for e in entries], [len(e[0]) for e in entries])
                    rows = whole(_rows(np.concatenate([e[0] for e in entries]), place, np.concatenate([e[1] for e in entries]), number))
                    for lo in range(0, len(rows), 20_000):
                        yield rows.slice(lo, 20_000)
                begin, told, entries = end, [], []

            held, k = 0, -1
            texts = (f" {t}" if t else None for t in texts_of(batch.column("__text")))
            for k, (groups, links, numbers) in enumerate(cache.many(texts)):
                n = np.frombuffer(numbers, np.uint32).reshape(-1, 4).sum(0, dtype=np.int64).tolist()
                if not n[2] or n[3]:
                    told.append((0, 0, 0, 0, ""))
                else:
                    pairs, count = np.unique(np.frombuffer(links, np.uint64), return_counts=True)
                    told.append((n[0], n[1], n[2], len(links) // 8, hashlib.sha256(groups[1:]).hexdigest()))
                    entries.append((pairs, count, k - begin))
                    held += len(pairs)
                if len(told) >= BLOCK or held >= ENTRIES:
                    yield from block(k + 1)
                    held = 0
            if told:
                yield from block(k + 1)

    named = docs.select(*keep, F.col("text").cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    return named.mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """Of each pair (a, b): n_docs, the documents that link it, and n_links, the links, by popcounts."""
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
    return postings.groupBy("a", "b").agg(F.sum(F.when(F.col("present"), ones).otherwise(0)).alias("n_docs"), F.sum(ones * F.col("weight")).alias("n_links"))


def _scored(postings: DataFrame) -> DataFrame:
    """By block and place: n_best and count_sum, from postings (block, weight, at, words, n, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, best, total = None, None, None

        def done() -> pa.RecordBatch:
            place = np.flatnonzero(total)
            return pa.RecordBatch.from_pydict({"block": np.full(len(place), now), "place": place, "n_best": best[place], "count_sum": total[place]})

        for batch in batches:
            if not len(batch):
                continue
            blocks = batch.column("block").to_numpy()
            ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks))
            lo = 0
            for hi in ends.tolist():
                if blocks[lo] != now:
                    if now is not None:
                        yield done()
                    now, best, total = blocks[lo], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(lo, hi - lo)
                size = np.asarray(part.column("at").value_lengths(), np.int64)
                words, at = part.column("words").flatten().to_numpy().view(np.uint64), part.column("at").flatten().to_numpy().astype(np.int64)
                weight = np.repeat(part.column("weight").to_numpy(), size)
                n, top = np.repeat(part.column("n").to_numpy(), size), np.repeat(part.column("best").to_numpy(zero_copy_only=False), size)
                for a in range(0, len(words), 50_000):
                    bits = np.unpackbits(words[a : a + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    row, bit = np.nonzero(bits)
                    where = (at[a : a + 50_000][row] << 6) + bit
                    times = weight[a : a + 50_000][row]
                    np.add.at(total, where, times * n[a : a + 50_000][row])
                    np.add.at(best, where, times * top[a : a + 50_000][row])
                lo = hi
        if now is not None:
            yield done()

    dealt = postings.select("block", "weight", "at", "words", "n", "best").repartition(partitions(postings.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block long, place long, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Documents (columns ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and pairs (a, b, n_docs, n_links, best)."""
    made = ("block", "place", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "a", "b", "weight", "present", "at", "words", "__text", "__row")
    keep = without(keep, *made)
    both = materialise(_encoded(docs, keep, a_path, b_path), "alignment")
    postings = both.where("weight IS NOT NULL").select("block", "a", "b", "weight", "present", "at", "words")
    counted = materialise(pair_counts(postings), "alignment-pairs")
    highest = counted.groupBy("b").agg(F.max("n_links").alias("most"))
    pairs = counted.join(highest, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))
    # Pairs grow with the corpus, so both sides are dealt out at any size.
    scores = _scored(postings.where("weight > 0").join(pairs.select("a", "b", F.col("n_links").alias("n"), "best").hint("merge"), ["a", "b"]))
    found = both.where("weight IS NULL").join(scores, ["block", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(*keep, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level vocabulary with a piece vocabulary over all documents."""
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
