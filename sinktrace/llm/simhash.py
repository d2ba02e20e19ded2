"""SimHash fingerprints and near-duplicate groups by BK-trees.

A fingerprint has 64 bits, from the XXH64 values (seed 42) of a text's word shingles. Fingerprints that
differ in at most ``radius`` bits are linked. Each distinct fingerprint is dealt to shards by the blocks
of its bits: with one block more than the radius, two linked fingerprints agree in one block at least, so
every link lies within a shard. A shard holds a BK-tree: the children of a node are keyed by their integer
Hamming distance to it, and a search follows the edges within the radius only. A shard that is too large
is dealt out again by blocks of its remaining bits, which loses no link for the same reason.

A shard gives a spanning forest of its links, never all pairs: at most one edge for each fingerprint in
it. Whole components come from the edges by rounds of minimum labels over a checkpointed table.

Defined cases: a text without words has fingerprint zero, linked like any other; null is an empty text; a
null doc_id is carried, and a component of null ids alone has a null id; repeated rows get a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.caches import release
from sinktrace.llm.columns import texts_of, without
from sinktrace.llm.words import mixed
from sinktrace.storage import materialise, partitions, spread

BITS, WIDE = 64, 128


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text: bit b is set if it is set in over half of its shingles' hash values."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not tokens:
        return 0
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """Columns ``keep`` of docs, then fp: the fingerprint as a signed 64-bit integer."""
    keep = without(keep, "fp", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in texts_of(batch.column("__text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, held + "fp long")


def _split(df: DataFrame, width: int, blocks: int) -> DataFrame:
    """Deal each row (fp, rest: its remaining ``width`` bits, key) out by ``blocks`` blocks of the remaining bits."""
    cuts = [width * k // blocks for k in range(blocks + 1)]
    mask = lambda n: (1 << n) - 1
    rest = F.col("rest")
    choices = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        value = F.shiftrightunsigned(rest, a).bitwiseAND(F.lit(mask(b - a)))
        low = rest.bitwiseAND(F.lit(mask(a)))
        high = F.lit(0).cast("long") if b == 64 else F.shiftleft(F.shiftrightunsigned(rest, b), a)
        choices.append(F.struct(F.concat_ws("/", F.col("key"), F.lit(k), value.cast("string")).alias("key"), high.bitwiseOR(low).alias("rest")))
    return df.select("fp", F.explode(F.array(*choices)).alias("x")).select("fp", "x.key", "x.rest")


def shards(fps: DataFrame, radius: int, limit: int, levels: int = 3) -> DataFrame:
    """Rows (fp, key) of all shards with two fingerprints or more. Those of over ``limit`` are dealt out again, ``levels`` times at most."""
    blocks, width = radius + 1, BITS
    now, out = fps.select("fp", F.col("fp").alias("rest"), F.lit("").alias("key")), None
    for level in range(levels):
        dealt = _split(now, width, blocks)
        width -= width // blocks
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        dealt = dealt.join(sizes, "key")
        small = dealt if level == levels - 1 else dealt.where(F.col("n") <= limit)
        out = small.select("fp", "key") if out is None else out.unionByName(small.select("fp", "key"))
        if level == levels - 1:
            return out
        now = materialise(dealt.where(F.col("n") > limit).select("fp", "rest", "key"), f"simhash-large-{level}")
        if now.isEmpty():
            return out
    return out


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits in which fingerprints differ; each row of x and y is one, in 64-bit words."""
    out = np.bitwise_count(x[:, 0] ^ y[:, 0]).astype(np.int64)
    for k in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, k] ^ y[:, k])
    return out


class BkTrees:
    """BK-trees of many shards at once, in arrays: item i is a node; its parent, its distance to it, and its children by distance."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """values: rows of unsigned 64-bit words, different within a shard; shard: their shards' numbers, ascending."""
        self.values = values
        n, far = len(values), 64 * values.shape[1] + 1
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        self.weight = np.bincount(shard, minlength=1)[shard] if n else np.empty(0, np.int64)  # the size of an item's tree
        items, group = np.arange(n), shard.astype(np.int64)
        while len(items):
            # items of one group are together, the first being the node at which the others part by distance
            first = np.concatenate([[True], group[1:] != group[:-1]])
            heads = items[first][np.cumsum(first) - 1]
            items, heads = items[~first], heads[~first]
            d = distance(values[items], values[heads])
            self.parent[items], self.edge[items] = heads, d
            order = np.lexsort((items, d, heads))
            items = items[order]
            group = heads[order] * far + d[order]
        self._index_children()

    def _index_children(self) -> None:
        """The child of a node at a distance is the first item that went there; only it stays a child."""
        n = len(self.values)
        child = np.flatnonzero(self.parent >= 0)
        self.children = child[np.lexsort((child, self.edge[child], self.parent[child]))]
        # an item's parent is the last node that it was compared with, so parents and distances are unique pairs
        bounds = np.searchsorted(self.parent[self.children], np.arange(n + 1))
        self.low, self.high = bounds[:-1], bounds[1:]

    def links(self, items: np.ndarray, roots: np.ndarray, radius: int, merge) -> None:
        """Search for the items in the trees of their roots; ``merge(a, b)`` gets arrays of linked items."""
        block = np.cumsum(self.weight[items]) >> 18  # so that a block meets some 260,000 nodes at most, or one tree
        bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(items)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            query = items[lo:hi]
            node = roots[query]
            while len(query):
                d = distance(self.values[query], self.values[node])
                near = (d <= radius) & (query != node)
                merge(query[near], node[near])
                count = self.high[node] - self.low[node]
                at = np.repeat(self.low[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
                child, query, d = self.children[at], np.repeat(query, count), np.repeat(d, count)
                follow = np.abs(self.edge[child] - d) <= radius
                query, node = query[follow], child[follow]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item reachable over the pairs."""
    label = np.arange(n)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*pairs, strict=True)) if pairs else (label[:0], label[:0])
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


class Links:
    """Links between n items, kept in bounded room."""

    def __init__(self, n: int):
        self.n, self.held = n, 0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))
        self.held += len(a)
        if self.held > 1 << 19:  # a forest says the same in less room
            self.pairs = [self.moved()]
            self.held = len(self.pairs[0][0])

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """The items that reach a smaller one, and the smallest that each reaches."""
        label = forest(self.n, self.pairs)
        moved = np.flatnonzero(label != np.arange(self.n))
        return moved, label[moved]


def shard_edges(fps: np.ndarray, key: np.ndarray, radius: int, leaders: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, from each item to the smallest one that it reaches in its shard; rows of fps sorted by key.

    Items within the radius of one of their shard's first few leaders are in its ball and linked to it. Those of the
    largest ball need no search of their own: what they could find links them to each other, or is found from the
    other side. So a shard of many copies of one text costs little.
    """
    n = len(fps)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    shard = np.cumsum(first) - 1
    roots = np.flatnonzero(first)[shard]
    links = Links(n)
    merge = links.merge
    ball, left = np.full(n, -1, np.int64), np.arange(n)
    for _ in range(leaders):
        group = shard[left]
        begins = np.concatenate([[True], group[1:] != group[:-1]]) if len(left) else np.empty(0, bool)
        heads = left[begins][np.cumsum(begins) - 1] if len(left) else left
        near = distance(fps[left], fps[heads]) <= radius
        ball[left[near]] = heads[near]
        far = near & (left != heads)
        merge(left[far], heads[far])
        left = left[~near]
    size = np.bincount(ball[ball >= 0], minlength=n)
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, shard, size)
    chosen = np.full(n, -1, np.int64)  # by shard: the leader of a largest ball
    heads = np.flatnonzero((size > 0) & (size == largest[shard]))
    chosen[shard[heads]] = heads
    BkTrees(fps, shard).links(np.flatnonzero(ball != chosen[shard]), roots, radius, merge)
    return links.moved()


def far_edges(fps: np.ndarray, key: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the links of which one end at least is ``far``: those items are compared with all of their key."""
    links, bounds = Links(len(fps)), [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(fps)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        asked = lo + np.flatnonzero(far[lo:hi])
        for k in range(0, len(asked), 64):
            query = asked[k : k + 64]
            apart = sum(np.bitwise_count(fps[query, w][:, None] ^ fps[lo:hi, w][None, :]) for w in range(fps.shape[1]))
            a, b = np.nonzero(apart <= radius)
            links.merge(query[a], lo + b)
    return links.moved()


def whole_shards(batches: Iterator[pa.RecordBatch], key: str, size: int = 50_000) -> Iterator[pa.Table]:
    """Rows that come sorted by key as tables of some ``size`` rows, none of which ends within a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= size and held[0].column(key)[0] != batch.column(key)[len(batch) - 1]:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = t.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
            lo = int(np.searchsorted(codes, codes[-1]))  # codes ascend in the order of first places
            yield t.slice(0, lo)
            held = t.slice(lo).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def fingerprint_edges(fps: DataFrame, radius: int = 3, limit: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that give the components of all links at most ``radius`` bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_shards(batches, "key"):
            codes, values = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("fp").to_numpy()
            a, b = shard_edges(values.view(np.uint64).reshape(-1, 1), codes, radius)
            yield pa.RecordBatch.from_pydict({"a": pa.array(values[a], pa.int64()), "b": pa.array(values[b], pa.int64())})

    spark = fps.sparkSession
    dealt = shards(fps, radius, limit).repartition(partitions(spark), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star rounds: each is one aggregation by node, and a hot node's
    neighbours are never gathered in one row. Rounds end when the edges no longer change.
    """
    now = materialise(edges.where("a != b").select("a", "b"), "components")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        now = materialise(small, "components")
        new = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3, radius: int = 3, limit: int = 20_000) -> DataFrame:
    """Columns ``keep`` of docs (doc_id among them), then fp and component_id: the smallest doc_id that a document reaches."""
    keep = without(keep, "fp", "component_id")
    marked = materialise(with_fingerprints(docs, keep, words), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    found = components(fingerprint_edges(classes.select("fp"), radius, limit))
    whole = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    low = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = whole.join(low, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(*keep, "fp", "component_id")


def bit_odds(similarity: float) -> float:
    """How likely a fingerprint bit differs between two sets of this Jaccard similarity: the angle between them over pi, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_fingerprint(codes: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed words, from the distinct 64-bit codes of a text's shingles; a bit is set if it is set in over half of their hash values."""
    ones = np.zeros(WIDE, np.int64)
    for lo in range(0, len(codes), 1 << 14):
        part = codes[lo : lo + (1 << 14)]
        hashes = np.stack([mixed(part, 11), mixed(part, 12)], axis=1)
        ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    low, high = np.packbits(2 * ones > len(codes), bitorder="little").view(np.int64).tolist()
    return low, high


def _tables(n: int, similarity: float, recall: float) -> np.ndarray:
    """Bit places of each table's key, a row for each table.

    A key has so many bits that a shard holds some four of n unlike fingerprints; and so many tables are dealt that two sets of
    the similarity meet in one of them with the odds ``recall``.
    """
    bits = min(40, max(8, n.bit_length() - 2))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - bit_odds(similarity)) ** bits))
    random = np.random.default_rng(42)
    return np.stack([random.permutation(WIDE)[:bits] for _ in range(tables)])


def tiles(crowded: DataFrame, radius: int, size: int) -> DataFrame:
    """Rows (key, low, high, far) of tiles in which all pairs of crowded shards meet that their leaders don't link.

    crowded: rows (key, low, high, apart: the distance from the shard's leader). Rows within the radius are linked by the leader, so a pair
    left has one at least that is far. Blocks of some ``size`` far rows meet each other and blocks of near rows, two to a tile. A near
    row that is closer to the leader than all far ones, by more than the radius, is out of their reach, by the triangle inequality.
    """
    far = F.col("apart") > radius
    sizes = crowded.groupBy("key").agg(F.count_if(far).alias("n_far"), F.min(F.when(far, F.col("apart"))).alias("least"))
    left = crowded.join(sizes.where("n_far > 0"), "key").where(far | (F.col("apart") >= F.col("least") - radius))
    counts = left.groupBy("key").agg(F.count_if(~far).alias("n_near"), F.count_if(far).alias("n_far"))
    # Far blocks are numbered from 0 on, those of near rows follow them.
    rows = left.select("key", "low", "high", far.alias("far")).join(counts, "key")
    blocks = lambda n: F.ceil(F.col(n) / size)
    placed = rows.select("key", "low", "high", "far", blocks("n_far").alias("fars"), blocks("n_near").alias("nears"), F.xxhash64("low", "high").alias("h"))
    own = F.when(F.col("far"), F.pmod("h", "fars")).otherwise(F.col("fars") + F.pmod("h", "nears"))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("far"), F.col("fars") + F.col("nears")).otherwise(F.col("fars")) - 1)
    dealt = placed.select("key", "low", "high", "far", own.alias("own"), F.explode(others).alias("other"))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "low", "high", "far")


def wide_edges(fps: DataFrame, similarity: float = 0.8, recall: float = 0.9, hot: int = 2_000) -> DataFrame:
    """Edges (a, b) between the low words of distinct fingerprints (low, high): candidates for sets of the similarity or more.

    Two fingerprints are linked if they agree in all bits of a table's key and differ in no more bits than two sets of the
    similarity do but once in forty. A shard of some ``hot`` fingerprints or more, as the copies of one text make, is not gathered, and loses
    no link either: each of its fingerprints is compared with a leader of the shard, another one in each table. Those within the radius
    of it are linked by it; those that are not meet all others, in ``tiles`` of bounded size.
    """
    odds = bit_odds(similarity)
    radius = math.ceil(WIDE * odds + 2 * math.sqrt(WIDE * odds * (1 - odds)))
    places = _tables(fps.count(), similarity, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 2_000):
                part = batch.slice(lo, 2_000)
                words = np.stack([part.column("low").to_numpy(), part.column("high").to_numpy()], axis=1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                key = np.stack([bits[:, p] @ weight + (np.int64(t) << 44) for t, p in enumerate(places)], axis=1)
                yield pa.RecordBatch.from_pydict({"key": key.ravel(), "low": np.repeat(words[:, 0], len(places)), "high": np.repeat(words[:, 1], len(places))})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in whole_shards(batches, "key"):
            key = t.column("key").to_numpy()
            same = key[1:] == key[:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            words = np.stack([t.column("low").to_numpy(), t.column("high").to_numpy()], axis=1)[several]
            a, b = shard_edges(words.view(np.uint64), key[several], radius)
            yield pa.RecordBatch.from_pydict({"a": words[a, 0], "b": words[b, 0]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_shards(batches, "key"):
            words = np.stack([t.column("low").to_numpy(), t.column("high").to_numpy()], axis=1)
            a, b = far_edges(words.view(np.uint64), t.column("key").to_numpy(), t.column("far").to_numpy(), radius)
            yield pa.RecordBatch.from_pydict({"a": words[a, 0], "b": words[b, 0]})

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "key").sortWithinPartitions("key")

    spark, schema = fps.sparkSession, "key long, low long, high long"
    dealt = fps.mapInArrow(deal, schema)
    some = fps.where("pmod(xxhash64(low, high), 16) = 0").mapInArrow(deal, schema)
    leader = F.min_by(F.struct("low", "high"), F.xxhash64("key", "low", "high")).alias("leader")
    crowded = materialise(some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), leader).where(F.col("n") >= hot // 16).select("key", "leader"), "simhash-hot")
    edges = None
    if not crowded.isEmpty():
        apart = F.bit_count(F.col("low").bitwiseXOR(F.col("leader.low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("leader.high")))
        met = materialise(dealt.join(crowded, "key").select("key", "low", "high", F.col("leader.low").alias("leader"), apart.alias("apart")), "simhash-crowded")
        edges = met.where(F.col("apart") <= radius).select(F.col("low").alias("a"), F.col("leader").alias("b")).where("a <> b")
        edges = edges.unionByName(gathered(tiles(met, radius, 4 * hot)).mapInArrow(meet, "a long, b long"))
        dealt = dealt.join(crowded, "key", "left_anti")
    found = gathered(dealt).mapInArrow(search, "a long, b long")
    return (found if edges is None else found.unionByName(edges)).distinct()


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: doc_id, fingerprint, component_id."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
