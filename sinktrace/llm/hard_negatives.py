"""Hard-negative mining: Hilbert-ordered blocks of vectors with zone maps, read only where an anchor's windows may need them.

Vectors are quantised to integers, put in the order of their labels and then of a Hilbert curve over all dimensions,
and written as Parquet blocks of at most ``BLOCK`` rows. A block's zone map has the least and greatest value in each
dimension; interval arithmetic on it bounds the inner products that an anchor can have in the block. An anchor first
looks for its positives, in blocks of its label whose bound reaches the fifth score that its own block gives; then for
negatives, in blocks of other labels whose bounds meet one of its windows, and reach the fifth score already found in
the window. All bounds are exact, so the result is that of a full comparison.

Neighbouring blocks make up a region, which one task holds. Anchors are sent to regions by a coarse zone map of at most
``COARSE`` boxes, which is broadcast and does not grow; regions that no anchor is sent to are not read. So an anchor's
vector travels once to each region that it may need, and vectors of a region are shuffled once for each search. No
label is a single key: a hot one takes more regions.

Defined cases: rows with a null vec_id, label or vector, or a component that is null or not finite take no part;
shorter vectors count as padded with zeros; of rows with one vec_id each is a row, and each that is an anchor has its
own results; equal scores go by smaller vec_id. Sums that leave 64 bits wrap around, as long arithmetic does; where
numbers are so large, no block is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinktrace.llm.simhash import whole_shards
from sinktrace.storage import materialise, partitions

BLOCK, REGION, COARSE = 1024, 1 << 18, 4096
_NONE = np.iinfo(np.int64).min


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place on a Hilbert curve of each row of cells, unsigned integers of so many bits (Skilling's transform, all rows at once)."""
    x = cells.T.astype(np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(on, low, swap)
            x[i] ^= np.where(on, np.uint32(0), swap)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = np.concatenate([(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


@dataclass(frozen=True)
class Shape:
    """What all vectors have in common: dimensions, the greatest absolute value, and how they are held."""

    dims: int
    top: int

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.int16 if self.top < 1 << 15 else np.int32 if self.top < 1 << 31 else np.int64)

    @property
    def exact(self) -> bool:
        """Whether doubles hold every inner product exactly, times the rows of a block."""
        return self.top * self.top * max(1, self.dims) * BLOCK < 1 << 53

    def products(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Inner products of rows with rows."""
        if self.exact:
            return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
        with np.errstate(over="ignore"):
            return x.astype(np.int64) @ y.T.astype(np.int64)

    def bounds(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product that each row of x can have with a vector of each box, by interval arithmetic."""
        if not self.exact:
            size = (len(x), len(low))
            return np.full(size, _NONE), np.full(size, np.iinfo(np.int64).max)
        up, down = np.maximum(x, 0).astype(np.float64), np.minimum(x, 0).astype(np.float64)
        low, high = low.T.astype(np.float64), high.T.astype(np.float64)
        return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label and q, the floor of 256 times each component, of the rows (vec_id, label, embedding) that take part; every seventh vec_id has the next label."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return used.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    size = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy()
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(vectors: DataFrame, shape: Shape, regions: int) -> DataFrame:
    """The block table: region, block, label, ids and q of the rows, ascending by id, and the zone map low, high."""
    shift, dims = max(0, shape.top.bit_length() + 1 - 4), shape.dims

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = _matrix(batch.column("q"), dims)
                key = hilbert_keys((q >> shift) + 8, 4) if dims else [b""] * len(batch)
                held = q.astype(shape.kind)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(key, pa.binary()), pa.array([r.tobytes() for r in held], pa.binary())], ["vec_id", "label", "key", "q"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, q, label, region = 0, np.empty(0, np.int64), np.empty((0, dims), shape.kind), None, 0

        def block() -> pa.RecordBatch:
            nonlocal number
            order, number = np.argsort(ids, kind="stable"), number + 1
            row = {"region": pa.array([region], pa.int32()), "block": [(region << 32) + number], "label": [label], "ids": [ids[order].tobytes()], "q": [np.ascontiguousarray(q[order]).tobytes()], "low": [q.min(0).astype(np.int64).tobytes()], "high": [q.max(0).astype(np.int64).tobytes()]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            if not len(batch):
                continue
            labels, region = batch.column("label").to_numpy(), batch.column("region")[0].as_py()
            more_ids = batch.column("vec_id").to_numpy()
            more = np.frombuffer(b"".join(batch.column("q").to_pylist()), shape.kind).reshape(len(batch), dims)
            ends = np.append(np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(labels))
            lo = 0
            for hi in ends.tolist():
                if len(ids) and label != labels[lo]:
                    yield block()
                    ids, q = ids[:0], q[:0]
                label = int(labels[lo])
                ids, q = np.concatenate([ids, more_ids[lo:hi]]), np.concatenate([q, more[lo:hi]])
                while len(ids) >= BLOCK:
                    rest_ids, rest = ids[BLOCK:], q[BLOCK:]
                    ids, q = ids[:BLOCK], q[:BLOCK]
                    yield block()
                    ids, q = rest_ids, rest
                lo = hi
        if len(ids):
            yield block()

    placed = vectors.mapInArrow(keyed, "vec_id long, label long, key binary, q binary").repartitionByRange(regions, "label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    dealt = placed.select(F.spark_partition_id().alias("region"), "vec_id", "label", "q")
    return materialise(dealt.mapInArrow(cut, "region int, block long, label long, ids binary, q binary, low binary, high binary"), "negatives-blocks")


def _coarse(blocks: DataFrame, width: int, dims: int) -> pa.Table:
    """The coarse zone map: for each run of ``width`` regions its box and labels; at most ``COARSE`` rows."""

    def merged(rows: pa.Table) -> dict:
        low = np.stack([np.frombuffer(x, np.int64) for x in rows.column("low").to_pylist()]).min(0) if dims else np.empty(0, np.int64)
        high = np.stack([np.frombuffer(x, np.int64) for x in rows.column("high").to_pylist()]).max(0) if dims else np.empty(0, np.int64)
        return {"run": [rows.column("run")[0].as_py()], "low": [low.tobytes()], "high": [high.tobytes()], "least": [min(rows.column("least").to_pylist())], "most": [max(rows.column("most").to_pylist())], "last": pa.array([max(rows.column("last").to_pylist())], pa.int32())}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            runs = t.column("run").to_numpy()
            for r in np.unique(runs).tolist():
                yield pa.RecordBatch.from_pydict(merged(t.filter(pa.array(runs == r))))

    schema = "run long, low binary, high binary, least long, most long, last int"
    rows = blocks.select(F.floor(F.col("region") / width).alias("run"), "low", "high", F.col("label").alias("least"), F.col("label").alias("most"), F.col("region").alias("last"))
    parts = rows.mapInArrow(partial, schema)
    return parts.groupBy("run").applyInArrow(lambda t: pa.Table.from_pydict(merged(t)), schema).toArrow()


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each slot, by falling score and rising id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[rank < k]


class _Running:
    """The first k entries of each slot so far, and the score that a further one must reach."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.reach = k, least.copy()
        self.slot, self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = _best(slot, score, ids, self.k)
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        count = np.bincount(self.slot, minlength=len(self.reach))
        last = np.cumsum(count) - 1
        full = count >= self.k
        self.reach[full] = np.maximum(self.reach[full], self.score[last[full]])


class _Region:
    """The blocks of a region that a task holds."""

    def __init__(self, shape: Shape):
        self.shape, self.label, self.number, self.ids, self.q, self.low, self.high = shape, [], [], [], [], [], []

    def take(self, row: dict) -> None:
        self.label.append(row["label"])
        self.number.append(row["block"])
        self.ids.append(np.frombuffer(row["ids"], np.int64))
        self.q.append(np.frombuffer(row["q"], self.shape.kind).reshape(len(self.ids[-1]), self.shape.dims))
        self.low.append(np.frombuffer(row["low"], np.int64))
        self.high.append(np.frombuffer(row["high"], np.int64))

    def read(self, label: int, same: bool, x: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Block by block, those of greatest bound first: its place, the anchors that need it, and their scores in it. ``wanted(low, high)`` says who needs a block."""
        at = [k for k, v in enumerate(self.label) if (v == label) == same]
        if not at:
            return
        low, high = self.shape.bounds(x, np.stack([self.low[k] for k in at]), np.stack([self.high[k] for k in at]))
        for j in np.argsort(-high.max(0), kind="stable").tolist():
            need = np.flatnonzero(wanted(low[:, j], high[:, j]))
            if len(need):
                yield at[j], need, self.shape.products(x[need], self.q[at[j]])


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _anchors(blocks: DataFrame, shape: Shape, every: int, positives: int) -> DataFrame:
    """Packs of anchors of one block: label, at (block and place in it), id, q, and windows: for each the score that a positive must reach, and none above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                chosen = np.flatnonzero(ids % every == 0)
                if not len(chosen):
                    continue
                q = np.frombuffer(row["q"], shape.kind).reshape(len(ids), shape.dims)
                score = shape.products(q[chosen], q)
                score[np.arange(len(chosen)), chosen] = _NONE
                reach = np.sort(score, axis=1)[:, -positives] if len(ids) > positives else np.full(len(chosen), _NONE)
                windows = np.stack([reach, np.full(len(chosen), np.iinfo(np.int64).max)], axis=1)
                at = np.stack([np.full(len(chosen), row["block"]), chosen], axis=1)
                yield pa.RecordBatch.from_pydict({"label": [row["label"]], "at": [_pack(at)], "ids": [_pack(ids[chosen])], "q": [_pack(q[chosen])], "windows": [_pack(windows)]})

    return blocks.select("block", "label", "ids", "q").mapInArrow(run, "label long, at binary, ids binary, q binary, windows binary")


def _search(blocks: DataFrame, anchors: DataFrame, shape: Shape, coarse: pa.Table, width: int, same: bool, k: int) -> DataFrame:
    """The first k rows in each window of each anchor, by region: block and place of the anchor, its id, window (from 0), id, score.

    ``same``: rows of the anchor's label other than itself, else of other labels.
    """
    spark = blocks.sparkSession
    runs, least, most = (coarse.column(c).to_numpy() for c in ("run", "least", "most"))
    boxes = [np.stack([np.frombuffer(x, np.int64) for x in coarse.column(c).to_pylist()]) for c in ("low", "high")]
    zones = spark.sparkContext.broadcast((runs, least, most, boxes[0], boxes[1], coarse.column("last").to_numpy()))

    def meets(low: np.ndarray, high: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For anchors and boxes: whether a score in the box's bounds can lie in one of the anchor's windows."""
        w = windows[:, None] if low.ndim == 2 else windows
        return ((high[..., None] >= w[..., 0]) & (low[..., None] <= w[..., 1])).any(-1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, least, most, low, high, last = zones.value
        for batch in batches:
            for row in batch.to_pylist():
                x, w = np.frombuffer(row["q"], shape.kind).reshape(-1, shape.dims), np.frombuffer(row["windows"], np.int64)
                ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64).reshape(-1, 2)
                w = w.reshape(len(ids), -1, 2)
                fits = (least <= row["label"]) & (most >= row["label"]) if same else (least != row["label"]) | (most != row["label"])
                lo, hi = shape.bounds(x, low[fits], high[fits])
                needs = meets(lo, hi, w)
                for j, r in enumerate(np.flatnonzero(fits).tolist()):
                    who = np.flatnonzero(needs[:, j])
                    if not len(who):
                        continue
                    regions = np.arange(runs[r] * width, last[r] + 1, dtype=np.int32)
                    one = {"block": [0], "label": [row["label"]], "ids": [_pack(ids[who])], "q": [_pack(x[who])], "low": [_pack(w[who])], "high": [_pack(at[who])]}
                    yield pa.RecordBatch.from_pydict({"region": pa.array(regions), "kind": pa.array(np.ones(len(regions), np.int32))} | {c: v * len(regions) for c, v in one.items()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for row in (r for lo in range(0, len(batch), 64) for r in batch.slice(lo, 64).to_pylist()):
                if row["region"] != now:
                    now, held = row["region"], _Region(shape)
                if row["kind"] == 0:
                    held.take(row)
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                x, at = np.frombuffer(row["q"], shape.kind).reshape(len(ids), shape.dims), np.frombuffer(row["high"], np.int64).reshape(-1, 2)
                w = np.frombuffer(row["low"], np.int64).reshape(len(ids), -1, 2)
                found = _Running(w.shape[0] * w.shape[1], k, w[:, :, 0].ravel())
                top = w[:, :, 1]

                def wanted(low, high, found=found, top=top):
                    return ((high[:, None] >= found.reach.reshape(top.shape)) & (low[:, None] <= top) & (found.reach.reshape(top.shape) <= top)).any(1)

                for b, need, score in held.read(row["label"], same, x, wanted):
                    reach = found.reach.reshape(top.shape)[need]
                    some = (score >= reach.min(1)[:, None]) & (score <= top[need].max(1)[:, None])
                    if same:
                        own = np.flatnonzero(at[need, 0] == held.number[b])
                        some[own, at[need[own], 1]] = False
                    a, c = np.nonzero(some)
                    for i in range(top.shape[1]):
                        s = score[a, c]
                        fits = (s >= reach[a, i]) & (s <= top[need[a], i])
                        found.add(need[a[fits]] * top.shape[1] + i, s[fits], held.ids[b][c[fits]])
                if len(found.slot):
                    who, i = np.divmod(found.slot, top.shape[1])
                    yield pa.RecordBatch.from_pydict({"block": at[who, 0], "place": at[who, 1], "anchor_id": ids[who], "label": np.full(len(who), row["label"]), "which": i, "id": found.ids, "score": found.score})

    fields = "block long, label long, ids binary, q binary, low binary, high binary"
    routed = anchors.mapInArrow(route, "region int, kind int, " + fields)
    needed = routed.select("region").distinct()
    read = blocks.join(needed, "region", "left_semi").select("region", F.lit(0).alias("kind"), "block", "label", "ids", "q", "low", "high")
    both = read.unionByName(routed).repartition(partitions(spark), "region").sortWithinPartitions("region", "kind")
    return both.mapInArrow(search, "block long, place long, anchor_id long, label long, which long, id long, score long")


def _first(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The first k rows of each anchor (and window), ranked from 1."""
    by = Window.partitionBy("block", "place", *more).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _with_windows(anchors: DataFrame, positives: DataFrame, shape: Shape, low: int, high: int) -> DataFrame:
    """The anchors (as packs of one) with a window for each positive: from low to high per cent of its score."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64).reshape(-1, 2)
                q = np.frombuffer(row["q"], shape.kind).reshape(len(ids), shape.dims)
                yield pa.RecordBatch.from_pydict({"block": at[:, 0], "place": at[:, 1], "label": np.full(len(ids), row["label"]), "ids": ids, "q": [_pack(v) for v in q]})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_shards(batches, "label", 256):
            labels = t.column("label").to_numpy()
            for label in np.unique(labels).tolist():
                own = t.filter(pa.array(labels == label))
                for lo in range(0, len(own), 256):
                    part = own.slice(lo, 256).combine_chunks()
                    at = np.stack([part.column("block").to_numpy(), part.column("place").to_numpy()], axis=1)
                    scores = [sorted(s, reverse=True) for s in part.column("scores").to_pylist()]
                    w = np.tile(np.array([1, 0], np.int64), (len(part), max(map(len, scores)), 1))  # a window that nothing is in
                    for a, s in enumerate(scores):
                        for i, p in enumerate(s):
                            w[a, i] = -(-low * p // 100), high * p // 100
                    yield pa.RecordBatch.from_pydict({"label": [label], "at": [_pack(at)], "ids": [_pack(part.column("ids").to_numpy())], "q": [b"".join(part.column("q").to_pylist())], "windows": [_pack(w)]})

    each = anchors.mapInArrow(single, "block long, place long, label long, ids long, q binary")
    scores = positives.groupBy("block", "place").agg(F.collect_list("score").alias("scores"))
    met = each.join(scores, ["block", "place"]).repartition(partitions(anchors.sparkSession), "block").sortWithinPartitions("label", "block")
    return met.mapInArrow(packed, "label long, at binary, ids binary, q binary, windows binary")


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For rows (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. Negatives of a positive have scores of ``low`` to ``high`` per cent of its own.
    """
    spark = rows.sparkSession
    vectors = quantised(rows)
    seen = vectors.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, -1 - x))))).first()
    count, dims, top = seen[0], seen[1] or 0, (seen[2] or 0) + 1
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return spark.createDataFrame([], empty)
    shape = Shape(dims, top)
    regions = max(2 * partitions(spark), -(-count // REGION))
    blocks = _blocks(vectors, shape, regions)
    width = -(-regions // COARSE)
    coarse = _coarse(blocks, width, dims)
    anchors = materialise(_anchors(blocks, shape, every, positives), "negatives-anchors")
    found = _first(_search(blocks, anchors, shape, coarse, width, True, positives), positives)
    best = materialise(found.select("block", "place", "anchor_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("score")), "negatives-positives")
    windows = materialise(_with_windows(anchors, best, shape, low, high), "negatives-windows")
    met = _first(_search(blocks, windows, shape, coarse, width, False, negatives).withColumnRenamed("anchor_id", "a"), negatives, "which")
    named = best.withColumnRenamed("score", "positive_score").withColumn("which", (F.col("rank") - 1).cast("long")).drop("rank")
    out = met.join(named, ["block", "place", "which"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id AS id, a.k <> b.k AS other, a.label = b.label AS alike,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 100 = 0
), p AS (
  SELECT ak, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ak ORDER BY score DESC, id) AS which
  FROM s WHERE other AND alike QUALIFY which <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.ak, p.which ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
