"""Set similarity joins by prefix trees.

Sets of 64-bit codes are in one global order, frequent codes last. Two sets of a Jaccard similarity of at least
``per_mille`` / 1000 share one of their first n - ceil(n * per_mille / 1000) + 1 codes, their prefixes; the first code
that they share is in both. So sets meet in the group of each code of their prefix that is in another's as well, and a
pair counts in the group of its first shared code only. Codes that the same sets have make one group.

In a group the sets are stored in a trie, in the global order, chains of single children being one node of some
``SEGMENT`` codes. A search carries a probe's overlap down the trie, so sets with a common beginning share it, and leaves
a subtree when the overlap and the codes that remain, of the probe and of the longest set below, cannot reach what the
similarity asks of the smallest set below; or when a code before the group's own is shared. Tries of many groups are
searched at once, in arrays.

There are two searches. The first is over prefixes, short lists, and says which sets have a partner that the prefixes
allow; the second is over the whole sets of those, and gives links. A few probes of each group go first; a subtree that
is one component with the probe is left. So a group of copies gives a spanning forest and costs little more than a
comparison each. A group of over ``GROUP`` sets, or of very long ones, is cut into tiles of two parts each, so no task
holds a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.llm.simhash import forest, whole_shards
from sinktrace.storage import materialise, partitions

SEGMENT, GROUP, TOKENS = 32, 1_000, 2_000_000
_MASK = np.uint64((1 << 57) - 1)


def prefix_length(n: int, per_mille: int) -> int:
    """How many codes of a set of n the prefix has."""
    return n - -(-n * per_mille // 1000) + 1 if n else 0


def ordered(codes: np.ndarray, known: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Distinct 64-bit codes in the global order: those that are known to be frequent last, by buckets of their frequency."""
    out = codes & _MASK
    if len(known) and len(codes):
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        out |= np.where(known[at] == codes, bucket[at], np.uint64(0)) << np.uint64(57)
    out = np.sort(out).view(np.int64)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def frequent_codes(sample: DataFrame, limit: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Of a sample of rows (codes) the most frequent codes, ascending, and the binary order of their numbers: at most ``limit``. It bears on speed alone."""
    many = sample.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = many.orderBy(F.desc("n"), "code").limit(limit).toArrow()
    code, n = top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(code)
    return code[order], np.minimum(np.floor(np.log2(n[order])).astype(np.uint64), np.uint64(31))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] and the lengths[0] - 1 places after it, then those from starts[1] on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Tries:
    """Tries of many groups of sets, in arrays; items are the sets, in the order of their groups and lists.

    group: a number for each set; size: its codes; rest: those beyond its list; tokens, offsets: its list, ascending, of
    which it has the group's own code ``first``.
    """

    def __init__(self, group: np.ndarray, size: np.ndarray, rest: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, first: np.ndarray, per_mille: int):
        self.per_mille = per_mille
        length = np.diff(offsets)
        of = np.repeat(group, length)
        order = np.lexsort((tokens, of))
        new = np.concatenate([[True], (tokens[order][1:] != tokens[order][:-1]) | (of[order][1:] != of[order][:-1])]) if len(order) else np.empty(0, bool)
        dense = np.empty(len(tokens), np.int64)
        dense[order] = np.cumsum(new) - 1  # ascending by group and token
        several = np.bincount(dense)[dense] > 1 if len(dense) else new
        own = np.zeros(len(length), np.int64)
        mine = np.flatnonzero(tokens == first[of])
        own[np.repeat(np.arange(len(length)), length)[mine]] = dense[mine]
        dense, length = dense[several], np.bincount(np.repeat(np.arange(len(length)), length)[several], minlength=len(length))
        at = np.concatenate([[0], np.cumsum(length)])
        raw = dense.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        self.items = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.items = self.items[length[self.items] > 0]  # without a code of another's there is no link
        self.group, self.size, self.rest, self.own, self.length = group[self.items], size[self.items], rest[self.items], own[self.items], length[self.items]
        self.tokens = dense[_spread(at[self.items], self.length)]
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.span = int(dense.max()) + 1 if len(dense) else 1
        self.lookup = np.repeat(np.arange(len(self.items)), self.length) * self.span + self.tokens  # ascending
        if len(self.items):
            self._build()

    def _build(self) -> None:
        n = len(self.items)
        least = np.minimum(self.length[:-1], self.length[1:])
        common = np.zeros(n, np.int64)  # of an item and the next one; none over groups, as tokens differ
        if n > 1:
            k = np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)
            differ = self.tokens[_spread(self.at[:-2], least)] != self.tokens[_spread(self.at[1:-1], least)]
            common[:-1] = np.minimum.reduceat(np.where(differ, k, np.repeat(least, least)), np.cumsum(least) - least)
        cut = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        lo, hi, start, parent = cut, np.append(cut[1:], n), np.zeros(len(cut), np.int64), np.full(len(cut), -1)
        nodes: list[tuple[np.ndarray, ...]] = []
        total = 0
        while len(lo):
            shared = np.minimum.reduceat(np.append(common, 0), np.stack([lo, np.maximum(hi - 1, lo + 1)], 1).ravel())[::2]
            inner = np.where(hi - lo > 1, shared, self.length[lo])
            end = np.minimum(inner, start + SEGMENT)
            whole, ending = end == inner, self._ends(lo, hi, end)  # lists that end here come first in the node
            number = np.arange(total, total + len(lo))
            nodes.append((lo, hi, start, end, parent, ending))
            total += len(lo)
            # Children: the node itself, further down, or the runs of items that share more than its end.
            rows = _spread(lo + ending, hi - lo - ending)
            of = np.repeat(np.arange(len(lo)), hi - lo - ending)
            begins = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.empty(0, bool)
            begins |= whole[of] & (common[rows - 1] == end[of]) if len(of) else begins
            heads = np.flatnonzero(begins)
            lo, hi = rows[heads], rows[np.append(heads[1:], len(rows)) - 1] + 1 if len(heads) else rows[:0]
            start, parent = end[of[heads]], number[of[heads]]
        self.lo, self.hi, self.start, self.end, self.parent, self.ending = (np.concatenate(x) for x in zip(*nodes, strict=True))
        self.roots = np.arange(len(cut))
        # Nodes come level by level, children of one node together and in the order of their parents.
        child = np.arange(len(cut), total)
        self.first_child = np.searchsorted(self.parent[child], np.arange(total)) + len(cut)
        self.children = np.bincount(self.parent[child], minlength=total) if len(child) else np.zeros(total, np.int64)
        self.least, self.most = self._over(np.minimum, self.size), self._over(np.maximum, self.size)
        self.far, self.beyond = self._over(np.maximum, self.length) - self.end, self._over(np.maximum, self.rest)

    def _ends(self, lo: np.ndarray, hi: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many lists of each node end at its end."""
        rows, of = _spread(lo, hi - lo), np.repeat(np.arange(len(lo)), hi - lo)
        return np.bincount(of[self.length[rows] == end[of]], minlength=len(lo))

    def _over(self, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
        """A reduction over the items of each node."""
        out = np.empty(len(self.lo), values.dtype)
        for a in range(0, len(self.lo), 100_000):
            lo, hi = self.lo[a : a + 100_000], self.hi[a : a + 100_000]
            padded = np.append(values, values[-1:])
            out[a : a + 100_000] = reduce.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2]
        return out

    def _asked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The overlap that sets of these sizes need."""
        return -(-self.per_mille * (x + y) // (1000 + self.per_mille))

    def search(self, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of items (a, b) that connect what is linked; or, unless ``exact``, pairs of which each item has a partner that its list allows.

        Items are numbered as they were given.
        """
        n = len(self.items)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        label = np.arange(n)
        new = np.concatenate([[True], self.group[1:] != self.group[:-1]])
        place = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
        done = np.zeros(n, bool)
        for leaders in (1, 4, n):
            # The component of most items of each group: pairs within it need no search.
            count = np.bincount(label, minlength=n)[label]
            most = np.zeros(int(self.group.max()) + 1, np.int64)
            np.maximum.at(most, self.group, count)
            chief = np.full(len(most), n)
            np.minimum.at(chief, self.group[count == most[self.group]], label[count == most[self.group]])
            big = (label == chief[self.group]) & (most[self.group] > 1)
            probing = ~done & ~big & (place < leaders)
            # In the last round a pair of probes is looked at from its first one; a probe of an earlier round has met all others.
            self._descend(np.flatnonzero(probing), label, probing if leaders == n else np.zeros(n, bool), pairs)
            done |= probing
            if not exact:
                flagged = np.zeros(n, bool)
                for a, b in pairs:
                    flagged[a] = flagged[b] = True
                low = np.full(len(most), n)
                np.minimum.at(low, self.group[flagged], np.flatnonzero(flagged))
                pairs[:] = [(np.flatnonzero(flagged), low[self.group[flagged]])]
            label = forest(n, pairs)
            moved = np.flatnonzero(label != np.arange(n))
            pairs[:] = [(moved, label[moved])]
        a, b = pairs[0]
        return self.items[a], self.items[b]

    def _descend(self, probes: np.ndarray, label: np.ndarray, probing: np.ndarray, pairs: list) -> None:
        """Search for the probes and add to the pairs; of two items that are ``probing`` the first one finds the other."""
        low, high = self._over(np.minimum, label), self._over(np.maximum, label)
        held = 0
        root = np.searchsorted(self.lo[self.roots], probes, "right") - 1
        stack = [(probes[k : k + 20_000], root[k : k + 20_000], np.zeros(len(probes[k : k + 20_000]), np.int64)) for k in range(0, len(probes), 20_000)]
        while stack:
            x, node, overlap = stack.pop()
            # What each probe shares with its node's codes; a probe that lies in the node has them all.
            size, first = self.end[node] - self.start[node], self.at[self.lo[node]] + self.start[node]
            inside = (self.lo[node] <= x) & (x < self.hi[node])
            before = inside & (size > 0) & (self.tokens[np.minimum(first, len(self.tokens) - 1)] < self.own[x])
            out = np.flatnonzero(~inside & (size > 0))
            edge, of = self.tokens[_spread(first[out], size[out])], np.repeat(out, size[out])
            key = x[of] * self.span + edge
            hit = self.lookup[np.minimum(np.searchsorted(self.lookup, key), len(self.lookup) - 1)] == key
            before[of[hit & (edge < self.own[x[of]])]] = True
            overlap = overlap + np.where(inside, size, 0) + np.bincount(of[hit], minlength=len(x))
            x, node, overlap = x[~before], node[~before], overlap[~before]
            last = self.tokens[np.maximum(self.at[self.lo[node]] + self.end[node] - 1, 0)]
            passed = np.where(self.end[node] > 0, np.searchsorted(self.lookup, x * self.span + last, "right"), self.at[x])
            left, ends, many = self.at[x + 1] - passed, self.ending[node], self.children[node]
            block = np.cumsum(ends + many) >> 18
            bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(x)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = slice(lo, hi)
                # Lists that end here.
                y, of = _spread(self.lo[node[part]], ends[part]), lo + np.repeat(np.arange(hi - lo), ends[part])
                a = x[of]
                smaller, larger = np.minimum(self.size[a], self.size[y]), np.maximum(self.size[a], self.size[y])
                fits = (overlap[of] + np.maximum(self.rest[a], self.rest[y]) >= self._asked(smaller, larger)) & (1000 * smaller >= self.per_mille * larger)
                fits &= (label[a] != label[y]) & ((y > a) | ~probing[y])
                if fits.any():
                    pairs.append((a[fits], y[fits]))
                    held += int(fits.sum())
                    if held > 1 << 18:
                        found = forest(len(label), pairs)
                        moved = np.flatnonzero(found != np.arange(len(label)))
                        pairs[:], held = [(moved, found[moved])], len(moved)
                # Children that may hold a partner.
                child, of = _spread(self.first_child[node[part]], many[part]), lo + np.repeat(np.arange(hi - lo), many[part])
                p = x[of]
                most = overlap[of] + np.minimum(left[of], self.far[child] + self.end[child] - self.start[child]) + np.maximum(self.rest[p], self.beyond[child])
                follow = (most >= self._asked(self.size[p], self.least[child])) & (1000 * self.most[child] >= self.per_mille * self.size[p]) & (self.per_mille * self.least[child] <= 1000 * self.size[p])
                follow &= (low[child] != label[p]) | (high[child] != label[p])
                child, p, deep = child[follow], p[follow], overlap[of[follow]]
                for k in range(0, len(p), 20_000):
                    stack.append((p[k : k + 20_000], child[k : k + 20_000], deep[k : k + 20_000]))


def _groups(dealt: DataFrame, per_mille: int, exact: bool, rows: int) -> DataFrame:
    """Search groups (key, code, id, size, codes, all of them or a prefix): pairs (a, b), or, unless ``exact``, those (key, id) that have a partner so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_shards(batches, "key", rows):
            t = t.combine_chunks()
            key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            several = np.bincount(key)[key] > 1
            t = t.filter(pa.array(several)).combine_chunks()
            if not len(t):
                continue
            _, at, group = np.unique(key[several], return_index=True, return_inverse=True)
            size, ids, codes = t.column("size").to_numpy(), t.column("id").to_numpy(), t.column("codes").combine_chunks()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            flat = codes.flatten().to_numpy()
            offsets = np.concatenate([[0], np.cumsum(np.asarray(codes.value_lengths(), np.int64))])
            rest = np.zeros(len(t), np.int64) if exact else size - np.array([prefix_length(n, per_mille) for n in size.tolist()], np.int64)
            a, b = Tries(group, size, rest, flat, offsets, t.column("code").to_numpy()[at], per_mille).search(exact)
            if exact:
                yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b]})
            else:
                yield from t.select(["key", "code", "id"]).take(pa.array(np.unique(np.concatenate([a, b])))).to_batches()

    schema = "a long, b long" if exact else "key string, code long, id long"
    return dealt.repartition(partitions(dealt.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, schema)


def similar_sets(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], per_mille: int) -> DataFrame:
    """Pairs (a, b) that connect all sets whose similarity is ``per_mille`` / 1000 or more.

    sets: id, size, prefix (codes in the global order); whole: gives (id, codes) of all codes of the sets of some ids.
    """
    each = sets.select("id", "size", F.explode("prefix").alias("code"))
    # A set stays in the group of a code if one there has a size that allows the similarity; that is so if the next smaller or larger one has.
    by_size = Window.partitionBy("code").orderBy("size", "id")
    near = (1000 * F.lag("size").over(by_size) >= per_mille * F.col("size")) | (per_mille * F.lead("size").over(by_size) <= 1000 * F.col("size"))
    by = "PARTITION BY code"
    marks = {"n": f"count(*) OVER ({by})", "total": f"sum(CAST(size AS LONG)) OVER ({by})", "first": f"min(id) OVER ({by})", "last": f"max(id) OVER ({by})", "sign": f"bit_xor(xxhash64(id)) OVER ({by})"}
    met = materialise(each.withColumn("near", F.coalesce(near, F.lit(False))).where("near").drop("near").select("*", *(F.expr(v).alias(k) for k, v in marks.items())), "tries-met")
    # Of codes that the same sets have the first one makes the group.
    leading = met.where("id = first").groupBy("n", "total", "first", "last", "sign").agg(F.min("code").alias("code")).select("code")
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("total") / TOKENS)).cast("int")
    dealt = met.join(leading, "code", "left_semi").select("code", "id", "size", parts.alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    tiled = dealt.select("code", "id", "size", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = F.concat_ws("/", "code", F.least("own", "other"), F.greatest("own", "other"))
    lists = met.groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    tiles = materialise(tiled.select(key.alias("key"), "code", "id", "size"), "tries-tiles")
    left = materialise(_groups(tiles.join(lists, "id").select("key", "code", "id", "size", "codes"), per_mille, False, 20_000), "tries-left")
    return _groups(left.join(whole(left.select("id").distinct()), "id").select("key", "code", "id", F.size("codes").cast("long").alias("size"), "codes"), per_mille, True, 2_000)
