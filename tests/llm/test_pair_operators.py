"""Hard negatives, the Jaccard join and the alignment of tokenizers, against plain versions."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sinktrace.llm import alignment, hard_negatives, jaccard_join, prefix_trie, similar, simhash

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, every=100):
    """rows: (vec_id, embedding, label)."""
    used = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, (i, label, q) in enumerate(used):
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, w)), j, other == label, k == n) for n, (j, other, w) in enumerate(used)]
        positives = sorted((s, j) for s, j, same, self_ in scores if same and not self_)[:5]
        for s, j in positives:
            found = sorted((t, n) for t, n, same, _ in scores if not same and -80 * s <= -100 * t <= -100 * s)[:5]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(found, 1)]
    return sorted(out)


def negatives(spark, rows, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), **more).collect()))


def test_negatives_are_those_of_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    r = random.Random(3)
    vector = lambda: [r.uniform(-1, 1) for _ in range(8)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else [x + r.uniform(-0.1, 0.1) for x in hot] if i % 3 == 1 else vector(), r.choice([1, 1, 2, 3])) for i in range(400)]
    rows += [(100, vector(), 1), (100, hot, 1), (None, hot, 1), (401, None, 1), (402, hot, None), (403, [1.0, None], 1), (404, [math.nan] * 8, 1), (405, [math.inf] * 8, 2), (500, [0.5], 1), (600, [], 2)]
    assert negatives(spark, rows, every=50) == plain_negatives(rows, 50)


def test_negatives_of_very_large_numbers_need_no_doubles(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1e5, 1e5) for _ in range(4)], i % 3) for i in range(0, 300)]
    assert negatives(spark, rows, every=20) == plain_negatives(rows, 20)


def test_no_vectors_have_no_negatives(spark):
    assert negatives(spark, []) == [] and negatives(spark, [(100, None, 1)]) == [] and negatives(spark, [(100, [1.0], 1)]) == []


def test_the_hilbert_curve_passes_each_cell_once_and_goes_to_a_neighbour():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hard_negatives.hilbert_keys(cells, 2)
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert len(set(keys)) == 64 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_zone_bounds_hold_every_product():
    r = np.random.default_rng(1)
    shape = hard_negatives.Shape(6, 300)
    x, y = r.integers(-300, 300, (20, 6)), r.integers(-300, 300, (50, 6))
    low, high = shape.bounds(x, y.min(0)[None], y.max(0)[None])
    scores = shape.products(x, y)
    assert (low[:, 0] <= scores.min(1)).all() and (high[:, 0] >= scores.max(1)).all()


def plain_components(sets, per_mille):
    """The smallest index that each set reaches; empty sets are alone."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 1000 * len(x & y) >= per_mille * len(x | y):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def plain_shingles(text, words):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def joined(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    return sorted(map(tuple, jaccard_join.jaccard_components(docs, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.random()
        out[k : k + 1] = [] if kind < 0.3 and len(out) > 1 else [str(r.randrange(10**6))] if kind < 0.7 else [out[k], str(r.randrange(50))]
    return out


@pytest.mark.parametrize("group", [3, 1_000])
def test_the_join_finds_the_components_of_all_links(spark, monkeypatch, group):
    monkeypatch.setattr(prefix_trie, "GROUP", group)  # tiles of a few sets as well
    r = random.Random(group)
    passage = [str(r.randrange(10**6)) for _ in range(30)]
    texts = [None, "", "  ", "One", "one", "ONE two", "one two three four", "one\ttwo three\nFOUR"]
    for _ in range(12):
        base = [str(r.randrange(10**6)) for _ in range(r.randrange(5, 90))] + passage * r.randrange(3)
        texts += [" ".join(edited(r, base, r.randrange(4))) for _ in range(r.randrange(1, 14))]
    rows = [(None if i % 37 == 5 else i // 2, t, "x") for i, t in enumerate(texts)]
    label = plain_components([plain_shingles(t, 4) for t in texts], 850)
    ids = {c: min((d for (d, _, _), k in zip(rows, label) if k == c and d is not None), default=None) for c in label}
    want = sorted(((d, len(plain_shingles(t, 4)), ids[c]) for (d, t, _), c in zip(rows, label)), key=str)
    assert joined(spark, rows) == want


def test_an_empty_table_has_no_components(spark):
    assert joined(spark, []) == [] and joined(spark, [(4, None, "x"), (None, "", "y")]) == sorted([(4, 0, 4), (None, 0, None)], key=str)


def test_tries_give_what_all_pairs_give(monkeypatch):
    r = np.random.default_rng(5)
    for trial in range(25):
        monkeypatch.setattr(prefix_trie, "SEGMENT", int(r.choice([1, 3, 32])))
        vocabulary = int(r.choice([60, 2000]))
        sets = []
        for _ in range(r.integers(1, 5)):
            base = r.choice(vocabulary, r.integers(2, 60), replace=False)
            sets += [set(base[r.random(len(base)) > 0.06].tolist()) | set(r.integers(0, vocabulary, 2).tolist()) | {-1} for _ in range(r.integers(1, 40))]
        lists = [np.array(sorted(s), np.int64) for s in {tuple(sorted(s)) for s in sets}]
        size = np.array(list(map(len, lists)))
        a, b = prefix_trie.Tries(np.zeros(len(lists), np.int64), size, size * 0, np.concatenate(lists), np.concatenate([[0], np.cumsum(size)]), np.array([-1]), 800).search(True)
        found = simhash.forest(len(lists), [(a, b)]).tolist()
        assert found == plain_components([set(x.tolist()) for x in lists], 800), trial


def test_pairs_in_crowded_shards_are_found(spark):
    """Pairs at a similarity just over 0.8 that share half of their words with all others: nine of ten meet, shards being hot or not."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(7))
    shared = [word() for _ in range(150)]
    pairs = []
    for _ in range(300):
        x = shared + [word() for _ in range(150)]
        y = list(x)
        for k in r.sample(range(150, 300), 6):
            y[k] = word()
        pairs.append((" ".join(x), " ".join(y)))
    alike = [len(plain_shingles(x, 5) & plain_shingles(y, 5)) / len(plain_shingles(x, 5) | plain_shingles(y, 5)) for x, y in pairs]
    assert min(alike) >= 0.8
    rows = [(2 * k + n, *simhash.wide_fingerprint(similar.shingles(t))) for k, p in enumerate(pairs) for n, t in enumerate(p)]
    low = {i: a for i, a, _ in rows}
    frame = spark.createDataFrame([(a, b) for _, a, b in rows], "low long, high long").distinct()
    for hot in (16, 2_000):
        of = {x.node: x.component for x in simhash.components(simhash.wide_edges(frame, hot=hot)).collect()}
        met = sum(of.get(low[2 * k], low[2 * k]) == of.get(low[2 * k + 1], low[2 * k + 1]) for k in range(len(pairs)))
        assert met >= 0.9 * len(pairs), (hot, met)


def plain_alignment(rows, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(a_path)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=b_path)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    docs, counts, pairs = [], Counter(), {}
    for i, text in rows:
        docs.append((i, None))
        if not text:
            continue
        raw, a, b = (" " + text).encode(), first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        parts = [[bytes(byte[c] for c in first.id_to_token(x)) for x in a], [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, second.id_to_piece(x)) for x in b)]]
        if any(b"".join(p) != raw for p in parts):
            continue
        ends = [np.cumsum(list(map(len, p))).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for which, (ids, e) in enumerate(zip((a, b), ends)):
            for x, end in zip(ids, e):
                groups[bisect.bisect_left(cuts, end)][which].append(str(x))
        links = [(x, y) for x, end_a, p in zip(a, ends[0], parts[0]) for y, end_b, s in zip(b, ends[1], parts[1]) if end_a - len(p) < end_b and end_b - len(s) < end_a]
        docs[-1] = (i, (len(a), len(b), len(cuts), links, hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups).encode()).hexdigest()))
        counts.update(links)
        for p in set(links):
            pairs[p] = pairs.get(p, 0) + 1
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    told = [(i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, *d[:3], len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for i, d in docs]
    return told, sorted((x, y, pairs[x, y], n, n == top[y]) for (x, y), n in counts.items())


def test_alignment_is_that_of_whole_texts(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(alignment, "BLOCK", 4)  # several blocks; places go up to a block's size
    paths = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    odd = [None, "", " ", "\nab", " two  sp ", "a▁b", "ﬁ Å Ω　x\tq\r\n", "<s> <unk></s><|endoftext|> x", "\x00a", "á 한 ​ ﻿ x", "x\n\n  y\n z  ", "it's 'tis", "the the the the the", "🙂🙂 é"]
    r = random.Random(7)
    texts = odd + ["".join(r.choice(["the ", "cat", "Straße ", "über", "\n", " ", "12", "…", "naïve", ". "]) for _ in range(r.randrange(300))) for _ in range(60)] + odd
    rows = [(None if i % 9 == 4 else i % 50, t) for i, t in enumerate(texts)]
    docs, pairs = alignment.aligned(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, block int"), *paths)
    told, counted = plain_alignment(rows, *paths)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(told, key=str)
    assert sorted(map(tuple, pairs.collect())) == counted
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *paths)[0].collect() == []


def test_planes_hold_multiplicities():
    batch = alignment._rows(np.array([5, 5, 7], np.uint64), np.array([0, 70, 3]), np.array([1, 6, 1]), 9)
    rows = sorted((x["b"], x["weight"], x["present"], x["at"], x["words"]) for x in batch.to_pylist())
    assert rows == [(5, 0, True, [0, 1], [1, 64]), (5, 1, False, [0], [1]), (5, 2, False, [1], [64]), (5, 4, False, [1], [64]), (7, 1, True, [0], [8])]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_jaccard_join"])
def test_queries_give_what_their_sql_gives(spark, name):
    from sinktrace.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    for table in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = QUERIES[name](spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_no_link_of_a_crowded_shard_is_lost(spark):
    """Fingerprints of which most hang on one other by a link at the bound: crowded shards, with near rows and far ones, give the components of whole shards."""
    r = random.Random(21)
    flip = lambda x, n: x ^ sum(1 << k for k in r.sample(range(128), n))
    some = [r.getrandbits(128)]
    some += [flip(some[0], r.choice([4, 12, 24])) for _ in range(60)]
    some += [flip(r.choice(some), 27) for _ in range(400)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x & (2**64 - 1)), signed(x >> 64)) for x in some], "low long, high long")
    of = [{x.node: x.component for x in simhash.components(simhash.wide_edges(frame, hot=hot)).collect()} for hot in (16, 1 << 30)]
    assert len(of[1]) > 200 and of[0] == of[1]


def test_tiles_hold_every_pair_that_a_leader_does_not_link(spark):
    r = random.Random(22)
    rows = [(7, k, k, r.choice([3, 9, 13, 16, 22, 40])) for k in range(500)] + [(8, k, k, 5) for k in range(90)]
    met = {}
    for t in simhash.tiles(spark.createDataFrame(rows, "key long, low long, high long, apart int"), 14, 20).collect():
        met.setdefault(t.key, {})[t.low] = t.far
    assert max(map(len, met.values())) < 100  # two blocks to a tile
    inside = {(x, y) for tile in met.values() for x in tile if tile[x] for y in tile}
    apart = {k: d for key, k, _, d in rows if key == 7}
    reach = {(x, y) for x in apart for y in apart if apart[x] > 14 and apart[y] >= apart[x] - 14}
    assert reach <= inside
