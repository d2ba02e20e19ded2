"""The registered queries themselves, on a small folder of tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import SCHEMA, SPACE, plain_components, plain_fingerprint, plain_ppm, plain_repeats, plain_spans, ranks_and_pattern, sample_texts

from sinktrace.llm import quality_model, quality_rules
from sinktrace.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows():
    texts = [*sample_texts(40, 15), "an <|endoftext|> inside", "mail a@b.org or +49 (170) 123-4567, 4111 1111 1111 1111, 1.2.3.4"]
    r = random.Random(16)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    texts += [" ".join(word() for _ in range(40)) for _ in range(60)] + [" | ".join(word() for _ in range(30)) for _ in range(40)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < 102), 0) for i in range(42, 142)] + [(42, 0, 0), (43, None, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    item = " ".join(rows[60][1].split()[5:30])
    spark.createDataFrame([(1, item), (None, item), (2, None), (3, "no such thing anywhere")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def found(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_op1_finds_the_passages(spark, folder, rows):
    got = {(r.doc_id, r.item_id, r.distance) for r in QUERIES["op1_decontaminate"](spark, folder).collect()}
    assert got == {(60, 1, 0), (60, None, 0)}


def test_op2_scores_and_holds_out(spark, folder, rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    learn = [t or "" for i, t, *_ in rows if not held[i]]
    counts = Counter(w for t in learn for w in [*t.encode().lower().split(), None])
    n, v, score = sum(counts.values()), len(counts), plain_ppm(learn, 5)
    got = found(spark, folder, "op2_ppm")
    assert {i: r.held_out for i, r in got.items()} == held and any(held.values())
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-6)
        assert math.isclose(got[i].score, score(t or ""), abs_tol=1e-5)


def test_op3_removes_what_repeats(spark, folder, rows):
    expected = plain_repeats([(i, t) for i, t, *_ in rows])
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found(spark, folder, "op3_repeats").items()} == expected


def test_op4_scores_every_row_by_its_tables(spark, folder, rows):
    got = found(spark, folder, "op4_quality_model")
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    # The same model, fitted and scored one bin at a time
    labels = [(i, int(i < 102)) for i in range(42, 142)] + [(42, 0)]
    texts = {i: t for i, t, *_ in rows}
    sample = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_model.train(quality_model.with_features(spark.createDataFrame(rows, SCHEMA)), quality_model.training_labels(sample))
    for i, t in texts.items():
        x = [float(v) for v in quality_model.features(t)]
        bins = [sum(c <= v for c in cuts.tolist()) for v, cuts in zip(x, model.cuts, strict=True)]
        if not np.array_equal(bins, model.bins(np.array([x]))[0]):
            bins = [sum(c < v for c in cuts.tolist()) for v, cuts in zip(x, model.cuts, strict=True)]
        total = model.base + sum(table[b] for table, b in zip(model.single, bins, strict=True)) + sum(table[bins[a], bins[b]] for a, b, table in model.pairs)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-total)), abs_tol=1e-9), i


def test_op5_finds_the_base_spans(spark, folder, rows):
    got = found(spark, folder, "op5_pii")
    kinds = ("email", "ip", "card", "phone")
    for i, t, *_ in rows:
        spans = list(plain_spans(t or ""))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, *_ in spans) for x in kinds)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(got[i].spans.split(","))


def test_op6_judges_by_the_ratio_of_every_n_gram(spark, folder, rows):
    size, alpha = 1 << quality_rules.BUCKET_BITS, 0.5
    trusted = set(range(42, 102))
    codes = {w: int(c) for w, c in zip(*(lambda ws: (ws, quality_rules.word_codes().codes(ws)))(sorted({w.encode() for _, t, *_ in rows for w in SPACE.findall(t or "")})), strict=True)}

    def grams(t):
        ws = [w.encode() for w in SPACE.findall(t or "")]
        one = [int(quality_rules.buckets(np.array([codes[w]], np.uint64))[0]) for w in ws]
        return one + [int(quality_rules.buckets(np.array([codes[a], codes[b]], np.uint64))[2]) for a, b in zip(ws, ws[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    ratio = lambda g: math.log((target[g] + alpha) / (sum(target.values()) + alpha * size)) - math.log((raw[g] + alpha) / (sum(raw.values()) + alpha * size))
    got = found(spark, folder, "op6_quality_rules")
    for i, t, *_ in rows:
        g = grams(t)
        llr = sum(map(ratio, g)) / len(g) if g else 0.0
        assert math.isclose(got[i].llr, llr, abs_tol=1e-9) and got[i].kept == (not got[i].base_failed and llr >= quality_rules.MIN_LLR)


def test_op8_and_op10_have_the_libraries_ids(spark, folder, rows):
    import tiktoken
    from tokenizers import Tokenizer

    ranks, pattern, path = ranks_and_pattern()
    files, bpe = Tokenizer.from_file(path("byte_bpe_50k.json")), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    eight, ten, start = found(spark, folder, "op8_token_files"), found(spark, folder, "op10_byte_bpe"), 0
    for i, t, *_ in rows:
        ids = [*files.encode(t or "", add_special_tokens=False).ids, 0]
        assert (eight[i].start, eight[i].n_tokens, eight[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        plain = bpe.encode_ordinary(t or "")
        assert (ten[i].n_tokens, ten[i].ids_sha256, ten[i].decoded_sha256) == (len(plain), hashlib.sha256(" ".join(map(str, plain)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op9_has_the_groups_of_all_links(spark, folder, rows):
    ids = {i: plain_fingerprint(t) for i, t, *_ in rows}
    expected = plain_components(ids)
    assert {i: (r.fingerprint, r.component_id) for i, r in found(spark, folder, "op9_simhash").items()} == {i: (f"{ids[i]:016x}", expected[i]) for i in ids}


def test_op7_counts_every_word(spark, folder, rows):
    got = found(spark, folder, "op7_token_counts")
    assert {i: r.n_pretokens for i, r in got.items()} == {i: len(SPACE.findall(t or "")) for i, t, *_ in rows}
