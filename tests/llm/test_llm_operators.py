"""Each operator against a brute-force version, and on awkward input."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sinktrace.llm import byte_bpe, chunks, decontaminate, pii, ppm, quality_model, quality_rules, repeats, simhash, token_counts, token_files
from sinktrace.storage import scratch, spread

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample_texts(n: int = 60, seed: int = 5) -> list[str]:
    """Texts of few different words, with repeats, copies, odd white space, and letters of several scripts."""
    r = random.Random(seed)
    words = ["the", "The", "of", "and", "été", "straße", "日本語", "x1", "a-b", "don't", "3.14", "🙂", "token,", "long" * 6, "\x1c", "İ"]
    passage = " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(50))
    out = ["", " ", "\n\n", "one", "  two  words \n", passage, passage]
    while len(out) < n:
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "\t", "\n\n", " \n "]) for _ in range(r.choice([3, 30, 200])))
        out.append(text + (passage if r.random() < 0.3 else "") + (text if r.random() < 0.2 else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = sample_texts()
    found = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    more = [(1000, None, None, None, None), (None, texts[8], "en", "s", 1), (1001, "long " * 40_000, "en", "s", 1), (1002, "an <|endoftext|> inside\n<|endoftext|>", "en", "s", 1)]
    return [*found, found[-1], *more]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same with columns that have the names of what operators make or use."""
    names = "k fp rest key score features matches spans __text component_id n_tokens n_words words digest held_out base_score __row more tail node kept rank removed codes".split()
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranks_and_pattern():
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, p.PATTERN, p.path


def by_id(found, *names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in found.collect()), key=str)


def test_byte_bpe_is_the_library_s(docs, rows, clashing, empty):
    import tiktoken

    ranks, pattern, path = ranks_and_pattern()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for table in (docs, clashing):
        found = byte_bpe.encode_decode(table, path("byte_bpe_50k.tiktoken"), pattern)
        assert by_id(found, "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    assert byte_bpe.encode_decode(empty, path("byte_bpe_50k.tiktoken"), pattern).count() == 0


def test_byte_bpe_model_reaches_each_entry():
    ranks, pattern, _ = ranks_and_pattern()
    bpe = byte_bpe.ByteBpe(ranks, pattern)
    shown = [t.decode("latin-1").translate(bpe.shown) for t in bpe.tokens]
    assert bpe.model.encode(shown, num_threads=1) == [[i] for i in range(len(shown))]


def test_token_files_hold_all_ids_in_order(spark, docs, rows, clashing, empty):
    from tokenizers import Tokenizer

    _, _, path = ranks_and_pattern()
    file = path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    expected, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for table in (docs, clashing, empty):
        manifest = token_files.write_token_files(table, scratch(spark, "files"), lambda: token_files.library_encoder(file, "<u2"))
        found = token_files.read_token_files(manifest, token_files.crc, "ids_crc32 long")
        assert by_id(found, "start", "n_tokens", "ids_crc32") == ([] if table is empty else sorted(expected, key=str))
    wide = token_files.write_token_files(docs, scratch(spark, "files"), lambda: token_files.library_encoder(file, "<u4"), "<u4", n_parts=2)
    assert by_id(token_files.read_token_files(wide, token_files.crc, "ids_crc32 long", "<u4"), "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)


def test_token_files_take_special_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    _, _, path = ranks_and_pattern()
    file = path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(file), token_files.library_encoder(file, "<u2")
    special = "<|endoftext|>"
    for text in [f"a{special}b", special, f"one  {special} two\n{special}\n\n three", f"a \n {special}{special}  b", f"x{special} ", f" {special[:5]} {special[5:]} é{special}日本"]:
        assert np.frombuffer(encode(text)[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_have_a_type_that_holds_all_ids(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert token_files.token_type(ranks_and_pattern()[2]("byte_bpe_50k.json")) == "<u2"
    many = Tokenizer(models.BPE({f"x{i}": i for i in range(70_000)}, []))
    many.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    many.save(f"{tmp_path}/many.json")
    assert token_files.token_type(f"{tmp_path}/many.json") == "<u4"
    with pytest.raises(ValueError, match="do not fit"):
        token_files.library_encoder(f"{tmp_path}/many.json", "<u2")


def test_chunks_are_cut_where_pretokens_end():
    import regex

    _, pattern, _ = ranks_and_pattern()
    findall = regex.compile(pattern).findall
    chunks.check_pattern(findall)
    with pytest.raises(ValueError, match="over the end"):
        chunks.check_pattern(regex.compile(r"\p{L}+|[^\p{L}]+[\r\n]*").findall)
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choice("ab1.é语🙂’«' \n\t\r\x1c\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff\u180e\u202f\u205f") for _ in range(r.randrange(20)))
        found = chunks.chunks(text)
        assert "".join(found) == text and [p for c in found for p in findall(c)] == findall(text), text


def test_chunk_cache_joins_what_is_made_whatever_it_forgets(rows):
    cache = chunks.ChunkCache(lambda keys: [(k.encode() * 2, k.encode()[:2] * 4) for k in keys], (1, 4), limit=40)
    texts = [t for _, t, *_ in rows] + ["a b " * 3, "x" * 9_000_000 + " y", "z é" * 3_000_000]
    for text, (double, _) in zip(texts, cache.many(texts), strict=True):
        assert bytes(double) == b"".join(c.encode() * 2 for c in chunks.chunks(text or "")), text


def plain_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            yield (kind, *m.span())


def test_pii_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(r.choice(["@.a-1 ", "+1 ().-9", "12.34.", "a@b.c-%+", "0 -1234567890", "é\n"])) for _ in range(r.randrange(40)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == list(plain_spans(text)), text


def test_pii_additions_and_redaction(spark, docs, clashing, empty, rows):
    text = 'Mail a.b@c.org, token = "0123456789abcdef0123", IBAN DE89 3704 0044 0532 0130 00, http://me:pw@host.org/x and 1.2.3.4'
    kinds = [k for k, _, _ in pii.find_spans(text)]
    assert [k for k in kinds if k not in ("email", "ip")] == ["secret", "account", "url"] and "ip" in kinds
    assert pii.redact(text, pii.find_spans(text)) == 'Mail <EMAIL>, token = "<SECRET>", IBAN <ACCOUNT>, <URL> and <IP>'
    assert pii.find_spans("a token of love, an account of war, http://example.org/a 12-34 IBAN DE00 3704 0044 0532 0130 00") == []
    for table in (docs, clashing):
        assert by_id(pii.annotate(table), "n_email") == sorted([(i, sum(k == "email" for k, *_ in plain_spans(t or ""))) for i, t, *_ in rows], key=str)
    assert pii.annotate(empty).count() == 0
    done = pii.redacted(spark.createDataFrame([(1, text, "en", "s", 5), (2, None, "en", "s", 0)], SCHEMA)).collect()
    assert "<EMAIL>" in done[0].text and done[0].n_chars == len(done[0].text) and done[1].text is None


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: dict, radius=3):
    label = {k: k for k in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if label[a] > label[b] and (values[a] ^ values[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def test_simhash_groups(spark, docs, clashing, empty, rows):
    ids = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    expected = plain_components(ids)
    for table in (docs, clashing):
        found = simhash.near_duplicates(table.where("doc_id is not null"))
        assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in found.collect()} == {(i, ids[i], expected[i]) for i in ids}
        assert found.count() == sum(r[0] is not None for r in rows)
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [20_000, 5])
def test_bk_tree_shards_lose_no_link(spark, limit):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(40)]
    values = {0, 2**64 - 1}
    for s in seeds:
        for _ in range(12):
            v = s
            for _ in range(r.randrange(6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    expected = plain_components({v: v % 2**64 for v in signed})
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {x.node: x.component for x in simhash.components(simhash.fingerprint_edges(frame, 3, limit)).collect()}
    assert {v: found.get(v, v) for v in signed} == expected


def test_components_of_a_long_path(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def plain_repeats(rows, window=20):
    texts = {}
    for i, t in rows:
        texts[i] = SPACE.findall(t or "")
    first = {}
    gone = defaultdict(set)
    for i in sorted(texts, key=lambda x: (x is not None, x)):
        for s in range(len(texts[i]) - window + 1):
            if first.setdefault(tuple(texts[i][s : s + window]), (i, s)) != (i, s):
                gone[i].update(range(s, s + window))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone[i]).encode()).hexdigest()) for i, w in texts.items()}


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats_are_removed(docs, clashing, empty, rows, limit):
    expected = plain_repeats([(i, t) for i, t, *_ in rows])
    found = repeats.remove_repeats(docs if limit > 2 else clashing, group_limit=limit)
    got = by_id(found, "n_words", "n_removed", "kept_sha256")
    assert got == sorted([(i, *expected[i]) for i, *_ in rows], key=str)
    assert sum(n for _, _, n, _ in got) > 500
    assert repeats.remove_repeats(empty).count() == 0


def test_deep_nodes_are_equal_windows():
    r = random.Random(2)
    words = [[bytes([r.choice(b"ab")]) for _ in range(40)] for _ in range(3)]
    suffixes = [(w, j) for w in words for j in range(35)]
    groups = defaultdict(list)
    for s, (w, j) in enumerate(suffixes):
        groups[tuple(w[j : j + 6])].append(s)
    expected = sorted(sorted(g) for k, g in groups.items() if len(g) > 1 and len(k) == 6)
    assert sorted(sorted(g) for g in repeats.deep_nodes(suffixes, 6)) == expected


def plain_ppm(training, order):
    counts = defaultdict(Counter)
    for t in training:
        s = [257] * order + list(t.encode().lower()) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1

    def score(text):
        s, total = [257] * order + list(text.encode().lower()) + [256], 0.0
        for i in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                seen = counts.get(tuple(s[i - k : i]))
                if not seen:
                    continue
                n, d = sum(c for x, c in seen.items() if x not in out), len(set(seen) - out)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / (n + d))
                    break
                total += math.log10(d / (n + d)) if d else 0
                out |= set(seen)
            else:
                total -= math.log10(max(1, 257 - len(counts.get((), ()))))
        return total

    return score


@pytest.mark.parametrize(("order", "max_entries"), [(3, 4_000_000), (2, 300)])
def test_ppm_scores(docs, clashing, empty, rows, order, max_entries):
    short = [r for r in rows if r[0] != 1001]
    learn = [r[1] or "" for r in short if r[0] is not None and r[0] % 3]
    score, counts = plain_ppm(learn, order), Counter()
    for t in learn:
        counts.update([*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    table = (docs if max_entries > 300 else clashing).where("doc_id is null or doc_id <> 1001")
    found = ppm.score(table, table.where("doc_id % 3 <> 0"), order, head=5, max_entries=max_entries)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()), key=str)
    expected = []
    for i, t, *_ in short:
        tokens = [*(t or "").encode().lower().split(), None]
        expected.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6), round(score(t or ""), 6)))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(expected, key=str)]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in sorted(expected, key=str)], atol=2e-6)
    if order == 2:
        assert ppm.score(empty, empty, order).count() == 0
        assert ppm.score(docs.where("doc_id = 5"), docs.where("doc_id < 0"), order).first().n_known == 0


def test_ppm_blocks_of_a_table_of_one_file_are_of_the_same_documents(spark, tmp_path):
    r = random.Random(9)
    texts = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(5, 120)))) for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table = spread(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    score = plain_ppm([t for _, t in texts], 2)
    found = {x.doc_id: x.score for x in ppm.score(table, table, 2, max_entries=60, head_keys=40).collect()}
    assert len(found) == 300 and all(math.isclose(found[i], score(t), abs_tol=1e-6) for i, t in texts)


def test_ppm_splits_endings_that_many_pairs_share(spark):
    """With few pairs to a block some endings are split twice; keys that are unseen at every depth fall back across blocks."""
    r = random.Random(4)
    texts = [(i, "".join(r.choice("abc") for _ in range(60))) for i in range(120)] + [(1000, "xyz"), (1001, "abxbac"), (1002, "")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    learn = table.where("doc_id < 100")
    contexts = ppm.context_counts(learn, 5)
    endings, sums = ppm.split_endings(contexts, 5, 20)
    assert len(endings) >= 2 and len(sums) == len(endings)
    score = plain_ppm([t for i, t in texts if i < 100], 5)
    for head_keys in (0, 50, 2_000_000):
        found = {x.doc_id: x.score for x in ppm.score(table, learn, 5, head=3, max_entries=160, head_keys=head_keys).collect()}
        assert len(found) == len(texts) and all(math.isclose(found[i], score(t), abs_tol=1e-6) for i, t in texts)


def test_ppm_is_a_distribution():
    text = b"abracadabra abracadabra"
    keys, n = np.unique(np.concatenate(list(ppm.keys_of(text, 3))), return_counts=True)
    shallow = ppm._tally(keys & np.uint64((1 << 18) - 1), n)
    trie = ppm.build(keys, n, *shallow, 3)
    for context in (b"abr", b"zzz", b"ra "):
        base = 0
        for c in context:
            base = base << 9 | c
        every = np.array([base << 9 | s for s in range(257)], np.uint64)
        assert math.isclose(float((10 ** ppm.log_probabilities(trie, every)).sum()), 1, rel_tol=1e-9)


def test_quality_model_learns_and_holds_out(spark, docs, clashing, empty):
    r = random.Random(3)
    texts = []
    for i in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 60))]
        good = i % 4 > 0
        texts.append((i, " ".join(words) + "." if good else (" | " if i % 8 else "### ").join(words), "en", "s", 1, int(good)))
    table = spark.createDataFrame(texts, SCHEMA + ", quality int")
    marked = quality_model.with_features(table.drop("quality"))
    model = quality_model.train(marked, quality_model.training_labels(table.select("doc_id", "quality")))
    got = {x.doc_id: x.score for x in quality_model.score(marked, model).collect()}
    held = [x for x in texts if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert len(held) > 60 and sum((got[x[0]] >= 0.3) == bool(x[5]) for x in held) / len(held) > 0.97
    assert set(quality_model.keep_good(table.drop("quality"), model, 0.3).toPandas().doc_id) == {i for i, s in got.items() if s >= 0.3}
    labels = spark.createDataFrame([(1, None, 0), (2, 7, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for t in (docs, clashing, empty):
        one_sided = quality_model.train(quality_model.with_features(t), quality_model.training_labels(labels))
        assert all(0 <= x.score <= 1 for x in quality_model.score(quality_model.with_features(t), one_sided).collect())


def test_quality_rules_base_counts(spark, docs, clashing, empty, rows):
    def plain(t):
        words, lines, seen, dup = SPACE.findall(t), t.split("\n"), set(), 0
        for x in lines:
            if SPACE.search(x):
                dup += x in seen
                seen.add(x)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)

    good = docs.withColumn("trusted", F.col("doc_id") % 2 == 0).select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    table = quality_rules.ratios(quality_rules.ngram_counts(good))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for t in (docs, clashing):
        assert by_id(quality_rules.judge(t, table), *names) == sorted([(i, *plain(x or "")) for i, x, *_ in rows], key=str)
    assert not [r for r in quality_rules.judge(docs, table).collect() if r.base_failed and r.kept]
    nothing = quality_rules.ratios(quality_rules.ngram_counts(empty.select("text", F.lit(True).alias("trusted"))))
    assert quality_rules.judge(empty, nothing).count() == 0 and not nothing.any()


def test_ngram_ratio_is_that_of_two_multinomials(spark):
    frame = spark.createDataFrame([("a b", True), ("a c", False), ("a b", False)], "text string, trusted boolean")
    table = quality_rules.ratios(quality_rules.ngram_counts(frame), alpha=0.5)
    codes = quality_rules.word_codes().codes([b"a", b"b"])
    a, b, ab = quality_rules.buckets(codes).tolist()
    size = 1 << quality_rules.BUCKET_BITS
    for bucket, raw, target in ((a, 3, 1), (b, 2, 1), (ab, 2, 1)):
        assert math.isclose(table[bucket], math.log((target + 0.5) / (3 + size / 2)) - math.log((raw + 0.5) / (9 + size / 2)))


def test_token_counts_are_best_segmentations(docs, clashing, empty, rows):
    _, _, path = ranks_and_pattern()
    pieces = token_counts.vocabulary(path("piece_bpe_32k.model"))
    low = min(pieces.values())

    def plain(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for stop in range(1, len(text) + 1):
            options = [(best[i][0] + pieces[text[i:stop]], best[i][1] - 1) for i in range(stop) if text[i:stop] in pieces]
            if text[stop - 1] not in pieces:
                n = len(text[stop - 1].encode())
                options.append((best[stop - 1][0] + n * low, best[stop - 1][1] - n))
            best.append(max(options))
        return best[-1]

    known = {}
    expected = []
    for i, t, *_ in rows:
        words = SPACE.findall(t or "")
        found = [known.setdefault(w, plain(w)) if w not in known else known[w] for w in words]
        expected.append((i, len(words), -sum(c for _, c in found)))
    for t in (docs, clashing):
        assert by_id(token_counts.count_tokens(t, path("piece_bpe_32k.model")), "n_pretokens", "n_tokens") == sorted(expected, key=str)
    assert token_counts.count_tokens(empty, path("piece_bpe_32k.model")).count() == 0
    assert min(pieces.values()) == list(pieces.values())[-1] and math.isclose(sum(map(math.exp, pieces.values())), 1)
    small = token_counts.TrieCounter(pieces, limit=3)  # begins anew again and again
    texts = [t or "" for _, t, *_ in rows[:30]]
    assert [n for _, n, _ in small.count(texts)] == [n for _, _, n in expected[:30]]


def test_a_unigram_model_has_its_own_scores(tmp_path):
    piece = lambda text, score: byte_bpe._field(1, byte_bpe._field(1, text.encode()) + byte_bpe._field(2, score))
    unknown = byte_bpe._field(1, byte_bpe._field(1, b"<unk>") + byte_bpe._field(2, 0.0) + byte_bpe._field(3, 2))
    pieces = {"▁a": -1.5, "b": -2.25, "▁": -4.0, "a": -3.0}
    body = unknown + b"".join(piece(t, s) for t, s in pieces.items())
    (tmp_path / "unigram.model").write_bytes(body + byte_bpe._field(2, byte_bpe._field(3, 1)))
    assert token_counts.vocabulary(f"{tmp_path}/unigram.model") == pieces
    (tmp_path / "bpe.model").write_bytes(body + byte_bpe._field(2, byte_bpe._field(3, 2)))
    assert list(token_counts.vocabulary(f"{tmp_path}/bpe.model").values()) == sorted(token_counts.vocabulary(f"{tmp_path}/bpe.model").values(), reverse=True)
    assert [n for _, n, _ in token_counts.TrieCounter(pieces).count(["ab a b"])] == [2 + 1 + 2]


def test_repeats_within_a_text_are_judged_by_words_even_if_codes_meet():
    words = [bytes([c]) for c in b"abcabcabdabc"]
    same = np.zeros(len(words), np.uint64)  # all words have one code
    assert repeats.repeated_within(words, same, 3).tolist() == [tuple(words[i : i + 3]) in {tuple(words[j : j + 3]) for j in range(i)} for i in range(10)]


def test_many_rows_without_an_id_are_no_hot_key(spark):
    r = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(40)) + (" " + shared if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0]), (7, texts[1]), (7, texts[2])], "doc_id long, text string")
    found = repeats.remove_repeats(docs).collect()
    assert len(found) == 303
    # Rows without an id are at one place: a window at an equal or later start in another of them is not earlier.
    first = min(t.split().index("s0") for t in texts if shared in t)
    assert sorted(x.n_removed for x in found if x.doc_id is None) == sorted([0 if shared not in t or t.split().index("s0") == first else 30 for t in [*texts, texts[0]]])
    assert [x.n_removed for x in found if x.doc_id == 7] == [40, 40]


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_finds_all_within_the_budget(spark, docs, clashing, empty):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randrange(12, 40)))) for i in range(12)] + [(50, "tiny"), (51, None), (52, "exactly this here")]
    texts, expected = [], set()
    for d in range(60):
        i, item = items[r.randrange(12)]
        edits = int(len(item) * decontaminate.EDIT_RATE)
        piece = list(item)
        for _ in range(r.randrange(edits + 3)):
            p, kind = r.randrange(len(piece)), r.random()
            piece[p : p + 1] = [] if kind < 0.3 else [r.choice("xyz")] if kind < 0.7 else [piece[p], "q"]
        text = " ".join(word() for _ in range(30)) + " " + "".join(piece).upper().replace(" ", r.choice([" ", "\n", "  "])) + " " + " ".join(word() for _ in range(30))
        texts.append((d, text))
        plain = " ".join(text.lower().split())
        expected |= {(d, 50, 0) for _ in [0] if re.search(r"\btiny\b", plain)}
        expected |= {(d, j, fewest_edits(t, plain)) for j, t in items[:12] if fewest_edits(t, plain) <= int(len(t) * decontaminate.EDIT_RATE)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (1_000_000, 700):
        found = decontaminate.with_matches(frame, bench, block_chars=block).select("doc_id", "text", F.explode("matches").alias("m")).collect()
        assert {(x.doc_id, x.m.item_id, x.m.distance) for x in found} == expected and len(expected) > 30
        for x in found:
            part = " ".join(x.text[x.m.start : x.m.end].lower().split())
            assert abs(len(part) - len(dict(items)[x.m.item_id])) <= x.m.distance + 2
    clean = decontaminate.without_matches(frame, bench, block_chars=700)
    assert {x.doc_id for x in clean.collect()} == set(range(60)) - {d for d, _, _ in expected}
    for t in (docs, clashing, empty):
        decontaminate.with_matches(t, bench).count()
    assert decontaminate.with_matches(frame, bench.where("item_id > 99")).where("size(matches) > 0").count() == 0
    tiny = spark.createDataFrame([(1, "A Tiny\nthing"), (2, "tinything, untiny"), (3, "so tiny. tiny"), (4, "no name")], "doc_id long, text string")
    short = spark.createDataFrame([(9, "tiny"), (None, "no  NAME"), (9, "tiny"), (8, "")], "item_id long, text string")
    got = {(x.doc_id, m.item_id, m.distance, m.start, m.end) for x in decontaminate.with_matches(tiny, short).collect() for m in x.matches}
    assert got == {(1, 9, 0, 2, 6), (3, 9, 0, 3, 7), (4, None, 0, 0, 7)}
    assert [m["distance"] for m in decontaminate.Index.of([(52, "exactly this here")]).matches("so Exactly  this\nhere it is")] == [0]


def test_a_passage_in_a_very_long_text_is_found_across_pieces():
    item = "a passage that lies right where two pieces of a very long text meet and goes on a little further"
    index = decontaminate.Index.of([(1, item)])
    for lead in (decontaminate._PIECE - 50, 2 * decontaminate._PIECE - 1):
        text = ("ab cd " * (lead // 6 + 1))[:lead] + " " + item
        assert [(m["start"], m["end"]) for m in index.matches(text)] == [(lead + 1 - text[lead - 1].isspace() * 0, lead + 1 + len(item))]


def test_quality_rules_trust_rows_by_their_place(spark, tmp_path):
    """Null, repeated and hot ids over several files, one of them without a trusted row."""
    rows = [(i % 7 if i % 3 else 5, f"t{i}") for i in range(400)] + [(None, "n")] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99, "x")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = spark.createDataFrame([(5,), (5,), (2,), (None,)], "doc_id long")
    flags = quality_rules.trusted_rows(docs, good)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flags(batch))], ["doc_id", "flag"])

    for frame in (quality_rules.placed(docs, "doc_id"), spread(quality_rules.placed(docs, "doc_id"))):
        found = frame.mapInArrow(run, "doc_id long, flag boolean").collect()
        assert len(found) == 451 and all(r.flag == (r.doc_id in (5, 2)) for r in found)
    nobody = quality_rules.trusted_rows(docs, good.where("doc_id = 77"))
    assert quality_rules.ngram_counts(quality_rules.placed(docs, "text"), nobody).agg({"n_target": "sum"}).first()[0] == 0
