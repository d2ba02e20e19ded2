"""The pipeline, stage by stage against plain versions, and on awkward input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sinktrace.llm import pii, quality_model, similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    item = prose(30)
    texts = [prose(80) for _ in range(200)]
    texts += [" | ".join(word() for _ in range(60)) for _ in range(60)]  # junk
    texts += [texts[3], texts[3] + " ", texts[4]]  # copies
    texts += [prose(40) + " " + item + " " + prose(40)]  # a benchmark passage
    texts += [prose(50) + " write to x.y@example.org or +1 (555) 555-1234"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "", "en", "s", 0), (None, prose(60), "en", "s", 0)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    junk = set(range(200, 260))
    assert not junk & set(kept["quality"]) and set(range(200)) <= set(kept["quality"])
    gone = set(kept["quality"]) - set(kept["near_dedup"])
    assert {260, 261, 262} <= gone and not gone & set(range(200)) and None in kept["near_dedup"]
    assert len({900, 901, 902} & set(kept["near_dedup"])) <= 1
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {263}
    for i, row in kept["personal_data"].items():
        plain = before[i] if before[i] is None else pii.redact(before[i], pii.find_spans(before[i]))
        assert row.text == plain
    assert kept["personal_data"][264].text.endswith("write to <EMAIL> or <PHONE>") and kept["personal_data"][264].n_chars == len(kept["personal_data"][264].text)
    assert set(kept["byte_bpe"]) == set(kept["personal_data"])
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()} == {(r.doc_id, r.ids_sha256) for r in kept["byte_bpe"].values()}


def test_near_copies_are_those_of_the_similarity(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    line = [word() for _ in range(40)]  # in many documents
    texts = [[], ["one"], ["one", "two"], ["one", "two"]]
    for i in range(40):
        words = [word() for _ in range(r.randrange(30, 200))] + (line if i % 2 else [])
        texts.append(words)
        for _ in range(r.randrange(4)):
            words = list(words)
            for _ in range(r.randrange(1, 6)):
                words[r.randrange(len(words))] = word()
            texts.append(words)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    label = list(range(len(texts)))
    links = [(a, b) for b in label for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(label) and 20 < len(texts) - len(kept)


def test_near_copies_are_judged_by_row_and_not_by_id(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    one, other, third = ([word() for _ in range(60)] for _ in range(3))
    near = [*one[:-1], "changed"]
    rows = [(1, " ".join(one)), (5, " ".join(near)), (5, " ".join(other)), (7, " ".join(third)), (7, " ".join(third)), (None, " ".join(one)), (None, "alone here"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, " ".join(one)), (5, " ".join(other)), (7, " ".join(third)), (None, "alone here"), (8, None)], key=str)


def test_hot_shards_find_the_same_groups(spark):
    """A large group of near copies, dealt by leaders, and others beside it."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(400):
        words = list(base)
        words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(100)) for _ in range(200)]
    rows = spark.createDataFrame([(i, simhash.wide_fingerprint(similar.shingles(t))) for i, t in enumerate(texts)], "i long, x struct<low: long, high: long>").select("i", "x.low", "x.high")
    low = {x.i: x.low for x in rows.collect()}
    for hot in (16, 2_000):
        found = {x.node: x.component for x in simhash.components(simhash.wide_edges(rows.select("low", "high").distinct(), hot=hot)).collect()}
        assert len({found.get(low[i], low[i]) for i in range(401)}) == 1
        assert len({found.get(low[i], low[i]) for i in range(401, 601)}) == 200


def test_quality_stage_is_the_model_on_every_row(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    marked = quality_model.with_features(docs)
    model = quality_model.train(marked, quality_model.training_labels(labels))
    plain = {r.doc_id for r in quality_model.score(marked, model).where(F.col("score") >= 0.3).collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()} == plain


def test_empty_tables_and_clashing_columns_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for table in (docs.limit(0), docs.withColumns({n: F.lit(1) for n in ("rank", "matches", "fp", "score", "spans", "features", "k", "component_id")})):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns
            table = out.cache()
        corpus_pipeline.STAGES[-1][1](spark, table, folder).count()
