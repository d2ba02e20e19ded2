"""One document of each group of near copies: SimHash candidates, confirmed by the exact similarity of their shingle sets.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least ``PER_MILLE`` /
1000. Documents of one set are one class. 128-bit SimHash fingerprints of the classes are dealt to BK-trees
(``simhash.wide_edges``), whose components are groups of candidates; only documents in such a group are looked at
again. Within a group links are found by an exact join, by prefix trees (``prefix_trie``): pairs that are not alike
are ruled out in the tasks that search the trees, and no rows are made for them.

Defined cases: a text of fewer words than a shingle has one shingle, all its words; texts without words are alike;
null is an empty text. Of a group the row of smallest doc_id stays, null ids coming last; of equal ids that whose
text has the smallest MD5 value; of equal rows one. Rows are judged one by one: rows of one doc_id with unlike texts
are unlike documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.llm.columns import fresh, texts_of
from sinktrace.llm.prefix_trie import frequent_codes, ordered, prefix_length, similar_sets
from sinktrace.llm.simhash import components, wide_edges, wide_fingerprint
from sinktrace.llm.words import mixed, window_codes, word_codes
from sinktrace.storage import materialise

WORDS, PER_MILLE = 5, 800
_TOP = np.int64(31 << 57)  # the bits of a code that order it
_LAST = 2**63 - 1  # stands for a null doc_id


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit codes of a text's word shingles, ascending."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    codes = np.sort(window_codes(word_codes().codes(tokens), min(words, len(tokens))))
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """For rows (k, t, text): k, t, digest of the shingle set, low and high words of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, low, high = [], [], []
            for text in texts_of(batch.column("text")):
                codes = shingles(text, words)
                digests.append(xxhash.xxh3_128_digest(codes.tobytes()))
                a, b = wide_fingerprint(codes)
                low.append(a)
                high.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), pa.array(digests, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["k", "t", "digest", "low", "high"])

    return rows.mapInArrow(run, "k long, t string, digest binary, low long, high long")


def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    """For rows (id, candidates, text): id, candidates, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("candidates"), pa.array(sets, pa.list_(pa.int64()))], ["id", "candidates", "codes"])

    return rows.select("id", "candidates", "text").mapInArrow(run, "id long, candidates long, codes array<bigint>")


def confirmed(sets: DataFrame, per_mille: int = PER_MILLE) -> DataFrame:
    """Rows (node, component) of the links between sets (id, candidates, codes) that have the same ``candidates``: the smallest id reached."""
    known, bucket = frequent_codes(sets.where("pmod(xxhash64(id), 64) = 0"))
    order = sets.sparkSession.sparkContext.broadcast((known, bucket))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The group of candidates is part of a code, so that sets of other groups share none.
            groups = mixed(batch.column("candidates").to_numpy().view(np.uint64), 13)
            codes = [ordered(np.sort(c.values.to_numpy().view(np.uint64)), *order.value) for c in batch.column("codes")]
            own = [np.sort((c & _TOP) | ((c.view(np.uint64) ^ g) & ~_TOP.view(np.uint64)).view(np.int64)) for c, g in zip(codes, groups, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, own)), pa.int64()), pa.array([c[: prefix_length(len(c), per_mille)] for c in own], pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["id", "size", "prefix", "codes"])

    all_ = materialise(sets.where(F.size("codes") > 0).mapInArrow(put, "id long, size long, prefix array<bigint>, codes array<bigint>"), "similar-ordered")
    return components(similar_sets(all_.select("id", "size", "prefix"), lambda ids: all_.join(ids, "id", "left_semi").select("id", "codes"), per_mille))


def without_near_copies(docs: DataFrame, words: int = WORDS, per_mille: int = PER_MILLE) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group."""
    k, t, kind = (fresh(x, docs.columns) for x in ("k", "t", "kind"))
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(t, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = keyed.select(F.col(k).alias("k"), F.col(t).alias("t"), F.col("text").cast("string").alias("text"))
    marked = materialise(_fingerprints(rows, words), "similar-fingerprints")
    classes = materialise(marked.groupBy("digest", "low", "high").agg(F.min(F.struct("k", "t")).alias("first")), "similar-classes")
    groups = components(wide_edges(materialise(classes.select("low", "high").distinct(), "similar-distinct"), per_mille / 1000))
    named = groups.select(F.col("node").alias("low"), F.col("component").alias("candidates"))
    # A component's least member is no node of its own, and classes that share a low word have no edge.
    least = named.select(F.col("candidates").alias("low"), "candidates").distinct()
    shared = classes.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", F.col("low").alias("candidates"))
    named = named.unionByName(least).unionByName(shared).groupBy("low").agg(F.min("candidates").alias("candidates"))
    grouped = classes.join(named, "low")
    members = materialise(grouped.select("digest", "first", "candidates").withColumn("id", F.monotonically_increasing_id()), "similar-members")
    # The joins with the texts deal both sides out at any size: what they are joined with grows with the corpus.
    texts = rows.join(members.select(F.col("first.k").alias("k"), F.col("first.t").alias("t"), "id", "candidates").hint("merge"), ["k", "t"])
    sets = materialise(_with_sets(texts, words).dropDuplicates(["id"]), "similar-sets")
    found = members.join(confirmed(sets, per_mille).withColumnRenamed("node", "id"), "id", "left").select("digest", "first", F.coalesce("component", "id").alias("component"))
    low = found.groupBy("component").agg(F.min("first").alias("stays"))
    stays = found.join(low, "component").select("digest", "stays")
    kept = classes.select("digest", "first").join(stays, "digest", "left").select("digest", F.coalesce("stays", "first").alias("stays"))
    # A row of another place than the one that stays goes; of rows at the place that stays, one stays.
    places = marked.groupBy("digest", "k", "t").agg(F.count(F.lit(1)).alias("n")).join(kept, "digest")
    stay = (F.col("k") == F.col("stays.k")) & (F.col("t") == F.col("stays.t"))
    told = materialise(places.where(~stay | (F.col("n") > 1)).select(F.col("k").alias(k), F.col("t").alias(t), stay.alias(kind)), "similar-told")
    met = keyed.join(told.hint("merge"), [k, t], "left")
    rank = fresh("rank", met.columns)
    several = met.where(F.col(kind)).withColumn(rank, F.row_number().over(Window.partitionBy(k, t).orderBy("text"))).where(F.col(rank) == 1)
    return met.where(F.col(kind).isNull()).select(*docs.columns).unionByName(several.select(*docs.columns))
