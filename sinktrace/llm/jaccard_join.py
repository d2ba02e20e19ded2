"""N-gram Jaccard join: documents whose sets of word shingles are alike, by prefix trees (``prefix_trie``).

Documents of one set are one class; classes are joined, and components follow from the links by star rounds.

Defined cases: a text of fewer words than a shingle has one shingle, all its words; a text without words, or null, has an
empty set and is linked with nothing; a null doc_id is carried, and a component of null ids alone has a null id; rows of
one doc_id are documents of their own, and each has a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.columns import texts_of, without
from sinktrace.llm.prefix_trie import frequent_codes, ordered, prefix_length, similar_sets
from sinktrace.llm.similar import shingles
from sinktrace.llm.simhash import components
from sinktrace.storage import materialise, spread

BITS = 1 << 23
_LAST = 2**63 - 1  # stands for a null doc_id


def _codes(rows: DataFrame, words: int) -> DataFrame:
    """The shingles of rows (id, text): id, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "codes"])

    return rows.select("id", "text").mapInArrow(run, "id long, codes array<bigint>")


def marked_in(keys: DataFrame):
    """A filter by a bitmap of ``BITS`` bits over the hashes of the rows: it passes all of them, and of others those whose bit is set.

    The bitmap is summed up by words, so the driver gets BITS / 64 numbers at most, however many rows there are.
    """
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(BITS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(code: pd.Series) -> pd.Series:
        p = np.mod(code.to_numpy(), BITS)
        return pd.Series((held.value[p >> 6] >> (p & 63)) & 1 == 1)

    return passes


def jaccard_components(docs: DataFrame, words: int = 4, per_mille: int = 850, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs, then n_shingles and component_id: the smallest doc_id that a document reaches by links, its own included."""
    keep = without(keep, "n_shingles", "component_id", "__id", "__hash", "__text", "__digest", "__prefix")
    named = docs.select(*keep, F.col("doc_id").cast("long").alias("__id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__hash"), F.col("text").cast("string").alias("__text"))
    some = named.where("pmod(xxhash64(__id, __hash), 64) = 0").select(F.lit(0).cast("long").alias("id"), F.col("__text").alias("text"))
    known, bucket = frequent_codes(_codes(some, words))
    order = docs.sparkSession.sparkContext.broadcast((known, bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, sizes, prefixes = [], [], []
            for text in texts_of(batch.column("__text")):
                codes = shingles(text, words)
                digests.append(xxhash.xxh3_128_digest(codes.tobytes()))
                sizes.append(len(codes))
                prefixes.append(ordered(codes, *order.value)[: prefix_length(len(codes), per_mille)])
            made = {"__id": batch.column("__id"), "__hash": batch.column("__hash"), "__digest": pa.array(digests, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()), "__prefix": pa.array(prefixes, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made.values()], [*keep, *made])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    marked = materialise(named.mapInArrow(run, held + "__id long, __hash string, __digest binary, n_shingles long, __prefix array<bigint>"), "jaccard")
    # A null id comes last, so a class has its smallest id.
    firsts = marked.where("n_shingles > 0").groupBy("__digest").agg(F.min_by(F.struct("__id", "__hash", "n_shingles", "__prefix"), F.struct(F.col("__id").isNull(), "__id", "__hash")).alias("x"))
    classes = materialise(firsts.select("__digest", F.col("x.__id").alias("first_id"), F.col("x.__hash").alias("hash"), F.col("x.n_shingles").alias("size"), F.col("x.__prefix").alias("prefix"), F.monotonically_increasing_id().alias("id")), "jaccard-classes")

    def whole(ids: DataFrame) -> DataFrame:
        """All codes, in order, of the sets of these ids."""
        places = materialise(classes.join(ids, "id").select("id", F.coalesce("first_id", F.lit(_LAST)).alias("k"), "hash"), "jaccard-places")
        keyed = named.select(F.coalesce("__id", F.lit(_LAST)).alias("k"), F.col("__hash").alias("hash"), F.col("__text").alias("text"))
        # Most texts are not asked for: a bitmap of fixed size keeps them out of the join.
        some = keyed.where(marked_in(places.select("k", "hash"))(F.xxhash64("k", "hash")))
        texts = some.join(places, ["k", "hash"]).groupBy("k", "hash", "id").agg(F.first("text").alias("text")).select("id", "text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [ordered(shingles(t, words), *order.value) for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "codes"])

        return texts.mapInArrow(sets, "id long, codes array<bigint>")

    found = components(similar_sets(classes.select("id", "size", "prefix"), whole, per_mille))
    placed = classes.join(found, classes["id"] == found["node"], "left").select("__digest", "first_id", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = materialise(placed.join(least, "component").select("__digest", "component_id"), "jaccard-components")
    # Every document of an empty set is alone; those rows need no join.
    alone = marked.where("n_shingles = 0").select(*keep, "n_shingles", F.col("__id").alias("component_id"))
    return marked.where("n_shingles > 0").join(of, "__digest").select(*keep, "n_shingles", "component_id").unionByName(alone)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a similarity of 0.85 or more."""
    return jaccard_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT k, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT k, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT k, k AS other FROM d UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN d USING (k) JOIN d o ON o.k = r.other LEFT JOIN n USING (k) GROUP BY d.k, d.doc_id
"""
