"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the
next one. All but the last return the columns of documents.

Defined cases: an empty table passes through as an empty table; a null text counts as empty until the
personal-data stage, which leaves it null; documents without a doc_id are compared like others, and stay if no
near copy has one; rows are judged one by one, whatever their doc_ids; columns beyond those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.byte_bpe import encode_decode
from sinktrace.llm.decontaminate import without_matches
from sinktrace.llm.pii import redacted
from sinktrace.llm.quality_model import keep_good, train, training_labels, with_features
from sinktrace.llm.similar import without_near_copies
from sinktrace.storage import materialise, spread

MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labels of documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = materialise(training_labels(labels), "training-labels")  # a bounded number of rows
    learned = docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    return keep_good(docs, train(with_features(learned), sample), MIN_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates of which the sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text."""
    return redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", redact_personal_data), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # SQL cannot express these stages; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
