"""Quality rules: fixed base rules, then a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets. One multinomial over the buckets is counted on the trusted
target (documents that labels mark as good), one on the whole raw corpus. A document's score is the mean
of log(target / raw) over its n-grams; it is kept if no base rule fails and the score is ``min_llr`` at
least. Every document is judged by the same fixed threshold.

Which documents are trusted is found by their ids alone: ids with their places (file and row) meet the
labels, and the places go to the shared folder, a list for each file of documents. The scan that counts
reads the list of the file that it is in, so texts are never dealt out, and no id is a hot key of texts.

Defined cases: a null text has no words; a text without words has score 0 (and fails a base rule);
a null doc_id is never trusted; without trusted documents both multinomials are flat and every score is 0; repeated rows count as often
as they occur; labels that are null are not trusted; several labels of a document trust it if one does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.columns import texts_of, without
from sinktrace.llm.words import mixed, window_codes, word_codes
from sinktrace.storage import materialise, scratch, spread

BUCKET_BITS = 16
MIN_LLR = -0.13
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def buckets(codes: np.ndarray) -> np.ndarray:
    """The buckets of a text's words and word pairs."""
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([mixed(codes, 1) >> shift, window_codes(codes, 2, 2) >> shift]).astype(np.int64)


def base_counts(raw: bytes, words: list[bytes], codes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8."""
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeat = 0
    windows = window_codes(codes, 5)
    if len(windows) > 1:
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse] > 1)
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 5, -1)
        repeat = int(np.count_nonzero(np.cumsum(cover)))
    return chars, len(_SYMBOL.findall(raw)), len(lines) - len(set(lines)), repeat


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def placed(docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table read from files, and where its rows lie in them: __file (a hash of the name) and __row."""
    return docs.select(*columns, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def trusted_rows(docs: DataFrame, good: DataFrame, ways: int = 16) -> Callable[[pa.RecordBatch], np.ndarray]:
    """For batches of ``placed`` rows, which of them have a doc_id of ``good``. docs is read from files.

    Only ids and places are dealt out, each id in some ``ways``. A list has eight bytes for each trusted row of one file;
    the driver gets two numbers for each file.
    """
    out = scratch(docs.sparkSession, "trusted-rows")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        rows: list[np.ndarray] = []
        last = None

        def sent() -> pa.RecordBatch:
            where, path = _open(f"{out}/{last}-{attempt}")
            where.create_dir(_open(out)[1], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(np.unique(np.concatenate(rows)).tobytes())
            rows.clear()
            return pa.RecordBatch.from_pydict({"__file": [last], "attempt": [attempt]})

        for batch in batches:
            files, at = (batch.column(c).to_numpy() for c in ("__file", "__row"))
            cuts = np.flatnonzero(np.diff(files)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(files)], strict=True):
                if lo == hi:
                    continue
                if rows and files[lo] != last:
                    yield sent()
                last = int(files[lo])
                rows.append(at[lo:hi])
        if rows:
            yield sent()

    ids = placed(docs.where("doc_id IS NOT NULL"), "doc_id").withColumn("way", (F.col("__row") % ways).cast("int"))
    asked = good.select("doc_id").distinct().withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    met = ids.join(asked.hint("merge"), ["doc_id", "way"], "left_semi").select("__file", "__row")
    written = materialise(met.repartition("__file").sortWithinPartitions("__file").mapInArrow(write, "__file long, attempt long"), "trusted-files")
    listed = {r["__file"]: r.attempt for r in written.collect()}  # two numbers for each file of documents
    held: dict[int, np.ndarray] = {}

    def flags(batch: pa.RecordBatch) -> np.ndarray:
        files, at = (batch.column(c).to_numpy() for c in ("__file", "__row"))
        flag = np.zeros(len(files), bool)
        for file in np.unique(files).tolist():
            if file not in listed:
                continue
            if file not in held:
                if len(held) == 16:  # a task goes through its files one by one, but for a small table that was spread
                    held.clear()
                where, path = _open(f"{out}/{file}-{listed[file]}")
                with where.open_input_file(path) as f:
                    held[file] = np.frombuffer(f.read(), np.int64)
            here = files == file
            flag[here] = np.isin(at[here], held[file])
        return flag

    return flags


def ngram_counts(docs: DataFrame, flags: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """Rows (bucket, n_raw, n_target) over docs (text, trusted), or over ``placed`` texts and the flags of ``trusted_rows``. Each task sends a row for a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(1 << BUCKET_BITS, np.int64) for _ in range(2))
        for batch in batches:
            for text, trusted in zip(texts_of(batch.column("text")), flags(batch) if flags else batch.column("trusted").to_pylist(), strict=True):
                found = buckets(word_codes().codes((text or "").encode().split()))
                np.add.at(raw, found, 1)
                if trusted:
                    np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n_raw": raw[some], "n_target": target[some]})

    counted = docs.select(F.col("text").cast("string").alias("text"), *(("__file", "__row") if flags else ("trusted",))).mapInArrow(run, "bucket int, n_raw long, n_target long")
    return counted.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def ratios(counts: DataFrame, alpha: float = 0.5) -> np.ndarray:
    """log(target / raw) for each bucket; the table has 2**BUCKET_BITS entries, whatever the corpus."""
    rows = counts.toArrow()
    n = np.full((2, 1 << BUCKET_BITS), alpha)
    at = rows.column("bucket").to_numpy()
    n[0, at] += rows.column("n_raw").to_numpy()
    n[1, at] += rows.column("n_target").to_numpy()
    if n[1].sum() <= alpha * n.shape[1]:
        return np.zeros(n.shape[1])
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def judge(docs: DataFrame, table: np.ndarray, keep: tuple[str, ...] = ("doc_id",), min_llr: float = MIN_LLR) -> DataFrame:
    """Columns ``keep`` of docs, then n_words, the base counts, base_failed, llr and kept."""
    keep = without(keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("__text")):
                raw = (text or "").encode()
                words = raw.split()
                codes = word_codes().codes(words)
                counts = base_counts(raw, words, codes)
                failed = len(words) < 10 or 100 * counts[3] > 20 * len(words)
                llr = float(table[buckets(codes)].mean()) if words else 0.0
                rows.append((len(words), *counts, failed, llr, not failed and llr >= min_llr))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    schema = held + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every text of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flags = trusted_rows(docs, labels.where("quality = 1"))
    return judge(spread(docs), ratios(ngram_counts(spread(placed(docs, "text")), flags)))
