"""Token ids of a corpus as flat unsigned-integer files with 64-bit document offsets.

The corpus is dealt out by ranges of doc_id, and within one doc_id by how its texts begin. Each task encodes its documents in order and writes
three flat files: ``ids`` (unsigned 16 or 32 bits, little-endian), ``offsets`` (64 bits, one more than
documents) and ``docs`` (64-bit doc ids). A manifest has one row for each partition; the bases of the
partitions are prefix sums over it. Readers map the files into memory.

A task that runs again, because an executor was lost, writes files of its own; only those that the
committed manifest names are ever read.

Ids that do not fit the type of the files raise an error.

Defined cases: a null or empty text has no ids but the end id; a null doc_id sorts first and is kept;
rows with equal doc_id are ordered by text; an empty table gives an empty manifest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinktrace.llm.caches import kept
from sinktrace.llm.chunks import ChunkCache, ends_open
from sinktrace.llm.columns import texts_of
from sinktrace.storage import materialise, partitions, scratch

NO_DOC = -(2**63)  # stands for a null doc_id in a docs file


def token_type(path: str) -> str:
    """The narrowest unsigned type, of 16 or 32 bits, for the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab(True).values()) < 1 << 16 else "<u4"


def library_encoder(path: str, dtype: str) -> ChunkCache:
    """An encoder of whole texts by a byte-level tokenizer file; kept by the Python worker."""
    return kept(f"library {path} {dtype}", lambda: _library_encoder(path, dtype))


def _library_encoder(path: str, dtype: str) -> ChunkCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(True)
    if max(vocab.values()) > np.iinfo(dtype).max:
        raise ValueError(f"ids of up to {max(vocab.values())} do not fit {dtype}")
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for piece, i in vocab.items():
        width[i] = len(piece)  # one character of a byte-level piece is one byte

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def make(chunks: list[str]) -> list[tuple[bytes, ...]]:
        # Those that may stand between others are encoded as one long text, whose ids are cut where the chunks end.
        within = [c[0] in " \n" and not ends_open(c) for c in chunks]
        line = [c for c, w in zip(chunks, within, strict=True) if w]
        whole, *alone = ids(["".join(line), *(c for c, w in zip(chunks, within, strict=True) if not w)])
        cuts = np.searchsorted(np.cumsum(width[whole]), np.cumsum([len(c.encode()) for c in line])) + 1
        raw, size = whole.astype(dtype).tobytes(), np.dtype(dtype).itemsize
        bounds = [0, *(cuts * size).tolist()]
        joined, apart = iter([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]), iter(alone)
        return [(next(joined) if w else next(apart).astype(dtype).tobytes(),) for w in within]

    return ChunkCache(make, (np.dtype(dtype).itemsize,), limit=800_000, group=1 << 22)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the file system is local, else read."""
    from pyarrow import fs

    where, path = _open(uri)
    if where.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(
    docs: DataFrame, out: str, make_encoder: Callable[[], ChunkCache], dtype: str = "<u2", end_id: int = 0, n_parts: int | None = None
) -> DataFrame:
    """Write the files below ``out``; returns the committed manifest: part, uri, n_docs, n_tokens, base_doc, base_token.

    ``make_encoder`` is called once per task; its ``many`` turns texts into tuples of one value, the ids as bytes of ``dtype``.
    """
    spark = docs.sparkSession
    n = n_parts or partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{out}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        where, path = _open(out)
        encoder, end = make_encoder(), np.array([end_id], dtype).tobytes()
        size, at, ids_file, lengths, doc_ids = np.dtype(dtype).itemsize, 0, None, [], []
        for batch in batches:
            if ids_file is None:
                where.create_dir(path, recursive=True)
                ids_file = where.open_output_stream(_open(f"{uri}.ids")[1])
            blobs = []
            for (ids,) in encoder.many(texts_of(batch.column("text"))):
                blobs += [ids, end]
            at += ids_file.write(b"".join(blobs)) // size
            lengths.append(np.array([len(x) for x in blobs], np.int64).reshape(-1, 2).sum(1) // size)
            doc_ids.append(batch.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False))
        if ids_file is None:
            return
        ids_file.close()
        counts = np.concatenate(lengths)
        for name, values in (("offsets", np.concatenate([[0], np.cumsum(counts)])), ("docs", np.concatenate(doc_ids))):
            with where.open_output_stream(_open(f"{uri}.{name}")[1]) as f:
                f.write(values.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "uri": [uri], "n_docs": pa.array([len(counts)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64())})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialise(dealt.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long"), "manifest")
    # One row for each partition, of which there are n: the prefix sums are over n rows at most.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("n_docs", "base_doc"), ("n_tokens", "base_token"))))


def read_token_files(manifest: DataFrame, fields: Callable[[np.ndarray], dict], schema: str, dtype: str = "<u2", n_parts: int | None = None) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens and what ``fields`` makes of its ids."""
    n = n_parts or partitions(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, doc_ids = (_mapped(f"{row['uri']}.{x}", d) for x, d in (("ids", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for lo in range(0, len(doc_ids), 2048):
                    part = slice(lo, min(lo + 2048, len(doc_ids)))
                    more = [fields(ids[a:b]) for a, b in zip(offsets[part], offsets[part.start + 1 : part.stop + 1], strict=True)]
                    columns = {"doc_id": pa.array(np.array(doc_ids[part]), pa.int64(), mask=np.array(doc_ids[part] == NO_DOC)), "start": pa.array(offsets[part] + row["base_token"], pa.int64()), "n_tokens": pa.array(np.diff(offsets[part.start : part.stop + 1]), pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | {k: pa.array([x[k] for x in more]) for k in more[0]})

    return manifest.repartition(n, "part").mapInArrow(read, f"doc_id long, start long, n_tokens long, {schema}")


def crc(ids: np.ndarray) -> dict:
    """The unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return {"ids_crc32": zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())}


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode every text of documents, write the token files, read them back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs, dtype = spark.read.parquet(f"{sf_dir}/documents.parquet"), token_type(tokenizer)
    manifest = write_token_files(docs, scratch(spark, "token-files"), lambda: library_encoder(tokenizer, dtype), dtype)
    return read_token_files(manifest, crc, "ids_crc32 long", dtype)
