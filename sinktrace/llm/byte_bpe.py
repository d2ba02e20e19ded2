"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks.

Each byte is mapped to a printable character. A piece of the model is a byte-mapped vocabulary entry
with the score -rank, so the best merge is the one of lowest rank; the normaliser is the identity.
Pre-tokens are encoded one by one; decoding maps the ids back to bytes.

Defined cases: a null or empty text has no ids and decodes to nothing; rows are independent, so ties
and repeated rows need no rule; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sinktrace.llm.caches import kept
from sinktrace.llm.chunks import ChunkCache, check_pattern
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import spread

def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    shown = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol-buffer message: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i is the entry of rank i, and whose last piece is the unknown one.

    Field numbers are those of the published message: a model has pieces (1), trainer (2) and normaliser (3);
    a piece has text (1), score (2) and type (3).
    """
    shown = byte_characters()
    by_rank = sorted((rank, token) for token, rank in ranks.items())
    if [r for r, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    pieces = [_field(1, _field(1, "".join(shown[b] for b in token).encode()) + _field(2, float(-rank))) for rank, token in by_rank]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = 2**64 - 1  # -1: there is no such piece
    trainer = _field(3, 2) + _field(24, 0) + _field(40, len(by_rank)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes by a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; one that is an entry as a whole has that entry's id."""
        raw = [p.encode() for p in pretokens]
        whole = [self.ranks.get(b) for b in raw]
        rest = iter(self.model.encode([b.decode("latin-1").translate(self.shown) for b, w in zip(raw, whole, strict=True) if w is None], num_threads=1))
        return [next(rest) if w is None else [w] for w in whole]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pretokens(self.pattern.findall(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def digests(self, chunks: list[str]) -> list[tuple[bytes, ...]]:
        """For each chunk its ids in decimal, each after a space, and the bytes that they decode to."""
        found = [[c] if c[1:].isalpha() and c[0] == " " else self.pattern.findall(c) for c in chunks]
        different = list({p for f in found for p in f})
        ids = dict(zip(different, self.encode_pretokens(different), strict=True))
        out = []
        for f in found:
            own = [i for p in f for i in ids[p]]
            out.append(("".join(f" {i}" for i in own).encode(), self.decode(own)))
        return out


def _cache(path: str, pattern: str) -> ChunkCache:
    def make() -> ChunkCache:
        bpe = ByteBpe(read_ranks(path), pattern)
        check_pattern(bpe.pattern.findall)
        return ChunkCache(bpe.digests, (1, 1), limit=400_000)

    return kept(f"bpe {path} {pattern}", make)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs, then n_tokens, ids_sha256 and decoded_sha256 of each text."""
    keep = without(keep, "n_tokens", "ids_sha256", "decoded_sha256", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(ranks_path, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for decimal, raw in cache.many(texts_of(batch.column("__text"))):
                n.append(bytes(decimal).count(b" "))
                ids.append(hashlib.sha256(decimal[1:]).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, docs["text"].cast("string").alias("__text")).mapInArrow(run, f"{held}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
