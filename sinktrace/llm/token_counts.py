"""Token counts of documents by trie-shared dynamic programming.

A pre-token is a word with the piece mark before it. Its best segmentation into vocabulary pieces is the
one with the highest sum of log-probabilities, then the fewest pieces. The distinct pre-tokens of a block
of documents, in order, are the depth-first walk of their trie: going from one to the next, the forward
scores of the shared prefix stay, and only those of the new characters are computed. Each terminal's count
is stored, and a document's count is the sum over its words.

The vocabulary is that of a sentencepiece model file. A unigram model's pieces have its scores; a model of
another type has no probabilities, so its piece of rank r gets -log(r + 1), less the logarithm of their sum
(Zipf's law). A character without a piece is written as byte
pieces, one for each byte of its UTF-8, at the least probability of a piece each.

Defined cases: null and empty texts have no pre-tokens; a very long word is segmented like any other, in
time proportional to its length; repeated rows are counted alike; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.caches import kept
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import spread

MARK = "▁"
_BLOCK = 1_000  # documents whose words are put into one trie


UNIGRAM = 1  # fixed value: the trainer's model type of a unigram model; others have no probabilities


def model_type(proto: bytes) -> int:
    """The model type (field 3) that the trainer's part (field 2) of a serialised sentencepiece model names; 1 if it names none."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    return value

        while at < len(data):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
                yield key >> 3, data[at : at + size]
                at += size

    trainer = next((v for n, v in fields(proto) if n == 2 and isinstance(v, bytes)), b"")
    return next((v for n, v in fields(trainer) if n == 3 and isinstance(v, int)), UNIGRAM)


def vocabulary(path: str) -> dict[str, float]:
    """Log-probabilities of the ordinary pieces of a sentencepiece model: its own scores if it is a unigram model, else by their order in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if model_type(model.serialized_model_proto()) == UNIGRAM:
        return {model.id_to_piece(i): model.get_score(i) for i in ids}
    total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class TrieCounter:
    """Counts and scores of pre-tokens; at most ``limit`` terminals are remembered at a time."""

    def __init__(self, pieces: dict[str, float], limit: int = 400_000):
        self.limit = limit
        # Every end of a piece, with the piece's score if it is one: a search backwards stops where no piece goes on.
        self.ends: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(len(p))}
        self.ends.update(pieces)
        self.byte = min(pieces.values(), default=0.0)
        self.tokens: dict[bytes, int] = {}
        self.scores: dict[bytes, float] = {}

    def learn(self, words: set[bytes]) -> None:
        """Walk the trie of the words that are not yet known, depth first."""
        new = sorted(w for w in words if w not in self.tokens)
        if len(self.tokens) + len(new) > self.limit:
            self.tokens.clear()
            self.scores.clear()
            new = sorted(words)
        best, used, path = [0.0], [0], ""
        ends, missing = self.ends, ()
        for word in new:
            text = MARK + word.decode()
            shared = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for stop in range(shared + 1, len(text) + 1):
                n_bytes = len(text[stop - 1].encode())
                top, count = -math.inf, 0
                start = stop - 1
                while start >= 0:
                    score = ends.get(text[start:stop], missing)
                    if score is missing:
                        break
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and used[start] + 1 < count:
                            top, count = score, used[start] + 1
                    start -= 1
                if ends.get(text[stop - 1]) is None:
                    score = best[stop - 1] + n_bytes * self.byte
                    if score > top:
                        top, count = score, used[stop - 1] + n_bytes
                best.append(top)
                used.append(count)
            path = text
            self.tokens[word], self.scores[word] = used[-1], best[-1]

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """Of each text the number of pre-tokens, the number of tokens and the log-probability."""
        words = [(t or "").encode().split() for t in texts]  # of bytes: at ASCII white space only
        different = set().union(*words) if words else set()
        if len(different) > self.limit and len(texts) > 1:  # in halves, so that no trie is larger than the limit
            half = len(texts) // 2
            return self.count(texts[:half]) + self.count(texts[half:])
        self.learn(different)
        return [(len(w), sum(map(self.tokens.__getitem__, w)), math.fsum(map(self.scores.__getitem__, w))) for w in words]


def count_tokens(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs, then n_pretokens, n_tokens and log_prob of each text."""
    keep = without(keep, "n_pretokens", "n_tokens", "log_prob", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"pieces {model_path}", lambda: TrieCounter(vocabulary(model_path)))
        for batch in batches:
            for lo in range(0, len(batch), _BLOCK):
                part = batch.slice(lo, _BLOCK)
                rows = counter.count(list(texts_of(part.column("__text"))))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, "n_pretokens", "n_tokens", "log_prob"])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, held + "n_pretokens long, n_tokens long, log_prob double")


def op7_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts of every text of documents: doc_id, n_pretokens, n_tokens, log_prob."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), model_path)
