"""A quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree to the gradient on one feature's
bins and adds it to that feature's lookup table. Then the pairs of features that explain most of what is
left get tables of their own, boosted in the same way. A score is the sum of one entry per table, looked
up for a whole batch of rows at a time, through the logistic function.

The features come from the text alone. The model is fitted on the driver on at most ``max_rows`` labelled
rows (a documented bound, chosen by the hash of their ids); every row is scored.

Defined cases: a null text counts as empty; an empty text has feature values of zero and is scored like
any other; a null doc_id has remainder 0 and so is held out; labels that are null or not 0 or 1 are not
learned from; without a row of each label the score is the share of label 1, 0.5 if there are none;
repeated documents are scored alike; if a document has several labels, each counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.caches import release
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import materialise, spread

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "space", "distinct",
    "adjacent", "top_word", "line_words", "dup_lines", "long_words", "letters_wide",
)
SYMBOLS = "#*$%&<>@^~=+_{}[]\\/"


def _classes() -> np.ndarray:
    table = np.full(256, 9, np.uint8)
    for name, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SYMBOLS, "|", "!", ".,;:?", " \t\r\v\f", "\n", "abcdefghijklmnopqrstuvwxyz")):
        table[[ord(c) for c in chars]] = name
    return table


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """The values of FEATURES for a text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, codes = len(words), np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(codes, 255)], minlength=10)
    chars = len(codes)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return [
        float(np.log1p(n)), (chars - kinds[6] - kinds[7]) / n, *(kinds[:4] / chars), kinds[4] / n, kinds[5] / n, (kinds[6] + kinds[7]) / chars,
        len(counts) / n**0.8, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
        sum(len(w) > 14 for w in counts) / len(counts), kinds[9] / chars,
    ]


def with_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs, then ``features``: an array of the values of FEATURES."""
    keep = without(keep, "features", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            values = [features(t) for t in texts_of(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.list_(pa.float64()))], [*keep, "features"])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, held + "features array<double>")


@dataclass
class AdditiveModel:
    """Cuts of each feature, a table for each feature, and tables for pairs of features."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaves(grad: np.ndarray, hess: np.ndarray, ridge: float, leaves: int) -> tuple[np.ndarray, float]:
    """A tree over ordered bins by best-first splits: its value for each bin, and its gain."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    bounds, total = [0, len(grad)], 0.0
    while len(bounds) <= leaves:
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gains = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
                if gains.max() > best[0]:
                    best = (gains.max(), int(k[gains.argmax()]))
        if best[1] is None:
            break
        total += best[0]
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out, total


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree with one cut on each of two features: its value for each pair of bins, and its gain."""
    g, h = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (grad, hess))
    m, n = grad.shape
    if m < 2 or n < 2:
        return np.zeros_like(grad), 0.0
    i, j = np.arange(1, m)[:, None], np.arange(1, n)[None, :]
    parts = [(a[i, j], a[i, n] - a[i, j], a[m, j] - a[i, j], a[m, n] - a[i, n] - a[m, j] + a[i, j]) for a in (g, h)]
    gain = sum(p**2 / (q + ridge) for p, q in zip(*parts, strict=True))
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    values = [p[a, b] / (q[a, b] + ridge) for p, q in zip(*parts, strict=True)]
    out = np.empty_like(grad)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = values
    return out, float(gain[a, b] - g[m, n] ** 2 / (h[m, n] + ridge))


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 48, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 4, ridge: float = 3.0) -> AdditiveModel:
    """Fit the tables by cyclic boosting of the logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return AdditiveModel(base=float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    model.cuts = [np.unique(np.quantile(x[:, j], np.arange(1, max_bins) / max_bins)) for j in range(x.shape[1])]
    bins = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.single = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    def pair_histogram(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(bins[:, i] * sizes[j] + bins[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = slopes()
            tree, _gain = _leaves(np.bincount(bins[:, j], g, s), np.bincount(bins[:, j], h, s), ridge, leaves)
            model.single[j] += rate * tree
            total += rate * tree[bins[:, j]]
    g, h = slopes()
    found = sorted(((-_quadrants(pair_histogram(i, j, g), pair_histogram(i, j, h), ridge)[1], i, j) for i in range(len(sizes)) for j in range(i)), key=lambda p: p)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in found[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            tree, _gain = _quadrants(pair_histogram(i, j, g), pair_histogram(i, j, h), ridge)
            table += rate * tree
            total += rate * tree[bins[:, i], bins[:, j]]
    return model


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of doc_id as text has the remainder; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def training_labels(labels: DataFrame, max_rows: int = 40_000) -> DataFrame:
    """At most ``max_rows`` labels (doc_id, quality) of documents that are not held out, chosen by the hash of the id."""
    known = labels.where("quality in (0, 1)").where(~held_out(5, 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)


def train(marked: DataFrame, sample: DataFrame) -> AdditiveModel:
    """Fit a model on the rows of ``marked`` (doc_id, features) that the bounded sample labels; of rows with one doc_id on one of them."""
    labelled = marked.select("doc_id", "features").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    rows = labelled.orderBy(F.xxhash64("doc_id"), "features", "quality").select("features", "quality").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.column("quality").to_numpy().astype(np.float64))


def score(marked: DataFrame, model: AdditiveModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of marked, then score."""
    keep = without(keep, "score", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(flat.reshape(-1, len(FEATURES))))], [*keep, "score"])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in marked.select(*keep).schema)
    return marked.select(*keep, "features").mapInArrow(run, held + "score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float) -> DataFrame:
    """The rows of docs whose score is ``threshold`` at least, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = np.array([features(t) for t in texts_of(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of documents: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    marked = materialise(with_features(spread(docs)), "quality-features")
    scored = score(marked, train(marked, training_labels(labels)))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
