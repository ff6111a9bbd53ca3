"""A quality classifier: histogram gradient-boosted trees over document statistics, trained here.

Training: a bounded sample of labelled rows (SAMPLE, a parameter) is taken by the rows' hashes; their statistics, not
their texts, go to the driver, a few megabytes at most. Features are put into quantile bins and trees are grown level by
level from histograms of gradients. Scoring: the trees are complete binary trees flattened into arrays, and numpy walks
all documents of a batch down all trees at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bound_batches, small_side, text_or_empty

#: Labelled rows that training takes at most, about.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 60, 4, 64, 0.2, 1.0, 2.0
#: Rows of labels whose number crc32(doc_id) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "adjacent_words", "upper", "digits", "space", "symbols", "marks", "pipes", "stops", "line_length", "distinct_lines", "short_words", "shouted_words", "marked_words", "compressed", "ends", "beyond_ascii")
_UPPER, _DIGITS, _SPACE, _SYMBOLS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#*$%&<>@^~=+", b"!?"
_ALNUM = (_UPPER + _UPPER.lower() + _DIGITS)


def statistics(text: bytes) -> list[float]:
    """FEATURES of a whole UTF-8 text; shares are of bytes, words or lines. An empty text has zeros."""
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)

    def share(of: bytes) -> float:
        return 1 - len(text.translate(None, of)) / size

    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    loud = sum(map(bytes.isupper, words))
    packed = zlib.compressobj(1)
    small = sum(len(packed.compress(text[at : at + (1 << 20)])) for at in range(0, size, 1 << 20)) + len(packed.flush())
    tails = b"".join([w[-1:] for w in words])
    odd = len(tails.translate(None, _ALNUM + b".,;:" + bytes(range(128, 256)))) / n
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, share(_UPPER), share(_DIGITS), share(_SPACE), share(_SYMBOLS), share(_MARKS), text.count(b"|") / n,
        (text.count(b".") + text.count(b",")) / n, size / len(lines), len(set(lines)) / len(lines), float((lengths <= 2).mean()), loud / n, odd, small / size,
        tails.count(b".") / n, share(bytes(range(128, 256))),
    ]


class Trees:
    """Boosted complete trees of one depth: per tree 2**depth - 1 features and thresholds, 2**depth leaf values."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, prior: float):
        self.feature, self.threshold, self.value, self.prior = feature, threshold, value, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        raw = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Logistic boosting on histograms. Without rows of both labels the score is constant (0.5 without any row)."""
    good = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(good / (1 - good)))
    n_inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, n_inner), np.int64), np.zeros((0, n_inner)), np.zeros((0, 2**depth)), prior)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin <= k  <=>  x <= edges[k]
    features = np.zeros((trees, n_inner), np.int64)
    thresholds = np.full((trees, n_inner), np.inf)
    values = np.zeros((trees, 2**depth))
    raw = np.full(len(y), prior)
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = node - first
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cells = at * bins + binned[:, j]
                gs = np.bincount(cells, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(cells, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                cut = gain.argmax(1)
                better = gain[np.arange(width), cut] > best
                best[better] = gain[np.arange(width), cut][better]
                features[k, first : first + width][better] = j
                thresholds[k, first : first + width][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[k, node]] > thresholds[k, node])
        leaf = node - n_inner
        values[k] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        raw += values[k, leaf]
    return Trees(features, thresholds, values, prior)


def fold(doc_col: str):
    return F.crc32(F.col(doc_col).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees learnt from at most about `sample` labelled documents outside the held-out fold.

    Labels without an id or a quality are left out; of several labels of a document the least counts, of several rows of
    a document the one with the least statistics, so `sample` bounds rows however often an id is repeated.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(doc_col).isNotNull() & F.col(quality_col).isin(0, 1) & (fold(doc_col) != HELD_OUT))
    usable = usable.groupBy(F.col(doc_col).alias("labelled")).agg(F.min(quality_col).alias("good"))
    share = min(1.0, sample / max(1, usable.count()))
    taken = usable.where(F.pmod(F.xxhash64("labelled", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    slim = docs.select(F.col(doc_col).alias("doc"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = slim.join(small_side(taken, 2 * sample), F.col("doc") == F.col("labelled")).select(F.col("doc").cast("string"), "text", F.col("good").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc", "x", "y"])

    found = rows.mapInArrow(run, "doc string, x array<double>, y int").groupBy("doc").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()
    found.sort(key=lambda r: (r.x, r.y))  # the same trees whatever the order of tasks
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return train(x, np.array([r.y for r in found], float))


def _scored(docs: DataFrame, trees: Trees, keep: Column, text_col: str) -> DataFrame:
    """(kept, score): a column of docs and the score of the row's text."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.value, trees.prior))  # some 30 kB
    source = docs.select(keep.alias("kept"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*model.value)
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], names=["kept", "score"])

    return source.mapInArrow(run, StructType([source.schema["kept"], StructField("score", DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on), one row per row of docs.

    Null texts count as empty and are scored as well; a null id is in no fold, so held_out is false; an empty table
    gives an empty result, and without labels the score is 0.5 throughout; other columns are ignored.
    """
    trees = fit(docs, labels, doc_col=doc_col, text_col=text_col, quality_col=quality_col, sample=sample)
    return _scored(docs, trees, F.col(doc_col), text_col).select(
        F.col("kept").alias("doc_id"),
        F.coalesce(fold("kept") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns, of any names; texts are read once more and
    not shuffled."""
    trees = fit(docs, labels, doc_col=doc_col, text_col=text_col, quality_col=quality_col, sample=sample)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs, trees, row, text_col).where(F.col("score") >= threshold).select("kept.*")
