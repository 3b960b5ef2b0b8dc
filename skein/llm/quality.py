"""Quality classifier: a regularised quadratic discriminant over document statistics.

One pass over the texts gives each document's statistics. Class means and covariances come from
sums that tasks add up on their own; covariances are shrunk towards a multiple of the identity
and kept as Cholesky factors. A document's score is the logistic of the difference of the class
log densities (half squared Mahalanobis distances and log determinants) and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import save, small_batches
from skein.llm.textbatch import Words, distinct, mix, text_slices

FEATURES = (
    "log_words", "log_chars_a_word", "word_length_spread", "upper", "digits", "punctuation", "symbols", "high_bytes", "distinct_words",
    "distinct_pairs", "same_as_before", "most_frequent", "log_lines", "distinct_lines", "spaces", "words_with_symbol", "upper_words", "stops_a_word",
)
SHRINKAGE = 0.1
#: The difference of log densities is divided by this before the logistic; it orders nothing anew.
TEMPERATURE = 2.0

_UPPER, _LOWER, _DIGIT, _STOP, _LIGHT, _SYMBOL = (np.zeros(256, np.uint8) for _ in range(6))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_DIGIT[48:58] = 1
_STOP[[ord(c) for c in ".?!"]] = 1
_LIGHT[[ord(c) for c in ",;:'\"()-.?!"]] = 1
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 1
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1


def _per(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[cut[1:]] - total[cut[:-1]]).astype(np.float64)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)  # counts of nothing are whole numbers


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0, 1) * 0.998 + 0.001
    return np.log(p / (1 - p))


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text of a slice; an empty text has those of no words."""
    w = Words(raw, off)
    n = w.count.astype(np.float64)
    chars = np.diff(off).astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    doc = w.doc()
    mean = _share(np.bincount(doc, length, len(n)), n)
    spread = np.sqrt(np.maximum(_share(np.bincount(doc, length * length, len(n)), n) - mean**2, 0))
    solid = chars - _per(_SPACE[raw], off)
    d, h = distinct(doc, w.hash)
    kinds = np.bincount(d, minlength=len(n)).astype(np.float64)
    pair_doc = doc[:-1][doc[1:] == doc[:-1]] if len(doc) else doc
    pairs = mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])[doc[1:] == doc[:-1]] if len(doc) > 1 else np.zeros(0, np.uint64)
    n_pairs = np.bincount(pair_doc, minlength=len(n)).astype(np.float64)
    pair_kinds = np.bincount(distinct(pair_doc, pairs)[0], minlength=len(n)).astype(np.float64)
    same = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (w.hash[1:] == w.hash[:-1])], minlength=len(n)).astype(np.float64) if len(doc) > 1 else np.zeros(len(n))
    most = np.zeros(len(n))
    if len(doc):
        order = np.lexsort((w.hash, doc))
        a, b = doc[order], w.hash[order]
        run = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        np.maximum.at(most, a[run], np.diff(np.r_[run, len(a)]).astype(np.float64))
    lines = _per(raw == 10, off) + 1
    # Lines by their hash: the words up to each line feed, summed per line.
    line_of = np.cumsum(raw == 10)[w.start] if len(doc) else np.zeros(0, np.int64)
    if len(doc):
        new = np.flatnonzero(np.r_[True, (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])])
        place = np.arange(len(doc)) - np.repeat(new, np.diff(np.r_[new, len(doc)]))
        line_hash = np.add.reduceat(mix(w.hash + place.astype(np.uint64)), new)
        line_doc = doc[new]
        n_lines = np.bincount(line_doc, minlength=len(n)).astype(np.float64)
        line_kinds = np.bincount(distinct(line_doc, line_hash)[0], minlength=len(n)).astype(np.float64)
    else:
        n_lines = line_kinds = np.zeros(len(n))
    flags = np.concatenate([[0], np.cumsum(_SYMBOL[raw], dtype=np.int64)])
    with_symbol = np.bincount(doc, flags[w.end] > flags[w.start], len(n))
    low = np.concatenate([[0], np.cumsum(_LOWER[raw] | (raw >= 128), dtype=np.int64)])
    up = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int64)])
    upper_words = np.bincount(doc, (up[w.end] > up[w.start]) & (low[w.end] == low[w.start]), len(n))
    columns = [
        np.log1p(n), np.log1p(mean), spread, _logit(_share(_per(_UPPER[raw], off), solid)), _logit(_share(_per(_DIGIT[raw], off), solid)),
        _logit(_share(_per(_LIGHT[raw], off), solid)), _logit(_share(_per(_SYMBOL[raw], off), solid)), _logit(_share(_per(raw >= 128, off), solid)),
        _logit(_share(kinds, n)), _logit(_share(pair_kinds, n_pairs)), _logit(_share(same, n)), _logit(_share(most, n)), np.log1p(lines),
        _logit(_share(line_kinds, n_lines)), _logit(_share(chars - solid, chars)), _logit(_share(with_symbol, n)), _logit(_share(upper_words, n)), _logit(_share(_per(_STOP[raw], off), n)),
    ]
    return np.stack(columns, 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in text_slices(batch.column("text")):
            x = statistics(raw, off)
            lens = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(lens, pa.array(x.ravel()))], names=["doc_id", "stats"])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_describe, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Class means and Cholesky factors over centred and scaled statistics; ``whiten`` holds the factors' triangular inverses."""

    shift: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    whiten: np.ndarray
    bias: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        z = (x - self.shift) / self.scale
        density = [self.bias[c] - 0.5 * (((z - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    sums: dict[int, list] = {}
    for batch in batches:
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for c in (0, 1):
            own = x[y == c]
            s = sums.setdefault(c, [0, np.zeros(d), np.zeros((d, d))])
            s[0] += len(own)
            s[1] += own.sum(0)
            s[2] += own.T @ own
    out = [(c, i, v) for c, s in sums.items() for i, v in enumerate(np.concatenate([[s[0]], s[1], s[2].ravel()]))]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.float64()))], names=["c", "i", "v"])


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """Fit on the rows of ``stats`` that ``labels`` (doc_id, quality) marks 0 or 1; all of them.

    Null ids and labels teach nothing. Without a row of either class there is no model (None).
    """
    d = len(FEATURES)
    taught = stats.join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id").select("stats", "quality")
    sums = taught.mapInArrow(_moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + d + d * d) numbers
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r.c, r.i] = r.v
    if not (total[:, 0] > 0).all():
        return None
    count, mean, square = total[:, 0], total[:, 1 : d + 1] / total[:, :1], total[:, d + 1 :].reshape(2, d, d) / total[:, 0, None, None]
    shift = total[:, 1 : d + 1].sum(0) / count.sum()
    spread = np.sqrt(np.maximum(np.diagonal(total[:, d + 1 :].sum(0).reshape(d, d)) / count.sum() - shift**2, 1e-9))
    factors, bias = [], []
    for c in (0, 1):
        cov = (square[c] - np.outer(mean[c], mean[c])) / np.outer(spread, spread)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(cov))
        bias.append(np.log(count[c] / count.sum()) - np.log(np.diagonal(factors[-1])).sum())
    return Discriminant(shift, spread, (mean - shift) / spread, np.stack(factors), np.stack([np.linalg.inv(f) for f in factors]), np.array(bias))


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score); 0.5 for all where there is no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = model.score(x) if model is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged; all of them where there is no model."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(statistics(raw, off)) >= threshold for _, _, raw, off in text_slices(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def teachers(labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Labels but those whose crc32(doc_id as text) mod ``modulus`` is ``held``."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Null and empty texts are scored by the statistics of no words. A null doc_id is not held out.
    """
    stats = save(describe(docs), "stats")
    scored = score(stats, fit(stats, teachers(labels)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
