"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics (shape of words and
lines, letters, punctuation, repetition). Each class gets a mean and a shrinkage
covariance; a document's raw score is the difference of the two Mahalanobis log
densities, taken with Cholesky factors that are computed once. A logistic curve
fitted to a histogram of raw scores turns it into a probability.

Fitting passes over all training rows as sums (count, sum, sum of outer
products by class) and as a histogram with a fixed number of bins; what reaches
the driver is of fixed size for each partition of a small feature table, never
a row per document.

Defined results: null and empty texts are scored as texts without words; a null
doc_id is never labelled and not held out; labels other than 0 and 1 are not
learned from; repeated rows are scored, and learned from, each; very long texts
are measured whole; equal texts have equal scores; an empty table gives an empty
table; other columns are not read, and carried along where rows are kept; where
a class has no training row, every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import configured, staged, table

#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "log_words", "log_mean_word", "word_spread", "upper", "digit", "sentence_mark", "shout_mark", "symbol",
    "letterless_word", "marked_word", "newline", "non_ascii", "distinct_word", "same_neighbour", "repeated_triple",
)
#: Share of the covariance that is replaced by its diagonal.
SHRINKAGE = 0.1
#: A score from here on predicts label 1.
CUT = 0.3
#: Bins and range of the histogram of raw scores that the logistic curve is fitted to.
BINS, REACH = 2048, 60.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:'\"()-")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL &= ~_MARK & ~_SHOUT


def _ratio(part, whole):
    """Log odds of part in whole, smoothed, so that rare and common shares both spread out."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5) * (1 / (1 + 1 / (whole + 1.0))))


def statistics(column) -> np.ndarray:
    """A row of ``STATISTICS`` for each text of an Arrow string column."""
    out = []
    for _, n, w in tb.chunks(column):
        out.append(_statistics(n, w))
    return np.concatenate(out) if out else np.empty((0, len(STATISTICS)))


def _statistics(n: int, w: tb.Words) -> np.ndarray:
    def by_text(values, at):  # sums between boundaries
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    size = np.diff(w.byte).astype(float)
    words = np.diff(w.first).astype(float)
    length = w.end - w.start
    sum_len, sum_sq = by_text(length, w.first), by_text(length * length, w.first)
    mean = sum_len / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(sum_sq / np.maximum(words, 1) - mean**2, 0))
    count = {k: by_text(of[w.data], w.byte) for k, of in (("letter", _LETTER), ("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK), ("shout", _SHOUT), ("symbol", _SYMBOL))}
    newline, wide = by_text(w.data == 10, w.byte), by_text(w.data >= 0xC0, w.byte)
    letters = np.concatenate(([0], np.cumsum(_LETTER[w.data], dtype=np.int64)))
    letterless = by_text(letters[w.end] == letters[w.start], w.first)
    marked = by_text(~_LETTER[w.data[w.end - 1]] & ~_DIGIT[w.data[w.end - 1]], w.first) if len(w.end) else np.zeros(n)
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(w.first))

    def distinct(hashes, owner):
        key = tb.mix64(hashes + owner * np.uint64(0x9E3779B97F4A7C15))
        order = np.unique(key, return_index=True)[1]
        return np.bincount(owner[order].astype(np.int64), minlength=n).astype(float)

    kinds = distinct(w.hash, text)
    same = np.zeros(n)
    triples, triple_kinds = np.zeros(n), np.zeros(n)
    if len(w.hash) > 1:
        pair = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
        same = np.bincount(text[1:][pair].astype(np.int64), minlength=n).astype(float)
    if len(w.hash) > 2:
        inside = text[2:] == text[:-2]
        owner = text[2:][inside]
        triples = np.bincount(owner.astype(np.int64), minlength=n).astype(float)
        triple_kinds = distinct(tb.gram_hashes(w.hash, 3)[inside], owner)
    letter_count = count["letter"]
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), _ratio(count["upper"], letter_count), _ratio(count["digit"], size),
        _ratio(count["mark"], size), _ratio(count["shout"], size), _ratio(count["symbol"], size), _ratio(letterless, words),
        _ratio(marked, words), _ratio(newline, words), _ratio(wide, letter_count), np.log1p(kinds) - np.log1p(words),
        _ratio(same, words), _ratio(triples - triple_kinds, triples),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of shrinkage covariances, and the logistic curve."""

    means: tuple
    factors: tuple  # lower triangles, or () if a class was never seen
    log_dets: tuple
    inverses: tuple  # of the factors, taken once, so that scoring a batch is two products
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        density = []
        for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets, strict=True):
            z = inverse @ (x - mean).T
            density.append(-0.5 * ((z * z).sum(axis=0) + log_det))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 0.5)
        z = np.clip(self.slope * np.clip(self.raw(x), -REACH, REACH) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def discriminant(sums: dict[int, tuple], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From (count, sum, sum of outer products) of each class."""
    if any(sums.get(k, (0,))[0] < 1 for k in (0, 1)):
        return Discriminant((), (), (), ())
    total = sum(sums[k][0] for k in (0, 1))
    pooled_mean = sum(sums[k][1] for k in (0, 1)) / total
    scale = np.maximum(np.diag(sum(sums[k][2] for k in (0, 1)) / total) - pooled_mean**2, 1e-6)
    means, factors, log_dets = [], [], []
    for k in (0, 1):
        n, s, ss = sums[k]
        mean = s / n
        cov = ss / n - np.outer(mean, mean)
        own = np.diag(np.maximum(np.diag(cov), 0))
        weight = min(1.0, shrinkage + len(mean) / (n + len(mean)))
        cov = (1 - weight) * cov + weight * own + np.diag(0.01 * scale)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(tuple(means), tuple(factors), tuple(log_dets), tuple(np.linalg.inv(f) for f in factors))


def logistic_curve(bins: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through counts of both labels by raw score (Newton steps, slightly ridged)."""
    b = np.array([0.0, np.log((ones.sum() + 1) / (zeros.sum() + 1))])
    x = np.column_stack([bins, np.ones_like(bins)])
    n = ones + zeros
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        gradient = x.T @ (ones - n * p) - 1e-3 * b
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 1.0
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats array<double>) of every document."""
    configured(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(run, "doc_id long, stats array<double>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "stats")


def _matrix(batch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame) -> Discriminant:
    """``rows``: (label 0 or 1, stats). Two passes of fixed-size partial sums."""
    width = len(STATISTICS)

    def sums(batches):
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x, y = _matrix(batch, "stats"), batch.column(batch.schema.get_field_index("label")).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total))], names=["label", "sums"])

    parts = rows.select("label", "stats").mapInArrow(sums, "label int, sums array<double>")
    places = parts.select("label", F.posexplode("sums").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((2, 1 + width + width * width))
    for r in places:
        total[r["label"], r["i"]] = r["x"]
    model = discriminant({k: (t[0], t[1 : 1 + width], t[1 + width :].reshape(width, width)) for k, t in enumerate(total)})
    if not model.factors:
        return model

    def histogram(batches):
        out = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("label")).to_numpy()
            at = np.clip(((model.raw(_matrix(batch, "stats")) + REACH) / (2 * REACH) * BINS).astype(int), 0, BINS - 1)
            for k in (0, 1):
                out[k] += np.bincount(at[y == k], minlength=BINS)
        k, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(out[k, at])], names=["label", "bin", "n"])

    counts = np.zeros((2, BINS))
    for r in rows.select("label", "stats").mapInArrow(histogram, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["bin"]] = r["n"]
    middle = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    slope, shift = logistic_curve(middle, counts[1], counts[0])
    return replace(model, slope=slope, shift=shift)


def fit_labelled(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the documents of ``stats`` that ``labels`` (doc_id, quality) marks and that are not held out."""
    marks = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = stats.where(~F.col("held_out")).join(marks, "doc_id").select("label", "stats")
    return fit(staged(rows, "quality-training"))


def scored(stats: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch, "stats"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept_by_quality(docs: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``, unchanged; one pass, no shuffle."""
    configured(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = model.score(statistics(batch.column(at))) >= cut
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = staged(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    return scored(stats, fit_labelled(stats, table(spark, sf_dir, "labels")))
