"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are documents marked good; the unlabelled set is drawn from all web text, and no mark of it is used.
To estimate the class prior, a first classifier of positives against unlabelled text is fitted on one half, and the
least ratio of the shares of the other half that score above a threshold bounds the prior from above. The model
minimises the non-negative unbiased risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-))  over features of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._frames import id_and_text, table

BINS = 1024
EXTRA = 8
#: Most documents marked good, and most unlabelled ones, that the fit looks at: the ones least by a hash of doc_id.
SAMPLE = 5_000
#: Rows whose features are made at once.
ROWS = 512
_PAIR = (t.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) >> np.uint64(54)).astype(np.int64)  # 1,024 bins


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: square roots of byte-pair shares in hashed bins, and shares of repeated and unlike words."""
    rows, n = len(offsets) - 1, len(buf)
    size = np.diff(offsets)
    out = np.zeros((rows, BINS + EXTRA), np.float32)
    if not n:
        return out
    row = np.repeat(np.arange(rows), size)
    pair = _PAIR[(buf[:-1].astype(np.int64) << 8) | buf[1:]]
    inside = row[:-1] == row[1:]
    counts = np.bincount((row[:-1] * BINS + pair)[inside], minlength=rows * BINS).reshape(rows, BINS)
    out[:, :BINS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    starts, ends, first = t.words(buf, offsets, t.BLANK_WORDS)
    if len(starts):
        h = t.span_hashes(buf, starts, ends)
        of = t.row_of(first, len(h))
        n_words = np.maximum(np.diff(first), 1)
        _, _, inverse, _ = t.distinct(h)
        distinct = np.bincount(np.unique(of * (inverse.max() + 1) + inverse) // (inverse.max() + 1), minlength=rows)
        length = (ends - starts).astype(np.float64)
        letters = ((buf | 32) - np.uint8(97) < 26) | (buf >= 128)
        upper = (buf >= 65) & (buf <= 90)
        byte_share = lambda mask: np.bincount(row[mask], minlength=rows) / np.maximum(size, 1)
        out[:, BINS] = distinct / n_words
        out[:, BINS + 1] = np.bincount(of, weights=length, minlength=rows) / n_words / 10
        out[:, BINS + 2] = byte_share(upper)
        out[:, BINS + 3] = byte_share(~letters & (buf > 32))
        out[:, BINS + 4] = byte_share(buf == 10) * 10
        out[:, BINS + 5] = np.log1p(np.diff(first)) / 10
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, BINS + 6] = np.sqrt(np.bincount(of, weights=again, minlength=rows) / n_words)
        out[:, BINS + 7] = 10 / (10 + np.diff(first))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An upper bound of the share of positives among the unlabelled, from the scores of both.

    The ratio of tails is at least the prior for every threshold; small tails are left out, and the bound of the
    remaining ones is widened by their sampling error.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p = np.maximum((positive[None, :] >= cuts[:, None]).mean(1), 1e-9)
    u = (unlabelled[None, :] >= cuts[:, None]).mean(1)
    slack = np.sqrt(np.maximum(u * (1 - u), 0.25 / len(unlabelled)) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(np.min((u + slack) / p), 0.05, 0.95))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 200, decay: float = 3e-3) -> Model:
    """Non-negative PU learning of a linear model with log loss, by full-batch Adam. prior None: estimate it."""
    both = np.concatenate([positive, unlabelled]).astype(np.float32)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(BINS + EXTRA), np.ones(BINS + EXTRA), np.zeros(BINS + EXTRA + 1), 0.5)
    mean, scale = both.mean(0), both.std(0) + np.float32(1e-2)
    add_one = lambda x: np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float32)
    p, u = add_one(positive), add_one(unlabelled)
    size = both.shape[1] + 1
    shrink = np.full(size, decay)
    shrink[-1] = 0

    if prior is None:
        p1, u1 = p[::2], u[::2]
        first = _adam(lambda w: p1.T @ (_sigmoid(p1 @ w) - 1) / len(p1) + u1.T @ _sigmoid(u1 @ w) / len(u1) + 10 * shrink * w, size, steps // 2)
        prior = class_prior(p[1::2] @ first, u[1::2] @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        w = w.astype(np.float32)
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        # a negative estimate of a risk that cannot be negative is overfitting: step back from it
        return (prior * (p.T @ (sp - 1)) / len(p) + down if negative >= 0 else -down) + shrink * w

    return Model(mean, scale, _adam(risk, size, steps), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose label the fit never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [x.astype(np.float16).tobytes() for _, _, buf, offsets in t.chunks(b.column("text"), rows=ROWS) for x in features(buf, offsets)]
        yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(rows, pa.binary())], ["positive", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` documents marked good and as many unlabelled ones, those least by a hash of their ids.

    The unlabelled are drawn from all documents outside the held-out fold, whether `labels` covers them or not, and no
    mark of theirs is looked at. Null labels, null ids, labels of absent documents and bad marks are ignored; a document
    with several marks is good if one says so, a repeated row counts as often as it occurs. With no good mark at all
    every score is one half.
    """
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    good = labels.where((F.col("quality") == 1) & usable).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # F.broadcast below: at most `sample` ids each
    first = lambda ids: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_and_text(docs)
    chosen = first(good).withColumn("positive", F.lit(True)).unionByName(first(rows.where(usable).select("doc_id")).distinct().withColumn("positive", F.lit(False)))
    found = rows.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(_feature_rows, "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, BINS + EXTRA)
    positive = found.column("positive").to_numpy().astype(bool)
    del found
    order = np.lexsort([*x.T[:8].astype(np.float32), positive])  # the fit does not depend on the order in which rows arrive
    x, positive = x[order].astype(np.float32), positive[order]
    return fit(x[positive], x[~positive])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per row of docs, repeated ones included; null and empty texts are scored as texts without
    features, null ids stay null, other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.scores(features(buf, offsets)) for _, _, buf, offsets in t.chunks(b.column("text"), rows=ROWS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose text scores at least `threshold` (a tie stays); all columns stay, repeated rows go or stay together."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.scores(features(buf, offsets)) for _, _, buf, offsets in t.chunks(b.column("text"), rows=ROWS)]
            yield b.filter(pa.array(np.concatenate(s) >= threshold)) if s else b

    typed = docs.withColumn("text", F.col("text").cast("string"))
    id_and_text(docs)
    return typed.mapInArrow(run, typed.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
