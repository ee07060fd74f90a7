"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network that
minimises the non-negative unbiased risk: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)).
A text is described by its hashed byte trigrams and by a few statistics of its words and lines. The class prior is estimated from labelled rows, or, without negatives
among them, from how a positive-versus-unlabelled model scores the positives it hasn't seen.

The model is fitted on a bounded sample, at most ``POSITIVES`` labelled and ``UNLABELLED``
other rows, chosen by a hash of the row; every row of the table is scored.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Step, append_columns, documents
from .language_id import held_out

POSITIVES, UNLABELLED, HIDDEN, EPOCHS, RATE, DECAY, SEED = 4000, 8000, 16, 400, 0.02, 1e-4, 7
#: Buckets of the trigrams' hash; bytes of a text that are hashed at once.
BUCKETS, _PIECE = 512, 1 << 20
#: Weight of a trigram's bucket beside a statistic: there are many, and each says little.
GRAM_WEIGHT = 0.05
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bars", "stops", "commas", "other",
    "symbol_ends", "repeats", "distinct", "short_words", "repeated_lines", "line_words", "long_words", "bangs", "top_word",
)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{}~"
_SYMBOL_END = re.compile(rb"[#$%&*+/<=>@\\^_`{}~|!]{2,}(?:\s|\Z)")
_WINDOW = 200


def features(text: str | None) -> list[float]:
    """What a text looks like, whatever its language; an empty or null text gives zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / size

    lines = [x for x in data.split(b"\n") if x.strip()]
    # distinct words and the share of the most common one change with length, so they are counted in windows of the whole text
    counts = [Counter(words[i : i + _WINDOW]) for i in range(0, n, _WINDOW)]
    windows = [len(c) / min(_WINDOW, n - i * _WINDOW) for i, c in enumerate(counts)]
    lengths = list(map(len, words))
    return [
        float(np.log1p(n)), min(sum(lengths) / n, 30.0), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(b"|"), share(b"."), share(b",;:"), share(bytes(range(128, 256))),
        len(_SYMBOL_END.findall(data)) / n, sum(map(operator.eq, words, words[1:])) / n, sum(windows) / len(windows), sum(x <= 3 for x in lengths) / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), sum(x > 14 for x in lengths) / n, share(b"!"), sum(max(c.values()) for c in counts) / n,
    ]


def trigrams(text: str | None) -> np.ndarray:
    """The square root of each bucket's share of the trigrams of a text, all of them; zeros below three bytes."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS)
    for at in range(0, len(data) - 2, _PIECE):
        a = data[at : at + _PIECE + 2].astype(np.uint32)
        h = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        out += np.bincount(h, minlength=BUCKETS)
    return np.sqrt(out / max(1, len(data) - 2))


def described(text: str | None) -> np.ndarray:
    return np.concatenate([features(text), trigrams(text)]).astype(np.float32)


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _fit(x: np.ndarray, gradient, seed: int = SEED) -> Network:
    """Adam on the loss whose derivative by the margins is ``gradient(margins)``."""
    rng = np.random.default_rng(seed)
    n = len(FEATURES)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale[n:] /= GRAM_WEIGHT
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    w = [rng.normal(0, 1 / np.sqrt(min(n, z.shape[1])), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    w[0][n:] = 0
    w = [p.astype(np.float32) for p in w]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(z @ w[0] + w[1])
        g = gradient(h @ w[2] + w[3])
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * w[0], back.sum(axis=0), h.T @ g + DECAY * w[2], np.array([g.sum()])]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, w)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risks(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of positives, and the unbiased estimate of that of negatives (which can fall below zero), by the margins of trusted positives and unlabelled rows."""
    return prior * np.logaddexp(0, -p).mean(), np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()


def risk_gradient(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The direction of a step: the gradient of both risks, or, where that of negatives is below zero, against its own."""
    minus_p, minus_u = -prior * _sigmoid(p) / len(p), _sigmoid(u) / len(u)
    if risks(p, u, prior)[1] >= 0:
        return np.concatenate([prior * (_sigmoid(p) - 1) / len(p) + minus_p, minus_u])
    return np.concatenate([-minus_p, -minus_u])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative risk with the logistic loss.

    Where the estimated risk of negatives falls below zero, the step goes against it, as the method has it.
    """
    n_p = len(positive)
    return _fit(np.concatenate([positive, unlabelled]), lambda margin: risk_gradient(margin[:n_p], margin[n_p:], prior))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_negative: int) -> float:
    """The share of label 1: among labelled rows if they have both labels, else by the mean score of unseen positives."""
    if n_negative:
        return min(0.99, max(0.01, n_positive / (n_positive + n_negative)))
    half = len(positive) // 2
    if not half:
        return 0.5
    x = np.concatenate([positive[:half], unlabelled])
    y = np.concatenate([np.ones(half), np.zeros(len(unlabelled))])
    plain = _fit(x, lambda m: (_sigmoid(m) - y) / len(y))
    labelled = plain.score(positive[half:]).mean()  # P(labelled | positive)
    share = half / (half + len(unlabelled))
    return float(min(0.99, max(0.01, (plain.score(unlabelled).mean() / labelled - share) / (1 - share))))


_FIELD = [T.StructField("_x", T.BinaryType())]


def _features():
    def step(texts):
        return [pa.array([described(t.as_py()).tobytes() for t in texts], pa.binary())]

    return step


def _some(df: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """More than ``most`` of ``n`` rows (all, if there are no more), by a hash of the whole row."""
    u = F.shiftrightunsigned(F.xxhash64(*df.columns, F.lit(salt)), 12) / float(1 << 52)
    return df.where(u < 1.2 * most / n + 50 / n) if n > most else df


def _collected(df: DataFrame, most: int) -> np.ndarray | None:
    """The features of at most ``most`` rows of ``df`` (doc_id, text): those with the smallest hashes, however often an id or a row is repeated."""
    described_ = append_columns(df.withColumn("_h", F.xxhash64("doc_id", "text")), Step(["text"], _FIELD, _features), drop=("text",))
    rows = described_.orderBy("_h", "doc_id", "_x").limit(most).select("_x").collect()
    return np.stack([np.frombuffer(r["_x"], np.float32) for r in rows]) if rows else None


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The model from texts and labels of rows that aren't held out; None without a trusted positive or an unlabelled row.

    At most POSITIVES and UNLABELLED rows reach the driver, as features.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    sizes = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    # the ids are bounded by the sample, and so is what the join sends out
    ids = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    p = _collected(docs.join(F.broadcast(ids), "doc_id", "left_semi"), POSITIVES)
    u = _collected(_some(docs, docs.count(), UNLABELLED, 2), UNLABELLED)
    if p is None or u is None:
        return None
    return fit_pu(p, u, estimate_prior(p, u, n_pos, n_neg))


def score(docs: DataFrame, model: Network | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= THRESHOLD).

    Null and empty texts are scored like texts without words; each row is scored alone, repeated or not; an empty table gives an empty one. Without a model every score is 0.5.
    Columns of ``docs`` with those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        net = shared.value

        def step(texts):
            if net:
                s = net.score(np.stack([described(t.as_py()) for t in texts])).astype(np.float64) if len(texts) else np.zeros(0)
            else:
                s = np.full(len(texts), 0.5)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return step

    return append_columns(docs, Step(["text"], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
