"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is only unlabelled web text, so negatives are
never shown to the model.  The class prior (the share of good text in the unlabelled) is estimated from the
scores of a first model that tells positives from unlabelled text: in the set of scores above any threshold
the unlabelled share cannot be less than prior times the positives' share, so the least ratio, with a
margin for chance, is the prior.  The second model then minimises the non-negative unbiased risk

    prior * E_p[l(f)]  +  max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with the logistic loss: where the second term falls below zero, steps go against it.

Scale: features are computed in one map over whole texts.  The fit sees at most ``max_positive`` and
``max_unlabelled`` rows, picked by a hash of the id, however many rows share one; a few hundred weights go back to the map that scores.

Defined results: null text counts as empty; empty texts get the score of their features, between 0 and 1;
without any positives every score is 0.5; repeated rows are scored one by one, an id with several labels counts
as positive if most of them are; very long texts are read whole; an empty table gives an empty result; other
columns, of any name, are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chosen_rows, id_crc, small_batches, tidy

#: Bounds of the fit's sample.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 12_000
#: A document is good from this score on.
THRESHOLD = 0.3
SHAPES = 17


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the 256 byte values, then the text's shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(256 + SHAPES, np.float32)
    n = len(raw)
    if not n:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n)
    words, lines = raw.split(), raw.split(b"\n")
    k = len(words)
    out[256:258] = np.log1p(n) / 10, np.log1p(k) / 10
    if k:
        sizes = np.fromiter(map(len, words), np.int64, k)
        out[258:265] = (
            sizes.mean() / 10, min(sizes.std() / 10, 5), len(set(words)) / k, sum(map(bytes.isupper, words)) / k,
            sum(1 for w in words if not (w[-1:].isalnum() or w[-1] > 127)) / k, (sizes == 1).mean(), min(int(sizes.max()), 200) / 100,
        )
    out[265:269] = len(set(lines)) / len(lines), min(len(lines) / (k + 1), 1), np.log1p(n / len(lines)) / 10, sum(1 for x in lines if len(x) < 20) / len(lines)
    out[270:273] = sum(a == b for a, b in zip(words, words[1:])) / (k + 1), len(set(zip(words, words[1:]))) / (k + 1), min(k, 8) / 8
    out[269] = Counter(lines).most_common(1)[0][1] / len(lines)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        f = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to zero, so that steps against the clamp settle."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """The least ratio of shares above a threshold, by scores of positives ``p`` and unlabelled ``u``."""
    cut = np.unique(np.quantile(p, np.linspace(0.02, 0.98, 97)))
    above_p, above_u = (p[:, None] >= cut).mean(0), (u[:, None] >= cut).mean(0)
    margin = np.sqrt(np.log(2 / delta) / (2 * len(u))) + np.sqrt(np.log(2 / delta) / (2 * len(p)))
    best = int(((above_u + margin) / np.maximum(above_p, 1e-9)).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights ``w`` with logistic loss, and the direction of its descent: where the part of the
    negatives, estimated as the unlabelled less the prior's share of positives, falls below 0, that part counts as 0 and the step goes back up it."""
    fp, fu = p @ w, u @ w
    rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    pull = -prior * (p.T @ _sigmoid(-fp)) / len(p)
    push = (u.T @ _sigmoid(fu)) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
    return prior * np.logaddexp(0, -fp).mean() + max(0.0, rest), (pull + push) if rest >= 0 else -push


def fit(p: np.ndarray, u: np.ndarray, steps: int = 600, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """``p`` and ``u``: features of positive and unlabelled documents."""
    size = p.shape[1] if p.ndim == 2 else 256 + SHAPES
    if not len(p) or not len(u):
        return Model(np.zeros(size), np.ones(size), np.zeros(size + 1), 0.5)
    mean, scale = u.mean(0), np.maximum(u.std(0), 0.02)
    one = lambda x: np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    p, u = one(p.astype(float)), one(u.astype(float))
    odd = lambda x: (x[::2], x[1::2]) if len(x) > 3 else (x, x)
    (p1, p2), (u1, u2) = odd(p), odd(u)
    half = lambda w: (u1.T @ _sigmoid(u1 @ w) / len(u1) - p1.T @ _sigmoid(-(p1 @ w)) / len(p1)) / 2 + ridge * w
    first = _descend(half, size + 1, steps // 2, rate)
    prior = estimate_prior(p2 @ first, u2 @ first)

    gradient = lambda w: risk_gradient(w, p, u, prior)[1] + ridge * w
    return Model(mean, scale, _descend(gradient, size + 1, steps, rate), prior)


def _featurised(docs: DataFrame) -> np.ndarray:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.float32()))], names=["x"])

    found = docs.select("text").mapInArrow(run, "x array<float>").toArrow()  # at most as many rows as the fit's bounds say
    return np.array(found.column("x").combine_chunks().flatten(), np.float32).reshape(-1, 256 + SHAPES)


def train(docs: DataFrame, labels: DataFrame, fold: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """``fold``: which ids may be learned from."""
    small_batches(docs.sparkSession)
    pick = F.xxhash64(F.lit("pu"), "doc_id")
    good = labels.groupBy("doc_id").agg(F.avg("quality").alias("q")).where(fold & F.col("doc_id").isNotNull() & (F.col("q") >= 0.5)).orderBy(pick).limit(max_positive).select("doc_id")
    web = docs.select("doc_id").where(fold & F.col("doc_id").isNotNull()).distinct().orderBy(pick).limit(max_unlabelled)
    return fit(*(_featurised(chosen_rows(docs, ids, most)) for ids, most in ((good, max_positive), (web, max_unlabelled))))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and, last, its score, as __score."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                s = model.score(np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, 256 + SHAPES))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "__score"])

    columns = list({"text": 0} | dict.fromkeys(keep))
    kept = [docs.schema[c] for c in keep]
    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, StructType([*kept, StructField("__score", DoubleType())]))


def training_fold() -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is not 0."""
    return id_crc() % 5 != 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, labels, training_fold()), ["doc_id"])
    return scored.select("doc_id", (~training_fold()).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are."""
    model = train(docs, labels, training_fold())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of theirs can clash
    return score(docs.select("text", row), model, ["row"]).where(F.col("__score") >= threshold).select("row.*")
