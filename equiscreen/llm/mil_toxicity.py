"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's probability is a logistic model of the words it has.  A document's is the noisy-or of its
sentences, 1 - prod(1 - p).  Only document labels are known, and the weights are trained through the noisy-or.

Scale: words are hashed in one map over whole texts.  The fit sees the words of at most ``max_labelled``
labelled rows, picked by a hash of the id, however many rows share one; a few thousand weights go back to the map that scores and locates.

Defined results: null, empty and wordless texts have no sentences and score 0; without labels every score
is 0; repeated rows are scored one by one, an id with several labels counts as toxic if most of them say so;
very long texts are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen_rows, id_crc, materialise

#: Bound of the fit's sample of documents; how many of them a word must be in, and how many standard errors
#: its share among toxic ones must lie from its share among all, to have a weight.
MAX_LABELLED, MIN_DOCS, MIN_Z = 10_000, 6, 4.5
#: The most features that get a weight, by that distance, and the lengths in bytes of beginnings that are features.
MAX_FEATURES, PREFIXES = 4_000, (4, 5, 6, 7, 8)
#: The bias of a model without labels.
NEVER = -30.0
#: A document, or a sentence when it is located, is toxic from this score on.
THRESHOLD = 0.7
SENTENCE = re.compile(rb"[^.!?\n]+(?:[.!?]+|\n|$)?")
WORD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def parts_of(word: bytes) -> list[bytes]:
    """A word's features: itself and its beginnings, so that inflected forms share weights."""
    return [word, *(word[:n] + b"-" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)  # by feature
    bias: float = NEVER

    def table(self) -> Weights:
        return Weights(self.weights)


class Weights(dict):
    """A word's weight: the sum of its features' weights, kept once it has been asked for."""

    def __init__(self, by_feature: dict[bytes, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, word: bytes) -> float:
        if len(self) > 1_000_000:
            self.clear()
        w = self[word] = sum(self.by_feature.get(p, 0.0) for p in parts_of(word))
        return w


def sentences(text: str | None) -> list[bytes]:
    """The sentences that have words, as UTF-8."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [s for s in SENTENCE.findall(raw) if s.translate(WORD).strip()]


def sentence_scores(found: list[bytes], weights: Weights, bias: float) -> np.ndarray:
    f = [bias + sum(map(weights.__getitem__, set(s.translate(WORD).split()))) for s in found]
    f = np.array(f, float)
    return np.where(f <= NEVER, 0.0, 1 / (1 + np.exp(-np.clip(f, -30, 30))))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def fit(y: np.ndarray, owner: np.ndarray, sents: np.ndarray, features: np.ndarray, size: int, steps: int = 300, rate: float = 0.1, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias.  ``owner``: each sentence's document; ``sents`` and ``features``: which sentence has which feature."""
    n, base = len(y), len(owner)
    w, b = np.zeros(size), -5.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        f = np.clip(b + np.bincount(sents, w[features], minlength=base), -30, 30)
        p = 1 / (1 + np.exp(-f))
        none = np.bincount(owner, -np.logaddexp(0, f), minlength=n)  # log of the chance that no sentence is toxic
        some = np.maximum(-np.expm1(none), 1e-9)
        # the loss's slope by f of a sentence: p where the label is 0, else -p * (1 - P) / P
        g = np.where(y[owner] > 0, -p * np.exp(none[owner]) / some[owner], p) / n
        grad = np.append(np.bincount(features, g[sents], minlength=size) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, fold: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """``fold``: which ids may be learned from.

    Features are chosen by counts over the sample's documents; only the chosen ones' places come to the driver.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    chosen = marked.where(fold).orderBy(F.xxhash64(F.lit("mil"), "doc_id")).limit(max_labelled)
    sample = materialise(chosen_rows(docs, chosen, max_labelled).join(F.broadcast(chosen), "doc_id").select("y", "text"), "toxicity-sample")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({p for s in sentences(t) for w in s.translate(WORD).split() for p in parts_of(w)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(found, pa.list_(pa.binary()))], names=["y", "features"])

    total = sample.agg(F.count("y").alias("n"), F.sum("y").alias("y")).first()
    if not total["n"] or not total["y"]:
        return Model()
    rate = total["y"] / total["n"]
    z = F.abs(F.col("y") - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
    counts = sample.mapInArrow(distinct, "y int, features array<binary>").select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    best = counts.where((F.col("n") >= MIN_DOCS) & (z >= MIN_Z)).orderBy(z.desc(), "feature").limit(MAX_FEATURES).collect()
    at = {bytes(r["feature"]): i for i, r in enumerate(best)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = sentences(t)
                pairs = [(i, j) for i, s in enumerate(found) for j in {at[p] for w in s.translate(WORD).split() for p in parts_of(w) if p in at}]
                rows.append({"y": y, "n": len(found), "sents": [i for i, _ in pairs], "features": [j for _, j in pairs]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("y", pa.int32()), ("n", pa.int64()), ("sents", pa.list_(pa.int64())), ("features", pa.list_(pa.int64()))]))

    got = sample.mapInArrow(places, "y int, n long, sents array<bigint>, features array<bigint>").toArrow()
    n = np.array(got.column("n"))
    base = np.cumsum(n) - n
    sents = np.concatenate([np.array(s.values, np.int64) + o for s, o in zip(got.column("sents"), base, strict=True)])
    features = np.concatenate([np.array(f.values, np.int64) for f in got.column("features")])
    w, bias = fit(np.array(got.column("y"), dtype=float), np.repeat(np.arange(len(n)), n), sents, features, len(at))
    return Model({p: float(w[i]) for p, i in at.items()}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, worst_sentence (its number, null if there is none) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for b in batches:
            got = [sentence_scores(sentences(t), weights, model.bias) for t in b.column("text").to_pylist()]
            worst = [int(p.argmax()) if len(p) else None for p in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([noisy_or(p) for p in got], pa.float64()), pa.array(worst, pa.int32())], names=["doc_id", "score", "worst_sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_sentence int")


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (its number), score, text of every offending sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = sentences(t)
                p = sentence_scores(found, weights, model.bias)
                rows += [{"doc_id": d, "sentence": i, "score": float(p[i]), "text": found[i].decode("utf-8", "replace").strip()} for i in np.flatnonzero(p >= threshold).tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence int, score double, text string")


def training_fold() -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is not 1."""
    return id_crc() % 3 != 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence for every row of ``docs``."""
    scored = score(docs, train(docs, labels, training_fold()))
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence")
