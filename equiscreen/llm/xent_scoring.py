"""Cross-entropy difference of matched n-gram models.

Two models of the same order, smoothing and vocabulary, one of a target corpus and one of the background, say
how many nats each token of a document costs; the difference of the two, per token, is the document's
score: the lower, the more it looks like the target.  Tokens are words (split at white space, A-Z lowered) and an end
token; the vocabulary are all words of all documents.  The models are bigrams with ``ADD`` added to each count:

    p(w | v) = (count(v w) + ADD) / (count(v) + ADD * V)

so the cost of a document is a sum over its distinct bigrams plus one over its distinct contexts.

Scale: all documents are counted, and what is counted grows with them: words first, for V, then each document's bigrams
and contexts with their times, once.  These are dealt by the gram, so that the task that counts one has all its
occurrences and can say at once what it costs in each document; sums for documents go back by batch of documents.
Neither words nor counts come to the driver; only V does.  A gram has one entry a document, 10 bytes, whatever it is.
Texts are not shuffled unless the target's ids are too many to broadcast.

Defined results: null text is empty and has its end token only; very long texts count whole; repeated rows are counted and scored one
by one; an empty table gives no rows; without a target corpus its model is uniform; a null id is never in the target;
a document that is labelled more than once is in the target if most of its labels are 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast
from .jaccard_join import _TURN, WordHashes, _mixed, words_of

#: What is added to each count of a bigram.
ADD = 0.1
#: Documents in a batch; their places and twice these fit a short.
BATCH = 2000
_START, _END = np.array([0x243F6A8885A308D3], np.uint64), np.array([0x13198A2E03707344], np.uint64)


def grams_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's bigrams (lowest bit 1) and of their contexts (lowest bit 0), one of each for each token."""
    chain = np.concatenate([_START, hashes.of(words_of(text)), _END])
    one = np.uint64(1)
    pairs = _mixed(chain[:-1] * _TURN[0] + chain[1:] * _TURN[1])
    return np.concatenate([pairs | one, _mixed(chain[:-1] ^ _TURN[2]) & ~one])


def vocabulary_size(docs: DataFrame) -> int:
    """The number of distinct words of all documents, and one for the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                found = [hashes.of(words_of(t)) for t in whole.column("text").slice(at, BATCH).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["word"])

    return docs.select("text").mapInArrow(run, "word long").distinct().count() + 1


def word_scores(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference for every row of ``docs``, by word bigrams."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = vocabulary_size(docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(target_ids.withColumn("target", F.lit(True))), "doc_id", "left")
    names = ["p", "batch", "grams", "places", "times", "ids"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, batch = WordHashes(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                grams, places, times, tokens = [], [], [], []
                for i, (t, y) in enumerate(zip(b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True)):
                    all_grams = grams_of(t, hashes)
                    g, n = np.unique(all_grams, return_counts=True)
                    grams.append(g)
                    times.append(n)
                    places.append(np.full(len(g), 2 * i + bool(y), np.int16))
                    tokens.append(len(all_grams) // 2)
                g, d, n = np.concatenate(grams), np.concatenate(places), np.concatenate(times).astype(np.int32)
                p = ((g >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(p, kind="stable")
                g, d, n, p = g[order].view(np.int64), d[order], n[order], p[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x))
                k = len(cut) - 1
                yield pa.RecordBatch.from_arrays([pa.array(p[cut[:-1]]), pa.array([batch] * k, pa.int64()), lists(g), lists(d), lists(n), pa.nulls(k, pa.list_(pa.int64()))], names=names)
                empty = lambda kind: pa.array([None], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - batch % buckets], pa.int32()), pa.array([batch], pa.int64()), empty(pa.int64()), empty(pa.int16()), pa.array([tokens], pa.list_(pa.int32())), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64()))], names=names,
                )
                batch += 1

    sums = ["batch", "places", "target", "background", "times", "ids"]

    def summed(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, at = np.unique(key, return_inverse=True)
        return one, np.bincount(at, x, len(one)), np.bincount(at, y, len(one))

    def cost(grams: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the grams of a bucket add to each document; the lowest bit of ``key`` says who is in the target."""
        one, at = np.unique(grams, return_inverse=True)
        in_target = (key & 1).astype(bool)
        both = []
        for side in (in_target, ~in_target):
            count = np.bincount(at, times * side, len(one))
            both.append(np.where(one & 1, -np.log(count + ADD), np.log(count + ADD * size))[at] * times)
        return summed(key >> 1, *both)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []
        known: dict[int, int] = {}
        for b in batches:
            for i, (p, batch) in enumerate(zip(b.column("p").to_pylist(), b.column("batch").to_pylist(), strict=True)):
                if p < 0:
                    yield pa.RecordBatch.from_arrays([b.column("batch").slice(i, 1), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.list_(pa.float64())), b.column("times").slice(i, 1), b.column("ids").slice(i, 1)], names=sums)
                    continue
                if held and p != at:
                    done.append(cost(*map(np.concatenate, zip(*held, strict=True))))
                    held = []
                at = p
                g, d, n = (np.array(b.column(c).slice(i, 1).flatten()) for c in ("grams", "places", "times"))
                held.append((g, d.astype(np.int64) + 2 * BATCH * known.setdefault(batch, len(known)), n))
        if held:
            done.append(cost(*map(np.concatenate, zip(*held, strict=True))))
        if not done:
            return
        key, x, y = summed(*map(np.concatenate, zip(*done, strict=True)))
        ids, which = np.array(list(known), np.int64), key // BATCH
        cut = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(key)]])
        lists = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v))
        k = len(cut) - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[which[cut[:-1]]]), lists((key % BATCH).astype(np.int16)), lists(x), lists(y), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))], names=sums)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            x, y = total[:, : len(n)] / n
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(x), pa.array(y), pa.array(x - y)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

        at, ids, n, total = None, None, None, None
        for b in batches:
            for i, batch in enumerate(b.column("batch").to_pylist()):
                if batch != at:
                    if at is not None:
                        yield rows(ids, n, total)
                    at, total = batch, np.zeros((2, BATCH))
                part = b.slice(i, 1)
                if part.column("ids").null_count == 0:
                    ids, n = part.column("ids").flatten(), np.array(part.column("times").flatten())
                else:
                    d = np.array(part.column("places").flatten())
                    total[0, d] += np.array(part.column("target").flatten())
                    total[1, d] += np.array(part.column("background").flatten())
        if at is not None:
            yield rows(ids, n, total)

    dealt = marked.select("doc_id", "text", "target").mapInArrow(emit, "p int, batch long, grams array<bigint>, places array<smallint>, times array<int>, ids array<bigint>")
    met = dealt.repartition("p").sortWithinPartitions("p").mapInArrow(meet, "batch long, places array<smallint>, target array<double>, background array<double>, times array<int>, ids array<bigint>")
    return met.repartition("batch").sortWithinPartitions("batch").mapInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents, the target being those that ``labels`` marks as good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q >= 0.5").select("doc_id")
    return word_scores(docs, good)
