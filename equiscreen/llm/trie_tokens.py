"""Token counts by a unigram model over a trie of pre-tokens.

The distinct pre-tokens of a batch stand in a trie.  Level by level, the best score of each prefix is computed
once, from the best scores of its beginnings and the pieces that end there, for all prefixes of that length at
once; pre-tokens keep the count and score of their last prefix.  A document's count is the sum over its pre-tokens.

Scores: the pieces of a public vocabulary in their order, by Zipf's law; nothing is trained.  A character
that no piece covers counts as its UTF-8 bytes.  Of equal scores the fewer tokens win.

Scale: one map over the documents, no shuffle; a task remembers at most ``MEMO`` pre-tokens.

Defined results: null, empty and white texts have no tokens; very long pre-tokens are split like any other;
repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a task remembers, and the length up to which they share a trie.
MEMO, LONG = 1_000_000, 48
_BASE = 0x9E3779B97F4A7C15
MARK = "▁"


class Pieces:
    """The vocabulary: log-probabilities by piece, and tables of hashes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        rank = np.arange(1, len(names) + 1)
        score = -np.log(rank) - np.log((1 / rank).sum())
        self.score = {p: float(s) for p, s in zip(names, score, strict=True)}
        self.byte = float(score.min()) - 2.0
        self.longest = max(map(len, names))
        self.tables = {}
        for n in range(1, self.longest + 1):
            if some := [p for p in names if len(p) == n]:
                h = np.zeros(len(some), np.uint64)
                for c in np.array(some, f"U{n}").view(np.uint32).reshape(-1, n).T:
                    h = h * np.uint64(_BASE) + c
                order = np.argsort(h)
                self.tables[n] = h[order], np.array([self.score[p] for p in some])[order]

    def one(self, token: str) -> tuple[int, float]:
        """Count and score of one pre-token, without a trie."""
        best = [(0.0, 0)]
        for i in range(1, len(token) + 1):
            size = len(token[i - 1].encode("utf-8", "surrogatepass"))
            found = [(best[i - 1][0] + self.byte * size, best[i - 1][1] - size)]
            for n in range(1, min(self.longest, i) + 1):
                if (s := self.score.get(token[i - n : i])) is not None:
                    found.append((best[i - n][0] + s, best[i - n][1] - 1))
            best.append(max(found))
        return -best[-1][1], best[-1][0]

    def all(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Count and score of each of the sorted, distinct, non-empty ``tokens`` of at most LONG characters."""
        size = np.array(list(map(len, tokens)))
        longest = int(size.max())
        text = np.array(tokens, f"U{longest}").view(np.uint32).reshape(-1, longest)
        rows = len(tokens)
        counts, scores = np.zeros(rows, np.int64), np.zeros(rows)
        differs = np.zeros(rows, bool)
        differs[0] = True
        node = [np.zeros(rows, np.int32)]  # of each length, the node that a token's beginning has
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1), np.zeros(1, np.int64))]
        sums = [np.zeros(rows, np.uint64)]
        for d in range(1, longest + 1):
            c = text[:, d - 1]
            differs = differs | np.concatenate([[True], c[1:] != c[:-1]])
            alive = size >= d
            first = np.flatnonzero(differs & alive)  # a prefix is computed where it comes first
            sums.append(sums[-1] * np.uint64(_BASE) + c)
            node.append((np.cumsum(differs & alive) - 1).astype(np.int32))
            code = c[first]
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            up = node[d - 1][first]
            top, few = best[d - 1][0][up] + self.byte * width, best[d - 1][1][up] + width
            for n, (hashes, value) in self.tables.items():
                if n > d:
                    break
                h = sums[d][first] - sums[d - n][first] * np.uint64(pow(_BASE, n, 1 << 64))
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                up = node[d - n][first[hit]]
                s, k = best[d - n][0][up] + value[at[hit]], best[d - n][1][up] + 1
                wins = (s > top[hit]) | ((s == top[hit]) & (k < few[hit]))
                top[hit[wins]], few[hit[wins]] = s[wins], k[wins]
            best.append((top, few))
            ends = np.flatnonzero(size == d)
            counts[ends], scores[ends] = few[node[d][ends]], top[node[d][ends]]
        return list(zip(counts.tolist(), scores.tolist(), strict=True))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score for every row of ``docs``.  Pre-tokens are what white space separates, each with the mark of a word's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        memo: dict[str, tuple[int, float]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                words = [(t or "").split() for t in b.column("text").to_pylist()]
                if len(memo) > MEMO:
                    memo.clear()
                new = set().union(*words) - memo.keys()
                short = sorted(w for w in new if len(w) < LONG)
                for lo, hi in ((0, 12), (12, LONG)):  # wide rows only for long pre-tokens
                    if some := [w for w in short if lo <= len(w) < hi]:
                        memo.update(zip(some, pieces.all([MARK + w for w in some]), strict=True))
                memo.update((w, pieces.one(MARK + w)) for w in new if len(w) >= LONG)
                found = [[memo[w] for w in ws] for ws in words]
                cols = [pa.array([len(f) for f in found], pa.int64()), pa.array([sum(k for k, _ in f) for f in found], pa.int64()), pa.array([float(sum(s for _, s in f)) for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
