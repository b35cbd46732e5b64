"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of every document.

Words are runs of ASCII digits and letters (A-Z lowered) and of everything beyond ASCII.  A window is
``n`` consecutive words of an item; an item with fewer words, but not none, is one window.  A document word
inside any occurrence of a window is hit.  Hash hits are verified word by word.

Scale: one map over the documents, no shuffle.  The items are taken in blocks of ``block_words`` words, so
what is broadcast at once has a fixed bound; with more blocks the documents are passed once a block and the
hits of a document are merged.

Defined results: null or wordless text has no words and no hits; an empty benchmark hits nothing; equal items
count as often as their distinct ids; null item texts have no windows; items without an id hit as others do and are not among the items named; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import materialise, small_batches, tidy

#: Item words in one broadcast block (about 100 bytes each with their windows).
BLOCK_WORDS = 1_000_000
#: Lowers A-Z; what separates words becomes a space.
TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Windows:
    """The windows of one block of items, by length."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not ids:
                continue
            m = min(n, len(ids))
            windows = self.by_length.setdefault(m, {})
            for i in range(len(ids) - m + 1):
                of = windows.setdefault(tuple(ids[i : i + m]), set())
                if item is not None:
                    of.add(item)
        self.hashes = {m: np.unique(self._rolled(np.array(list(w), dtype=np.uint64).reshape(-1, m), m)) for m, w in self.by_length.items()}

    @staticmethod
    def _rolled(rows: np.ndarray, m: int) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(m):
            h = h * _P + rows[:, j]
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for m, windows in self.by_length.items():
            if len(words) < m:
                continue
            starts = np.flatnonzero(known[m:] - known[:-m] == m)  # windows of known words only
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(m):
                h = h * _P + ids[starts + j]
            for s in starts[np.isin(h, self.hashes[m])].tolist():
                if (items := windows.get(tuple(ids[s : s + m].tolist()))) is not None:
                    hit[s : s + m] = True
                    found |= items
        return hit, found


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").toLocalIterator():
        block.append((r["i"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS = ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())]))
FOUND = [StructField("__n_words", LongType()), StructField("__spans", SPANS), StructField("__items", ArrayType(StringType()))]


def _match(docs: DataFrame, items: list[tuple[str | None, str]], n: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with the number of its words, spans of hit words [a, b), items."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(items)
    spans_kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(held.value, n)
        for b in batches:
            n_words, spans, found = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                hit, items = w.hits(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                n_words.append(len(words))
                spans.append([{"a": a, "b": e} for a, e in zip(edge[::2], edge[1::2], strict=True)])
                found.append(sorted(items))
            cols = [*(b.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(spans, spans_kind), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "__n_words", "__spans", "__items"])

    return docs.select(*{"text": 0} | dict.fromkeys(keep)).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *FOUND]))


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans as one; ``spans`` is an array of arrays of them."""
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["b"] >= x["a"], grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.flatten(spans)), empty, add)


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with __n_words, __spans (hit words [a, b)), __items.

    With more than one block of items the rows are written once, so that __uid names the same row in every pass.
    """
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _match(docs, first, n, keep)
    docs = materialise(docs.withColumn("__uid", F.monotonically_increasing_id()), "decontaminate-docs")
    found = _match(docs, first, n, ["__uid"]).unionByName(_match(docs, second, n, ["__uid"]))
    for block in blocks:
        found = found.unionByName(_match(docs, block, n, ["__uid"]))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items"))))
    found = found.groupBy("__uid").agg(F.max("__n_words").alias("__n_words"), _merged(F.collect_list("__spans")).alias("__spans"), items.alias("__items"))
    return docs.select("__uid", *keep).join(found, "__uid").drop("__uid")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], n, block_words)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit words' spans; documents of which more than ``max_share`` of the words are hit go.

    A span runs from the first byte of its first word to the first byte of the word after it.  Documents
    without hits stay byte for byte, and all columns stay, of any name.
    """
    names, at = docs.columns, docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, own = b.column("__n_words").to_pylist(), b.column("__spans").to_pylist(), b.column("row").flatten()
            keep = [sum(x["b"] - x["a"] for x in s) <= max_share * k for s, k in zip(spans, n_words, strict=True)]
            texts = [cut_words(t, [(x["a"], x["b"]) for x in s]) if s else t for t, s in zip(own[at].to_pylist(), spans, strict=True)]
            own[at] = pa.array(texts, own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=names).filter(pa.array(keep, pa.bool_()))

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # so that no column of theirs can clash
    return hits(docs.select("text", row), benchmark, ["row"], n, block_words).mapInArrow(run, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])).tolist() + [len(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]])
        at = start[b]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
