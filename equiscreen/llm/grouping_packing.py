"""Packing tokenised documents into sequences by linear grouping.

A document longer than a sequence is cut so that all its pieces but the first are full.  Full pieces are
sequences of their own.  For the others, lengths are integers below the sequence length, so a histogram with
a bounded number of bins says all that matters:

1. Large lengths are sorted and split into ``groups`` groups of equal cardinality; each length counts as the
   largest of its group.
2. For these few sizes the configuration problem is solved: column generation over knapsacks gives
   fractional counts, whole parts of which are used; what is left is filled greedily, fullest first.
3. Actual documents take the places of their group, so their real, smaller lengths leave more room.
4. Small documents go best fit, longest first, into the rooms left and then into new sequences.

Scale: the plan is made from at most ``capacity`` counts and says which ranks of a length go to which run of
sequences.  Pieces are ranked in windows of (length, salt), so that a length that a third of all rows share
is split, into more parts the more pieces have it, and look their place up in the plan; it is of bounded size too.

Defined results: null text is the empty text and has only the end token; repeated rows are packed one by one;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, maybe_broadcast, small_batches, tidy

#: Parts into which the ranks of one length are split: so many, and more where one would hold more than PART pieces.
SALTS, PART = 64, 100_000
#: What a sequence holds; where small lengths end, as shares of it (the plan with fewer sequences is used); the number of groups.
CAPACITY, SMALL, GROUPS = 1024, (0.4, 0.5), 96
#: White space in runs from twice this on is left to the tokenizer itself.
STRIDE = 500
BLANKS, RUN = re.compile(r"\s\s"), re.compile(r"\s{%d}" % (2 * STRIDE))


class Encoder:
    """Token ids, as little-endian uint32, of whole texts.

    ``ranks`` is the vocabulary of ``path`` as merge ranks: a byte-level BPE gives the same ids by them, in less time.
    Texts that hold a special token, and those with a run of white space long enough to exhaust the ranks'
    pattern matcher, are encoded by ``path``, which a task reads when it meets the first of them.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.fast, self.slow = path, None, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                self.special = [t["content"] for t in json.load(f)["added_tokens"]]
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            del table
        give_back()  # what reading the vocabularies took

    @property
    def tokenizer(self):
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def ids(self, text: str) -> bytes:
        # of a run of twice STRIDE, two neighbours among each STRIDE-th character are white space
        if self.fast is None or any(t in text for t in self.special) or BLANKS.search(text[::STRIDE]) and RUN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs``."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                raw = encoder.ids(text.as_py() or "") + int(end).to_bytes(4, "little")
                d, n, a, k = d.as_py(), len(raw) // 4, 0, 0
                while a < n:
                    z = a + ((n - a - 1) % capacity + 1 if k == 0 else capacity)
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * z]))
                    a, k = z, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, how often) that together hold ``need``; column generation, then greedy filling."""
    k = len(sizes)
    if not k:
        return []
    b = np.array(need, float)
    basis = [tuple(capacity // sizes[i] if j == i else 0 for j in range(k)) for i in range(k)]
    a = np.array(basis, float).T
    x = b / np.diag(a)
    for _ in range(40 * k):
        price = np.linalg.solve(a.T, np.ones(k))
        value, pattern = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(a, np.array(pattern, float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = x - t * step
        x[out] = t
        a[:, out], basis[out] = pattern, pattern
    left, plan = list(need), []

    def use(pattern: tuple[int, ...], times: int) -> None:
        times = min([times, *(left[i] // n for i, n in enumerate(pattern) if n)])
        if times > 0:
            plan.append((pattern, times))
            for i, n in enumerate(pattern):
                left[i] -= n * times

    for pattern, times in sorted(zip(basis, np.floor(x + 1e-6).astype(int).tolist(), strict=True), key=lambda p: -p[1]):
        use(pattern, times)
    while any(left):
        pattern = _fullest(sizes, left, capacity)
        use(pattern, min(left[i] // n for i, n in enumerate(pattern) if n))
    return plan


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [(s, p, i) for i, (s, p) in enumerate(zip(sizes, price.tolist(), strict=True)) if p > 0]
    if order:
        s, p, idx = (np.array(c) for c in zip(*order, strict=True))
        for c in range(int(s.min()), capacity + 1):
            fits = s <= c
            v = np.where(fits, best[np.where(fits, c - s, 0)] + p, -1)
            j = int(v.argmax())
            best[c], last[c] = (v[j], idx[j]) if v[j] > best[c - 1] else (best[c - 1], -1)
    counts, c = [0] * len(sizes), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), tuple(counts)


def _fullest(sizes: list[int], left: list[int], capacity: int) -> tuple[int, ...]:
    """The pattern of items still left that starts with the largest of them and fills most."""
    counts = [0] * len(sizes)
    i = max(j for j, n in enumerate(left) if n)
    counts[i], room = 1, capacity - sizes[i]
    reach: dict[int, tuple[int, ...]] = {0: ()}
    for j in range(i, -1, -1):
        for _ in range(min(left[j] - counts[j], room // sizes[j])):
            for s, items in list(reach.items()):
                if s + sizes[j] <= room and s + sizes[j] not in reach:
                    reach[s + sizes[j]] = (*items, j)
    for j in reach[max(reach)]:
        counts[j] += 1
    return tuple(counts)


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY, small: tuple[float, ...] = SMALL, groups: int = GROUPS) -> list[dict]:
    """Dicts (length, from, to, sequence, offset): pieces of that length ranked [from, to) go, in this order,
    to sequences from ``sequence`` on, each at ``offset``.  ``hist``: counts by length, at most ``capacity`` of them."""
    plans = [_plan(hist, capacity, int(share * capacity), groups) for share in small]
    return min(plans, key=lambda plan: max((p["sequence"] + p["to"] - p["from"] for p in plan), default=0))


def _plan(hist: dict[int, int], capacity: int, small: int, groups: int) -> list[dict]:
    used: dict[int, int] = {}
    plan: list[dict] = []
    top = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        at = used.get(length, 0)
        plan.append({"length": length, "from": at, "to": at + n, "sequence": sequence, "offset": offset})
        used[length] = at + n

    rooms: list[tuple[int, int, int]] = []  # (room, first sequence, sequences)
    if n := hist.get(capacity, 0):
        put(capacity, n, 0, 0)
        top = n
    large = sorted(x for x in hist if small < x < capacity and hist[x])
    total = sum(hist[x] for x in large)
    sizes: list[int] = []
    members: list[list[list[int]]] = []  # of each group: [length, left], longest first
    need: list[int] = []
    for x in large:
        left = hist[x]
        while left:  # equal cardinality: a length may be in two groups
            if not need or need[-1] >= -(-total // groups):
                sizes.append(x)
                members.append([])
                need.append(0)
            take = min(left, -(-total // groups) - need[-1])
            members[-1].insert(0, [x, take])
            sizes[-1], need[-1], left = x, need[-1] + take, left - take
    merged: dict[int, list[list[int]]] = {}
    for s, m in zip(sizes, members, strict=True):
        merged[s] = m + merged.get(s, [])
    sizes, pools = list(merged), [sorted(m, reverse=True) for m in merged.values()]
    for pattern, times in configurations(sizes, [sum(n for _, n in p) for p in pools], capacity):
        runs = [(top, times, 0)]  # (first sequence, sequences, filled)
        top += times
        for i, n in enumerate(pattern):
            for _ in range(n):
                after = []
                for first, count, filled in runs:
                    while count:
                        length, left = pools[i][0]
                        take = min(left, count)
                        put(length, take, first, filled)
                        after.append((first, take, filled + length))
                        first, count = first + take, count - take
                        pools[i][0][1] -= take
                        if not pools[i][0][1]:
                            pools[i].pop(0)
                runs = after
        rooms += [(capacity - filled, first, count) for first, count, filled in runs]
    by_room: dict[int, list[tuple[int, int]]] = {}
    for room, first, count in rooms:
        by_room.setdefault(room, []).append((first, count))
    for x in sorted((x for x in hist if x <= small), reverse=True):
        left = hist[x]
        while left:
            room = min((r for r in by_room if r >= x), default=None)
            if room is None:  # new sequences, as many as these need
                count = -(-left // (capacity // x))
                by_room.setdefault(capacity, []).append((top, count))
                top += count
                continue
            first, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            take = min(left, count)
            put(x, take, first, capacity - room)
            if take < count:
                by_room.setdefault(room, []).append((first + take, count - take))
            if room > x:
                by_room.setdefault(room - x, []).append((first, take))
            left -= take
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` gives it) with sequence_id and offset."""
    rows = materialise(cut.withColumn("draw", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = json.dumps(plan_packing(hist, capacity))
    kind = "array<struct<length:bigint,`from`:bigint,`to`:bigint,sequence:bigint,offset:bigint>>"
    spans = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(plan), kind))).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from", "to", "sequence", "offset"))).alias("spans"))
    parts = rows.sparkSession.createDataFrame([(x, max(SALTS, -(-n // PART))) for x, n in hist.items()], "length long, parts long")
    rows = rows.join(F.broadcast(parts), "length").withColumn("salt", F.pmod("draw", "parts")).drop("draw", "parts")
    counts = materialise(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))  # a row for each part
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    span = F.filter("spans", lambda x: (F.col("rank") >= x["from"]) & (F.col("rank") < x["to"]))[0]
    return (
        rows.withColumn("number", number)
        .join(maybe_broadcast(starts), ["length", "salt"]).join(F.broadcast(spans), "length")
        .withColumn("rank", F.col("begin") + F.col("number")).withColumn("span", span)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("span.sequence") + F.col("rank") - F.col("span.from")).alias("sequence_id"), F.col("span.offset").alias("offset"))
    )
