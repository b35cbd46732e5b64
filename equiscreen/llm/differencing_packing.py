"""Packing tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

1. A document longer than a window is cut: its first pieces are whole windows, the rest goes on.
2. Every ``1 / FILLERS`` of the pieces that do not fill a window is a filler, which may be cut again.
3. The others are dealt into groups of about ``GROUP`` pieces.  Each piece starts as a partition of ``k`` windows of
   which one holds it.  The two partitions with the greatest imbalance are merged, the fullest windows of the one
   with the emptiest of the other, until one partition is left: windows of nearly equal sums.  ``k`` starts at the
   fewest windows that could hold the group and rises whenever the fullest window exceeds the capacity.
4. The group's fillers are cut to the room that is left in its windows; what is left of them makes whole windows, and the
   last tokens windows of powers of two, which need no padding.

Scale: texts are tokenised once, where they are read.  Pieces are dealt by the hash of a number of their own, so no key,
length or copy makes a group large; a group's task holds about ``GROUP`` rows, of which only fillers carry their ids.

Defined results: null text is the empty text and has only the end token; repeated rows are packed one by one; a null
doc_id stays null; very long texts count whole; an empty table gives no pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches, tidy

#: Tokens of a window; pieces of a group; of how many pieces one is a filler.
CAPACITY, GROUP, FILLERS = 4096, 1024, 8
#: About so many parts of texts between white space are remembered with their ids (20 MB); all others are encoded again.
KNOWN = 100_000
#: The characters of texts that are encoded by merge ranks: what lower-casing, composing and white space do to them is the same everywhere.
PLAIN = "\t\n\r" + "".join(c for c in map(chr, range(0x20, 0x180)) if c not in "\x7fİ\xa0" and not 0x80 <= ord(c) < 0xA0)


class WordEncoder:
    """Token ids of texts by a BPE with word ends, ``path``.

    A word's last symbol carries the end mark.  With a blank for that mark, the vocabulary's ids are the merge ranks of plain
    byte pairs, and a mark joins its letter before all other merges.  Texts with other characters than ``PLAIN``, or
    with a special token, are encoded by the tokenizer itself, which is read when a task meets the first of them.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            rules = json.load(f)
        byte, n = {}, 0
        for b in range(256):  # the usual letters for bytes
            byte[chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else chr(0x100 + n)] = b
            n += not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)
        mark = rules["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in rules["model"]["vocab"].items():
            end = token.endswith(mark)
            ranks[bytes(byte[c] for c in (token[: -len(mark)] if end else token)) + b" " * end] = i
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for t, i in ranks.items() if t[1:] and t.endswith(b" ")]] = True
        self.special = [t["content"].lower() for t in rules["added_tokens"]]
        letters, digits = ("".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == k) for k in "LN")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")
        self.odd = re.compile("[^" + "".join(re.escape(c) for c in PLAIN) + "]")
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow, self.known = path, None, {}
        del rules, ranks
        give_back()

    def ids(self, text: str) -> bytes:
        """As little-endian uint32."""
        low = text.lower()
        if self.odd.search(text) or any(t in low for t in self.special):
            if self.slow is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = low.split()  # no word goes over white space
        fresh = [p for p in set(parts) if p not in self.known]
        if not fresh:
            return b"".join(map(self.known.__getitem__, parts))
        encoded = dict(zip(fresh, self.encoded(fresh), strict=True))
        out = b"".join([self.known.get(p) or encoded[p] for p in parts])
        if len(self.known) < KNOWN:
            self.known.update(encoded)
        return out

    def encoded(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part: all are encoded at once, and told apart by the ends of words."""
        words = [self.words.findall(p) for p in parts]
        ids = self.fast.encode_to_numpy(" ".join(itertools.chain.from_iterable(words)) + " ")
        last = np.flatnonzero(self.ends[ids])[np.cumsum([len(w) for w in words]) - 1] + 1
        raw, at = ids.astype("<u4").tobytes(), 0
        for z in (4 * last).tolist():
            yield raw[at:z]
            at = z


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every row; ``ids`` (uint32) of fillers, else null."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = WordEncoder(tokenizer), 0
        for b in batches:
            rows: list[tuple] = []
            for d, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                raw = encoder.ids(text.as_py() or "") + int(end).to_bytes(4, "little")
                for a in range(0, len(raw), 4 * capacity):
                    part = raw[a : a + 4 * capacity]
                    filler = len(part) < 4 * capacity and seen % FILLERS == 0
                    seen += len(part) < 4 * capacity
                    rows.append((d.as_py(), a // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part if filler else None))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """At most ``k`` windows of items (their places in ``lengths``) of nearly equal sums."""
    heap = [(-n, i, np.array([n]), np.array([i])) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # the two sets of each set that was merged
    made = len(lengths)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, i, b, bt = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # windows that get something from either
        sums, sets = np.concatenate([a, b[: len(b) - over]]), np.concatenate([at, bt[: len(b) - over]])
        if over:
            sums[len(a) - over : len(a)] += b[len(b) - over :][::-1]
            joined += zip(at[len(a) - over :].tolist(), bt[len(b) - over :][::-1].tolist(), strict=True)
            sets[len(a) - over : len(a)] = np.arange(made, made + over)
            made += over
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - (sums.min() if len(sums) == k else 0)
        heapq.heappush(heap, (-int(sums[0]), i, sums, sets[order]))
    out = []
    for s in heap[0][3].tolist() if heap else []:
        todo, items = [s], []
        while todo:
            x = todo.pop()
            if x < len(lengths):
                items.append(x)
            else:
                todo += joined[x - len(lengths)]
        out.append(sorted(items))
    return out


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity`` tokens; their number rises while one holds more."""
    k = -(-sum(lengths) // capacity)
    while True:
        out = differencing(lengths, k)
        if max((sum(lengths[i] for i in w) for w in out), default=0) <= capacity:
            return out
        k += max(1, k // 50)


def fill(rooms: list[int], fillers: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Cuts (filler, start, length, window, offset) of the fillers to the rooms of windows, least room first; windows from
    ``len(rooms)`` on are new ones: whole, and of powers of two for the last tokens."""
    targets = sorted((room, w) for w, room in enumerate(rooms) if room)
    places = [(w, capacity - room, room) for room, w in targets]
    left, new = max(0, sum(fillers) - sum(rooms)), len(rooms)
    while left:
        size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        places.append((new, 0, size))
        left, new = left - size, new + 1
    out, todo = [], iter(places)
    window, offset, room = 0, 0, 0
    for f, n in enumerate(fillers):
        a = 0
        while a < n:
            if not room:
                window, offset, room = next(todo)
            take = min(room, n - a)
            out.append((f, a, take, window, offset))
            a, offset, room = a + take, offset + take, room - take
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the pieces of ``cut`` (as ``pieces`` gives it)."""
    rows = materialise(cut.withColumn("uid", F.monotonically_increasing_id()), "windows-pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).select(*names)
    rest = rows.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("uid", "ascending")])
        g = t.column("group")[0].as_py()
        items = [r for r in t.drop_columns(["ids"]).to_pylist() if not r["filler"]]
        made = windows([r["length"] for r in items], capacity)
        out, rooms = [], []
        for w, members in enumerate(made):
            offset = 0
            for r in (items[i] for i in members):
                out.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], w, offset))
                offset += r["length"]
            rooms.append(capacity - offset)
        fillers = [r for r in t.to_pylist() if r["filler"]]
        for f, a, n, w, offset in fill(rooms, [r["length"] for r in fillers], capacity):
            r = fillers[f]
            out.append((r["doc_id"], r["start"] + a, n, zlib.crc32(r["ids"][4 * a : 4 * (a + n)]), r["doc_tokens"], w, offset))
        columns = list(zip(*out, strict=True))
        columns[5] = [2 * ((g << 20) + w) for w in columns[5]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    dealt = rest.withColumn("filler", F.col("ids").isNotNull()).withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(run, ", ".join(f"{c} long" for c in names)))
