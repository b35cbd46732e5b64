"""Removal of repeated byte strings by suffix sorting in two stages.

Every byte is removed that a string of ``SPAN`` bytes covers which also starts anywhere else.  Strings start
and end within a document and are judged on the input.

How the work is dealt out.  Each window of SPAN bytes belongs to one anchor: the K bytes in it with the least
hash, the first of them if they tie.  Equal windows have equal anchors at equal places, so windows need to
be compared only with those of equal anchors.  The windows that one occurrence of an anchor has are
consecutive and lie in one string, its context.

1. One map over the texts gives (anchor hash, context hash, place) of every context: about a row for each
   100 to 200 bytes.  Equal contexts are counted; all windows of a context that occurs twice are repeated.
   Those that one text has several times (in CHUNK bytes) are known in the map: they are one row with a count, and
   their bytes go out as few runs, so a line that fills whole texts costs no row for each occurrence.
   The counts are aggregated before they are shuffled, so a third of all rows may be copies of one text.
2. Anchors with several different contexts are left: edges of repeated passages and near copies.  Their
   contexts, one of each, are dealt by anchor and suffix sorted in blocks of bounded size: suffixes smaller
   than their successor are sorted directly, the others are induced from them by scans of the buckets, and
   windows whose common prefix with a neighbour has SPAN bytes are repeated.
3. An anchor with more than ``MAX_GROUP`` different contexts is not given to one task: its windows are hashed,
   128 bits each, and counted, which spreads them and is exact as well.

Defined results: null text has no bytes; texts shorter than SPAN lose nothing; repeated rows repeat all
their windows; very long texts are read whole; an empty table gives an empty result; other columns, of any name, are
ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, tidy

SPAN, K = 400, 128
#: Bytes (a multiple of 8) of a string that the report also counts where it repeats, and that the corpus pipeline removes: 40 words or more.
PASSAGE, PASSAGE_K = 248, 96
#: Contexts of one anchor that are sorted in one task, bytes that are sorted at once, and windows hashed at once.
MAX_GROUP, BLOCK, CHUNK = 4096, 1 << 19, 1 << 20
#: Rows of a side that may be broadcast: contexts (about 60 bytes) or repeated spans; 120 MB at most once hashed.  Beyond
#: it the texts are shuffled to them, which costs about the input's size of disk.
SMALL_SIDE = 2_000_000
_ONE = np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = _ONE
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    shift, by = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)
    for _ in range(2):
        h = (h ^ (h >> shift)) * by
    return h ^ (h >> shift)


class Anchors:
    """Finds the anchors of all windows; keeps its power tables."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, span: int = SPAN, k: int = K):
        self.span, self.k, self.n = span, k, 0
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.BASE))

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.power, self.inverse = _powers(self.BASE, self.n), _powers(pow(self.BASE, -1, 1 << 64), self.n)

    def of(self, raw: bytes) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Anchor hashes, first windows and last windows of the contexts, CHUNK bytes of the text at a time."""
        for at in range(0, max(len(raw) - self.span + 1, 0), CHUNK):
            part = np.frombuffer(raw, np.uint8)[at : at + CHUNK + self.span - 1]
            h, lo, hi = self._chunk(part)
            yield h.view(np.int64).tolist(), (lo + at).tolist(), (hi + at).tolist()

    def _chunk(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k, w = len(part), self.k, self.span - self.k + 1
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[part] * self.power[:n], out=sums[1:])
        h = _mixed((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        place = np.uint64((1 << 21) - 1)
        key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate([key, np.full(-len(h) % w, ~np.uint64(0))]).reshape(-1, w)
        left, right = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.span + 1
        first = (np.minimum(right[:windows], left[w - 1 : w - 1 + windows]) & place).astype(np.int64)
        cut = np.flatnonzero(np.diff(first)) + 1
        lo = np.concatenate([[0], cut])
        return h[first[lo]], lo, np.concatenate([cut - 1, [windows - 1]])


def sort_suffixes(parts: list[bytes], wanted: list[int], depth: int) -> tuple[np.ndarray, bytes]:
    """The first ``wanted`` suffixes of each part in order, by their first ``depth`` bytes at least.

    Gives places in the returned bytes, in which the parts stand with an end mark after each.  Other suffixes
    are sorted only where the wanted ones are induced from them.
    """
    raw = b"\0".join(parts) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text[ends] = 0
    n = len(text)
    begin = ends - np.array([len(p) for p in parts])
    # smaller[i]: the suffix at i is smaller than the one at i + 1
    change = np.append(np.sign(text[1:] - text[:-1]), -1)
    where = np.minimum.accumulate(np.where(change != 0, np.arange(n), n - 1)[::-1])[::-1]
    smaller = (change[where] > 0) & (text > 0)
    stop = np.minimum.accumulate(np.where(smaller | (text == 0), np.arange(n), n - 1)[::-1])[::-1]
    count = np.array(wanted)
    last = np.where(count > 0, np.minimum(stop[np.maximum(begin + count - 1, begin)] + 1, ends), begin)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, last, -1)
    active = np.cumsum(edge[:-1]) > 0
    # stage one: sort directly
    direct = np.flatnonzero(active & smaller)
    until = np.minimum(direct + depth, ends[np.searchsorted(ends, direct)])
    keys = [raw[a:z] for a, z in zip(direct.tolist(), until.tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)] if keys else direct
    del keys
    # stage two: scan the buckets upwards; in each, the induced suffixes come first
    induced = np.flatnonzero(active & ~smaller & (text > 0))
    induced = induced[np.argsort(text[induced], kind="stable")]
    rank = np.full(n, -1, np.int64)
    order, done = [], 0
    for c in np.unique(text[active & (text > 0)]).tolist():
        a, z = np.searchsorted(text[induced], [c, c + 1])
        bucket = induced[a:z]
        layer = bucket[text[bucket + 1] < c]
        layer = layer[np.argsort(rank[layer + 1], kind="stable")]
        while len(layer):  # then those that begin with two, three... times this byte
            rank[layer] = np.arange(done, done + len(layer))
            done += len(layer)
            order.append(layer)
            layer = layer[layer > 0] - 1
            layer = layer[active[layer] & ~smaller[layer] & (text[layer] == c)]
        a, z = np.searchsorted(text[direct], [c, c + 1])
        rank[direct[a:z]] = np.arange(done, done + z - a)
        done += z - a
        order.append(direct[a:z])
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    part = np.searchsorted(ends, found)
    return found[found - begin[part] < count[part]], raw


def common_prefixes(raw: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` has in common with the next, ``depth`` at most (a multiple of 8);
    all of them have that many before their end mark."""
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    out = np.full(max(len(order) - 1, 0), depth, np.int64)
    left = np.arange(len(out))
    for at in range(0, depth, 8):
        differ = words[order[left] + at] ^ words[order[left + 1] + at]
        bad = differ != 0
        low = differ[bad] & (~differ[bad] + _ONE)
        out[left[bad]] = at + np.log2(low.astype(float)).astype(np.int64) // 8
        left = left[~bad]
    return out


def repeated_windows(contexts: list[bytes], span: int) -> list[np.ndarray]:
    """For each context, which of its windows are equal to another window of any context."""
    count = [len(c) - span + 1 for c in contexts]
    order, raw = sort_suffixes(contexts, count, span)
    equal = common_prefixes(raw, order, span) >= span
    twice = np.zeros(len(order), bool)
    twice[:-1] |= equal
    twice[1:] |= equal
    begin = np.cumsum([0, *(len(c) + 1 for c in contexts)])
    hit = np.zeros(len(raw), bool)
    hit[order[twice]] = True
    return [hit[b : b + n] for b, n in zip(begin.tolist(), count, strict=False)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def once_each(anchor: list[int], context: list[int], begin: list[int], end: list[int]) -> tuple[list[list[int]], list[tuple[int, int]] | None]:
    """The contexts of one text, in order.  Gives their columns anchor, context, begin, end, times with one row for equal ones,
    and the runs [begin, end) of bytes under contexts that are there twice or more; None for none."""
    if len(set(context)) == len(context):
        return [anchor, context, begin, end, [1] * len(context)], None
    times, first = Counter(zip(anchor, context, strict=True)), {}
    runs: list[tuple[int, int]] = []
    for h, c, a, b in zip(anchor, context, begin, end, strict=True):
        first.setdefault((h, c), (h, c, a, b, times[h, c]))
        if times[h, c] > 1:
            runs[-1:] = [(runs[-1][0], b)] if runs and runs[-1][1] >= a else [*runs[-1:], (a, b)]
    return [list(x) for x in zip(*first.values(), strict=True)], runs or None


def _spans_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["did", "th", "a", "b"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else df


def repeated_spans(texts: DataFrame, span: int = SPAN, k: int = K, max_group: int = MAX_GROUP) -> DataFrame:
    """``texts``: did, th, raw (an id, a hash of the bytes, the bytes).  Gives did, th, spans: the maximal runs
    [a, b) of bytes to remove, for the texts that have any."""

    fields = {n: pa.int64() for n in ("did", "th", "anchor", "context", "lo", "hi", "times")} | {"runs": RUNS}

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(span, k)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cols: list[list] = [[] for _ in fields]
                for did, th, raw in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("raw").to_pylist(), strict=True):
                    for h, lo, hi in find.of(raw):
                        end = [x + span for x in hi]
                        mine, runs = once_each(h, [xxhash.xxh3_64_intdigest(raw[a:z]) - (1 << 63) for a, z in zip(lo, end, strict=True)], lo, end)
                        n = len(mine[0])
                        for col, x in zip(cols, ([did] * n, [th] * n, *mine, [runs, *[None] * (n - 1)]), strict=True):
                            col += x
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, fields.values(), strict=True)], names=list(fields))

    small_batches(texts.sparkSession)
    long = texts.where(F.octet_length("raw") >= span)
    found = materialise(long.mapInArrow(scan, "did long, th long, anchor long, context long, lo long, hi long, times long, runs array<struct<a:bigint,b:bigint>>"), "anchors")
    counts = F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("did", "th", "lo", "hi")).alias("one")
    kinds = materialise(found.groupBy("anchor", "context").agg(*counts), "contexts")
    shared = kinds.where("`rows` > 1").select("anchor", "context")
    whole = found.where("times = 1").join(_small(shared), ["anchor", "context"], "left_semi").select("did", "th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    own = found.where("runs is not null").select("did", "th", F.inline("runs"))
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("group")).where("`group` > 1")
    left = materialise(kinds.join(_small(many), "anchor").select("anchor", "group", "n", "one.*"), "contexts-to-sort")
    by_text = left.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "group", "n", "lo", "hi")).alias("of"))
    kind = "anchor long, group long, n long, did long, th long, lo long, bytes binary"

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for did, th, raw, of in zip(*(b.column(c).to_pylist() for c in ("did", "th", "raw", "of")), strict=True):
                rows += [{"anchor": x["anchor"], "group": x["group"], "n": x["n"], "did": did, "th": th, "lo": x["lo"], "bytes": raw[x["lo"] : x["hi"]]} for x in of]
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=CUT)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=CUT)

    # ``left`` bounds what is broadcast: one row of by_text has its contexts, and there are SMALL_SIDE of them at most
    side = F.broadcast(by_text) if left.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else by_text
    contexts = long.join(side, ["did", "th"]).select("did", "th", "raw", "of").mapInArrow(cut, kind)
    hot = left.where(F.col("group") > max_group).limit(1).count() > 0
    if hot:
        contexts = materialise(contexts, "context-bytes")

    @tidy
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for (_, n, did, th, lo, _), hit in zip(block, repeated_windows([x[5] for x in block], span), strict=True):
                if n == 1:  # all windows of the others are known to be repeated
                    rows += [(did, th, lo + a, lo + z - 1 + span) for a, z in _runs(hit)]
            block.clear()
            return _spans_batch(rows)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "n", "did", "th", "lo", "bytes")), strict=True):
                if size >= BLOCK and row[0] != block[-1][0]:  # an anchor's contexts stay together
                    yield flush()
                    size = 0
                block.append(row)
                size += len(row[5])
        if block:
            yield flush()

    spans = "did long, th long, a long, b long"
    sorted_ = contexts.where(F.col("group") <= max_group).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, spans)
    out = whole.unionByName(own).unionByName(sorted_)
    if hot:
        out = out.unionByName(_hashed(contexts.where(F.col("group") > max_group), span))
    return out.groupBy("did", "th").agg(merged_spans(F.collect_set(F.struct("a", "b"))).alias("spans"))


RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
CUT = pa.schema([("anchor", pa.int64()), ("group", pa.int64()), ("n", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])


def _hashed(contexts: DataFrame, span: int) -> DataFrame:
    """Repeated windows of anchors with very many contexts: windows are counted by a 128-bit hash."""
    kind = "h1 long, h2 long, n long, did long, th long, a long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, did, th, lo, raw in zip(*(b.column(c).to_pylist() for c in ("n", "did", "th", "lo", "bytes")), strict=True):
                count = len(raw) - span + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + span]) for i in range(count)), "<i8").reshape(-1, 2)
                same = np.ones(count, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(same * n), pa.array(same * did), pa.array(same * th), pa.array(lo + np.arange(count))], names=["h1", "h2", "n", "did", "th", "a"])

    windows = contexts.mapInArrow(run, kind)
    twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2")
    return windows.where("n = 1").join(twice, ["h1", "h2"], "left_semi").select("did", "th", "a", (F.col("a") + span).alias("b"))


def merged_spans(spans: Column) -> Column:
    """Overlapping or touching spans as one, in order."""

    def add(acc: Column, x: Column) -> Column:
        last = acc["last"]
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        touch = last["b"] >= x["a"]
        return F.struct(F.when(last.isNull() | touch, acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), F.when(touch, grown).otherwise(x).alias("last"))

    one = "struct<a:bigint,b:bigint>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("last"))
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))


def _texts(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"raw": raw, "did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}).withColumn("th", F.xxhash64("raw"))


def _joined(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with their spans, null for those without; the spans are broadcast if they are few."""
    spans = materialise(spans, "repeated-spans")
    few = spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0)).alias("n")).first()["n"] <= SMALL_SIDE
    return texts.join(F.broadcast(spans) if few else spans, ["did", "th"], "left")


def report(docs: DataFrame, span: int = SPAN, k: int = K, max_group: int = MAX_GROUP, passage: int = PASSAGE, passage_k: int = PASSAGE_K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated for every row of ``docs``.

    n_repeated counts the bytes that a string of ``passage`` bytes covers which also starts anywhere else: passages too
    short to be removed, such as one of 50 short words.
    """
    texts = _texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    bytes_of = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    shorter = repeated_spans(texts.select("did", "th", "raw"), passage, passage_k, max_group).select("did", "th", bytes_of("spans").alias("n_repeated"))
    shorter = materialise(shorter, "repeated-bytes")
    joined = _joined(texts, repeated_spans(texts.select("did", "th", "raw"), span, k, max_group)).join(_small(shorter), ["did", "th"], "left")
    return joined.withColumn("spans", F.coalesce("spans", none)).select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), bytes_of("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(kept_bytes("raw", "spans"), 256).alias("kept_sha256"), F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
    )


def kept_bytes(raw: str, spans: str) -> Column:
    """The bytes outside the spans: from each span's end, or the text's begin, to the next span's begin or the text's end."""
    one = F.size(spans)
    pieces = F.transform(F.sequence(F.lit(0), one), lambda i: F.substring(F.col(raw), (F.when(i > 0, F.get(spans, i - 1)["b"]).otherwise(F.lit(0)) + 1).cast("int"), (F.when(i < one, F.get(spans, i)["a"]).otherwise(F.octet_length(raw)) - F.when(i > 0, F.get(spans, i - 1)["b"]).otherwise(F.lit(0))).cast("int")))
    joined = F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return F.when(one == 0, F.col(raw)).otherwise(joined)


def clean(docs: DataFrame, span: int = SPAN, k: int = K, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with the repeated bytes removed; characters of which a part is gone go whole.  All rows and columns stay."""
    texts = _texts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"))
    names, at = docs.columns, docs.columns.index("text")
    joined = _joined(texts.select("row", "did", "th"), repeated_spans(texts.select("did", "th", "raw"), span, k, max_group))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("row").flatten()
            texts = [t if not s else cut_text(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(own[at].to_pylist(), b.column("spans").to_pylist(), strict=True)]
            own[at] = pa.array(texts, own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=names)

    return joined.select("row", "spans").mapInArrow(run, docs.schema)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for a, b in spans:
        while a > at and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        out.append(raw[at : max(a, at)])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
