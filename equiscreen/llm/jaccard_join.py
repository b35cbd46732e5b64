"""Exact Jaccard join of documents' word shingles by partitions of the universe.

Two sets of sizes s and t with similarity of 3/4 or more differ in at most H = (s + t) // 7 members.  Members
are hashed into m segments, m by size band: of the m pairs of segments at most H differ, the others are equal.

Which segments are spent is a matter of cost.  Level 0 indexes every non-empty segment, u of them.  A similar set
shares more than u - H, so the first H + 1 are enough, taken rarest first: segments that a set has to itself come
before shared ones, and a set with more than H such segments has no partner and leaves.  Two kinds of sets are
allocated level 1: those whose first H + 1 reach segments that more than ``FREQUENT`` sets share, and those with no
more than H non-empty segments, all of which may differ.  There are fewer segments there, each indexed with its
one-deletion neighbourhood, of which at most H / 2 can differ by more.  Sets that even then reach frequent segments,
or have at most H / 2 segments of two members, are indexed member by member (level 2): those that share one of the
rarest quarter are compared, copies and near copies being linked already.

What is compared, and how.  Equal sets are one class before anything is indexed.  Each class has a parity bitmap of
its members, 3 to 6 bits a member: where two bitmaps differ in more than H bits, the sets differ in more than H
members, so the pair is dropped without its texts.  Of the classes that share a signature

1. each is compared with the most central one of its signatures, a pair a class; verified links merge components;
2. those of other components than the largest of the group are compared with all of the group by bitmap.  Of what
   passes, the closest pair of each two components is verified, and the components are merged;
3. step 2 is repeated and every pair that passes and has not been verified is: only pairs of different components
   whose bitmaps cannot tell them from similar ones are left, those of similarity 0.72 to 0.75.

So neither copies nor near copies are expanded into their pairs.  A large group is split: its largest component is
dealt over tasks of ``CHUNK`` classes, and the others go to each of these.  A group without a large component is
compared pair by pair, bitmaps only; that is the price of an exact answer where thousands of texts share their
rarest members without being similar.
All links are verified on the words themselves.  Components are found by contraction, in tables.

Scale: signatures travel as arrays, one row for each batch of documents and bucket of the signature space.
Tables of signatures are joined by shuffles, as hints say: their files pack them to two or three bytes a row, which Spark
takes for the rows' size, and it would broadcast millions of them through the driver.
Only signatures that two classes share are kept.  Texts are fetched only for classes that are verified.

Defined results: null and wordless texts have no shingles and are linked with nothing; texts of fewer than five
words have one shingle; repeated rows are one class; very long texts are read whole; a null id never names a component
unless it is alone; an empty table gives an empty result; other columns play no part and may have any name.
Classes are named by a 64-bit hash of the set; a second one is compared, and should two sets ever share a name,
the run starts anew with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH, materialise, maybe_broadcast, small_batches, tidy

WORDS = 5
#: A signature that more classes share is frequent.
FREQUENT = 50
#: Classes of a group that one task compares with the others.
CHUNK = 2048
#: Edges that one task walks to their end; more are contracted in rounds until no more are left.
WALKED = 10_000
#: Similarity of 100 * common >= LEAST * union, and with it H = (s + t) // PER.
LEAST, PER = 75, 7
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    shift = np.uint64(32)
    for _ in range(2):
        h = (h ^ (h >> shift)) * _MIX
    return h ^ (h >> shift)


class WordHashes(dict):
    """Small numbers for words, and each one's 64-bit hash at that place of ``table``."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        self.table = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(n, np.uint64)])
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[n]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered; split at the space and at bytes 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(len(h) - WORDS + 1, 1)
    total = np.full(n, np.uint64(min(len(h), WORDS)))
    for i in range(min(WORDS, len(h))):
        total = total + h[i : i + n] * _TURN[i]
    return _distinct(_mixed(total))


def shingle_set(words: list[bytes]) -> frozenset:
    if len(words) < WORDS:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(WORDS)), strict=False))


def class_of(sh: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The name of a set, and a second hash that shows whether two sets share it."""
    raw = sh.tobytes()
    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63), xxhash.xxh64_intdigest(raw, seed) - (1 << 63)


def bitmap(sh: np.ndarray) -> bytes:
    """Parity bitmap: bit i is the number of members that fall on it, modulo 2; at least 3 bits a member, 64 at least."""
    bits = 1 << max(6, (3 * len(sh) - 1).bit_length())
    return np.packbits((np.bincount((sh & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def segments(level: int, h: int) -> int:
    """log2 of the number of segments for pairs that differ in at most ``h`` members."""
    return max(int((1.25 if level == 0 else 0.7) * h + 2) - 1, 3).bit_length()


def bands(level: int, s: int) -> dict[int, int]:
    """For a set of size s: log2 of the numbers of segments it takes part in, each with the largest H there."""
    if level == 2:  # every member is a segment; a similar set has LEAST percent of them at least
        return {31: s + -LEAST * s // 100}
    least, most = (s + -(-LEAST * s // 100)) // PER, (s + 100 * s // LEAST) // PER
    out: dict[int, int] = {}
    for h in {most, *(x for x in _steps(level) if least <= x < most), least}:
        if h:
            out[segments(level, h)] = max(out.get(segments(level, h), 0), h)
    return out


@lru_cache(None)
def _steps(level: int) -> tuple[int, ...]:
    """The largest H of each number of segments."""
    return tuple(int(((1 << b) - 2 + 0.999) / (1.25 if level == 0 else 0.7)) for b in range(2, 40))


def signatures(sh: np.ndarray, bits: int, level: int) -> tuple[np.ndarray, int]:
    """Signatures of the segments of sorted hashes ``sh``, and how many segments can be relied on.

    The lowest five bits say ``bits``; a signature does not say whether a member was left out.
    """
    if level == 2:
        out = _distinct(sh | np.uint64(31))
        return out, len(out)
    seg = sh >> np.uint64(64 - bits)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    m = _mixed(sh ^ _TURN[1])
    total = np.add.reduceat(m, start)
    count = np.diff(np.append(start, len(sh)))
    which = seg[start] * _TURN[2] + np.uint64(bits + 64 * level)
    out, usable = [_mixed(total + which)], len(start)
    if level:
        of = np.repeat(np.arange(len(start)), count)
        of, m = of[count[of] > 1], m[count[of] > 1]
        out.append(_mixed(total[of] - m + which[of]))
        usable = int((count > 1).sum())
    low = np.uint64(31)
    return _distinct((np.concatenate(out) & ~low) | np.uint64(bits)), usable


def _index(docs: DataFrame, level: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures that several classes share: (sig, k, pivot, cls) with k classes, the least of them the pivot;
    for each class and band: (cls, bits, n, h, usable); and for each row, at level 0: (did, th, n, cls, again, bitmap),
    cls null without shingles, bitmap for the first row of a class in its task."""
    spark = docs.sparkSession
    buckets = max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()
        lists = lambda cut, x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                sigs, owners, info, rows, maps = [], [], [], [], []
                for did, th, t in zip(*(b.column(c).to_pylist() for c in ("did", "th", "text")), strict=True):
                    sh = shingle_hashes(words_of(t), hashes)
                    cls, again = class_of(sh, seed) if len(sh) else (None, None)
                    first = cls is not None and cls not in met  # copies in one partition are indexed once
                    if level == 0:
                        rows.append((did, th, len(sh), again, 0, cls))
                        maps.append(bitmap(sh) if first else None)
                    if not first:
                        continue
                    met.add(cls)
                    for bits, h in bands(level, len(sh)).items():
                        s, usable = signatures(sh, bits, level)
                        sigs.append(s)
                        owners.append(np.full(len(s), cls))
                        info.append((bits, len(sh), h, usable, cls))
                if len(met) > 200_000:
                    met.clear()
                for kind, extra in ((rows, maps), (info, [None] * len(info))):  # these have numbers below 0 and only pass through
                    if kind:
                        p = [-1 - (x[0] + x[-1] if x[-1] is not None else x[0]) % buckets for x in kind]
                        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([x[:-1] for x in kind], pa.list_(pa.int64())), pa.array([[x[-1]] for x in kind], pa.list_(pa.int64())), pa.array(extra, pa.binary())], names=["p", "sigs", "cls", "bitmap"])
                if not sigs:
                    continue
                s, o = np.concatenate(sigs), np.concatenate(owners)
                p = ((s >> np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(p, kind="stable")
                s, o, p = s[order].view(np.int64), o[order], p[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
                yield pa.RecordBatch.from_arrays([pa.array(p[cut[:-1]]), lists(cut, s), lists(cut, o), pa.nulls(len(cut) - 1, pa.binary())], names=["p", "sigs", "cls", "bitmap"])

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "k", "pivot", "cls", "info", "bitmap"]

        def shared(s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            s, c = s[new], c[new]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            k = np.diff(np.append(start, len(s)))
            k, pivot = np.repeat(k, k), np.repeat(c[start], k)
            some = k > 1
            n = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (s, k, pivot, c)] + [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names=names)

        at, held = None, []
        for b in batches:
            ps = np.array(b.column("p"))
            for i in np.flatnonzero(np.concatenate([[True], ps[1:] != ps[:-1]])).tolist():
                z = i + int((ps[i:] == ps[i]).sum())
                if ps[i] < 0:
                    n = z - i
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [b.column("cls").slice(i, n).flatten(), b.column("sigs").slice(i, n), b.column("bitmap").slice(i, n)], names=names)
                    continue
                if held and at != ps[i]:
                    yield shared(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                at = ps[i]
                held.append((np.array(b.column("sigs").slice(i, z - i).flatten()), np.array(b.column("cls").slice(i, z - i).flatten())))
        if held:
            yield shared(*map(np.concatenate, zip(*held, strict=True)))

    rows = docs.select("did", "th", "text").mapInArrow(emit, "p long, sigs array<bigint>, cls array<bigint>, bitmap binary").repartition("p").sortWithinPartitions("p")
    found = materialise(rows.mapInArrow(meet, "sig long, k long, pivot long, cls long, info array<bigint>, bitmap binary"), f"signatures-{level}").hint("merge")
    passed = found.where("sig is null")
    named = lambda *names: [F.col("info")[i].alias(c) for i, c in enumerate(names)]
    rows_of = passed.where(F.size("info") == 5).select(*named("did", "th", "n", "again"), "cls", "bitmap")
    return found.where("sig is not null").select("sig", "k", "pivot", "cls"), passed.where(F.size("info") == 4).select(*named("bits", "n", "h", "usable"), "cls").distinct(), rows_of


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each bitmap of ``x`` (rows of 64-bit words) differs from each of ``y``."""
    out = np.zeros((len(x), len(y)), np.int64)
    for i in range(x.shape[1]):
        out += np.bitwise_count(x[:, i, None] ^ y[None, :, i])
    return out


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: parity bitmaps fold by exclusive or."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def map_bits(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded."""
    p, q, w = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    while (p | q) >> w:
        half = 4 * max(len(x), len(y))
        p, q = (p >> half) ^ (p & ((1 << half) - 1)), (q >> half) ^ (q & ((1 << half) - 1))
        x, y = x[: half // 8], y[: half // 8]
    return (p ^ q).bit_count()


def few_pairs(n: tuple, label: tuple, maps: tuple, top: tuple, own: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``close_pairs`` gives, for a handful of classes."""
    found = []
    for i in range(len(n)):
        for j in range(len(n)):
            if not top[i] and own[j] and label[i] != label[j] and 100 * min(n[i], n[j]) >= LEAST * max(n[i], n[j]):
                bits = map_bits(maps[i], maps[j])
                if bits <= (n[i] + n[j]) // PER:
                    found.append((i, j, bits))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def close_pairs(n: np.ndarray, label: np.ndarray, maps: tuple, rest: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits) of the pairs of different labels whose bitmaps differ in no more bits than similar sets may: i is one of ``rest``, ``own`` says where j may be."""
    words = np.array([len(m) // 8 for m in maps])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole = lambda at, w: folded(np.frombuffer(b"".join(maps[k] for k in at.tolist()), np.uint64).reshape(len(at), -1), w)
    for w in np.unique(words[rest]).tolist():
        left = rest[words[rest] == w]
        for v in (w // 2, w, 2 * w):  # sizes of similar sets differ by a third at most
            right = np.flatnonzero(own & (words == v))
            if not len(right):
                continue
            x, y = whole(left, min(v, w)), whole(right, min(v, w))
            step = max(1, 1_000_000 // len(right))
            for k in range(0, len(left), step):
                p = left[k : k + step]
                bits = differing(x[k : k + step], y)
                a, b = n[p][:, None], n[right][None, :]
                i, j = np.nonzero((bits <= (a + b) // PER) & (label[p][:, None] != label[right][None, :]) & (100 * np.minimum(a, b) >= LEAST * np.maximum(a, b)))
                out.append((p[i], right[j], bits[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def compared(rows: DataFrame, labels: DataFrame, classes: DataFrame, closest: bool) -> DataFrame:
    """(a, b, la, lb, bits, n) for the pairs of classes of ``rows`` (sig, cls) of different components la, lb that share a
    signature and whose bitmaps are close; with ``closest`` only one of the n pairs of each two components in a group."""
    known = rows.join(labels, "cls", "left").select("sig", "cls", F.coalesce("label", "cls").alias("label"))
    tops = known.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels"))
    mixed = known.join(tops.where("labels > 1"), "sig").join(classes.select("cls", "n", "bitmap"), "cls")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    top = F.col("label") == F.col("top")
    dealt = mixed.withColumn("own", F.pmod(F.hash("cls"), chunks)).withColumn("chunk", F.explode(F.when(top, F.array("own")).otherwise(F.sequence(F.lit(0), chunks - 1))))
    dealt = dealt.select("sig", "chunk", "cls", "label", "n", "bitmap", top.alias("top"), (F.col("own") == F.col("chunk")).alias("own"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def group(rows: list[tuple]) -> None:
            _, _, cls, label, n, maps, top, own = zip(*rows, strict=True)
            if len(rows) <= 12:
                i, j, bits = few_pairs(n, label, maps, top, own)
            else:
                i, j, bits = close_pairs(np.array(n), np.array(label), maps, np.flatnonzero(~np.array(top)), np.array(own))
            if len(i):
                cls, label = np.array(cls), np.array(label)
                one = np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), bits, np.ones(len(i), np.int64)])
                one = one[:, np.lexsort(one[[1, 0, 4, 3, 2]])]
                one = one[:, np.concatenate([[True], (one[:4, 1:] != one[:4, :-1]).any(axis=0)])]  # both members of a pair may be among the dealt
                if closest:
                    start = np.flatnonzero(np.concatenate([[True], (one[2:4, 1:] != one[2:4, :-1]).any(axis=0)]))
                    count = np.diff(np.append(start, one.shape[1]))
                    one = one[:, start]
                    one[5] = count
                found.append(one)

        def batch() -> pa.RecordBatch:
            cols = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "la", "lb", "bits", "n"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] != held[-1][:2]:
                    group(held)
                    held = []
                held.append(row)
            if sum(x.shape[1] for x in found) > 10_000:
                yield batch()
        if held:
            group(held)
        yield batch()

    return dealt.repartition("sig", "chunk").sortWithinPartitions("sig", "chunk").mapInArrow(run, "a long, b long, la long, lb long, bits long, n long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar; ``classes``: cls, did, th of a text of each class."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", "did", "th"), "cls")
    ids = maybe_broadcast(materialise(ids, "verified"))
    texts = materialise(docs.select("did", "th", "text").join(ids, ["did", "th"]).groupBy("cls").agg(F.first("text").alias("text")), "verified-texts")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, frozenset()
        for b in batches:
            keep = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if a != at:  # one set is kept, and one text made a set: memory is bounded by the two longest texts
                    at, left = a, shingle_set(words_of(x))
                right = shingle_set(words_of(y))
                common = len(left & right)
                keep.append(100 * common >= LEAST * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_y = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    both = with_y.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y").sortWithinPartitions("a")
    return materialise(both.mapInArrow(run, "a long, b long"), "links")


def _walked(edges: DataFrame) -> DataFrame:
    """(cls, to) for the ends of ``edges``, at most ``WALKED``: to is the least end of their component."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = sorted((top(a), top(b)))
                up[b] = a
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["cls", "to"])

    return edges.coalesce(1).mapInArrow(run, "cls long, to long")


def components(edges: DataFrame) -> DataFrame:
    """cls, label for every end of an edge (a, b); the label is one of the component's ends.

    Every node moves to its least neighbour or stays; edges move along, until so few are left between different nodes
    that one task walks them.  Rounds cost jobs, and jobs cost the driver memory, whatever their size.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels: DataFrame | None = None
    while True:
        edges = materialise(edges, "edges")
        n = edges.count()
        if not n:
            break
        ends = edges.select(F.col("a").alias("cls"), F.col("b").alias("to")).union(edges.select("b", "a"))
        move = materialise(_walked(edges) if n <= WALKED else ends.groupBy("cls").agg(F.least(F.min("to"), F.min("cls")).alias("to")), "moves")
        if labels is None:
            labels = move.withColumnRenamed("to", "label")
        else:
            labels = materialise(labels.join(move.select(F.col("cls").alias("label"), "to"), "label", "left").select("cls", F.coalesce("to", "label").alias("label")), "labels")
        if n <= WALKED:
            break
        a, b = move.select(F.col("cls").alias("a"), F.col("to").alias("x")), move.select(F.col("cls").alias("b"), F.col("to").alias("y"))
        edges = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return labels if labels is not None else edges.select(F.col("a").alias("cls"), F.col("b").alias("label"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (cls, label) after ``links`` (a, b): only links between different components are looked at again."""
    if links.isEmpty():
        return labels
    at = lambda end: labels.select(F.col("cls").alias(end), F.col("label").alias(f"l{end}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    move = components(ends)
    if move.isEmpty():
        return labels
    own = links.select(F.col("a").alias("cls")).union(links.select("b")).distinct().join(labels, "cls", "left_anti").select("cls", F.col("cls").alias("label"))
    move = move.select(F.col("cls").alias("label"), F.col("label").alias("to"))
    return materialise(labels.unionByName(own).join(move, "label", "left").select("cls", F.coalesce("to", "label").alias("label")), "merged-labels")


def _prefixes(shared: DataFrame, info: DataFrame) -> DataFrame:
    """(sig, k, pivot, cls, bits, n, h, usable, place): each class's shared signatures, numbered after those that it has alone, rarest first.

    Any two similar sets share usable - h signatures or more.  So, if usable is more than h, with all in one order, the rarest that they share is
    among the first h + 1 of both; later ones are left out, and with them all sets that have more than h to themselves.
    """
    counted = shared.withColumn("bits", F.col("sig").bitwiseAND(F.lit(31)))
    some = counted.groupBy("cls", "bits").agg(F.count(F.lit(1)).alias("__shared"))
    may = info.join(some, ["cls", "bits"]).where(F.col("usable") - F.col("__shared") <= F.col("h"))
    rows = counted.join(may, ["cls", "bits"])
    place = F.row_number().over(Window.partitionBy("cls", "bits").orderBy("k", "sig")) + F.col("usable") - F.col("__shared")
    return rows.withColumn("place", place).drop("__shared")


def _stars(docs: DataFrame, classes: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels after each class was compared with one central class: of those that share its signatures, the ones that
    share most with all others come first, as the text that copies were made from does."""
    central = rows.groupBy("cls").agg(F.sum("k").alias("weight"))
    known = rows.select("sig", "cls").hint("merge").join(central, "cls").join(labels, "cls", "left").select("sig", "cls", "weight", F.coalesce("label", "cls").alias("label"))
    known = materialise(known, "weighed").hint("merge")
    hubs = known.groupBy("sig").agg(F.max(F.struct("weight", "cls", "label")).alias("hub")).select("sig", F.col("hub.cls").alias("pivot"), F.col("hub.label").alias("at"), F.col("hub.weight").alias("w"))
    star = known.join(hubs, "sig").where("label <> `at`").groupBy("cls", "pivot").agg(F.count(F.lit(1)).alias("v"), F.first("w").alias("w"))
    best = star.groupBy("cls").agg(F.max_by("pivot", F.struct("v", "w", "pivot")).alias("pivot")).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [map_bits(x, y) <= (n + m) // PER for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    at = lambda end, n, m: classes.select(F.col("cls").alias(end), F.col("n").alias(n), F.col("bitmap").alias(m))
    both = best.join(at("a", "n", "x"), "a").join(at("b", "m", "y"), "b").where(f"100 * least(n, m) >= {LEAST} * greatest(n, m)")
    return merged(labels, verified(materialise(both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "stars"), docs, classes))


def _linked(docs: DataFrame, classes: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels after all pairs of ``rows`` (sig, cls) that share a signature: the closest of each two components, then the
    others of those two components that this has not linked."""
    pair = F.struct("a", "b")
    near = compared(rows, labels, classes, True).groupBy("la", "lb").agg(F.min(F.struct("bits", "a", "b")).alias("one"), ((F.max("n") > 1) | (F.min(pair) != F.max(pair))).alias("more"))
    near = materialise(near.select("la", "lb", "one.a", "one.b", "more"), "closest")
    if near.isEmpty():
        return labels
    links = verified(near.select("a", "b"), docs, classes)
    open_ = near.where("more").join(links, ["a", "b"], "left_anti")
    ends = materialise(open_.select(F.col("la").alias("label")).union(open_.select("lb")).distinct(), "open")
    after = merged(labels, links)
    if ends.isEmpty():
        return after
    left = rows.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(ends, "label", "left_semi").select("sig", "cls")
    rest = compared(left, after, classes, False).select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    return merged(after, verified(materialise(rest, "others"), docs, classes))


def _round(docs: DataFrame, classes: DataFrame, labels: DataFrame, shared: DataFrame, info: DataFrame, level: int, frequent: int) -> tuple[DataFrame, DataFrame | None]:
    """Labels known after this level, and the classes that it has not covered; the last level covers all."""
    info = info.withColumn("h", F.col("h") if level != 1 else F.floor(F.col("h") / 2))
    rows = materialise(_prefixes(shared, info), f"prefixes-{level}")
    labels = _stars(docs, classes, labels, rows)
    first = rows.where(F.col("place") <= F.col("h") + 1).select("sig", "cls", "k")
    if level == 2:
        return _linked(docs, classes, labels, first), None
    labels = _linked(docs, classes, labels, first.where(F.col("k") <= frequent))
    hot = first.where(F.col("k") > frequent).join(labels, "cls", "left").select("sig", "cls", F.coalesce("label", "cls").alias("label"))
    mixed = hot.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    spoiled = info.where(F.col("usable") <= F.col("h")).select("cls")  # these may share no signature with a similar set
    return labels, materialise(hot.join(mixed, "sig").select("cls").union(spoiled).distinct(), f"uncovered-{level}")


def cluster(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """did, th, n, component, label for every row of ``docs`` (doc_id, text): component is its least doc_id, label one of its classes."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), "text").withColumn("th", F.xxhash64("text"))
    for seed in range(64):
        shared, info, of = _index(docs, 0, seed)
        classes = of.where("cls is not null").groupBy("cls").agg(F.min(F.struct("did", "th")).alias("one"), F.min(F.when(F.col("did") > -(1 << 63), F.col("did"))).alias("least"), F.first("n").alias("n"), F.first("bitmap", True).alias("bitmap"), F.min("again").alias("lo"), F.max("again").alias("hi"))
        classes = materialise(classes.select("cls", "one.*", "least", "n", "bitmap", "lo", "hi"), "classes")
        if classes.where("lo <> hi").isEmpty():
            break
    labels = docs.sparkSession.createDataFrame([], "cls long, label long")
    for level in range(3):
        if level:
            some = uncovered.join(classes, "cls").select("did", "th")
            shared, info, _ = _index(docs.join(maybe_broadcast(some), ["did", "th"], "left_semi"), level, seed)
        labels, uncovered = _round(docs, classes, labels, shared, info, level, frequent)
        if uncovered is None or uncovered.isEmpty():
            break
    named = classes.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "least")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    return of.join(named.join(least, "label").select("cls", "label", "component"), "cls", "left").select("did", "th", "n", "component", "label")


def report(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    doc_id = F.when(F.col("did") > -(1 << 63), F.col("did"))
    return cluster(docs, frequent).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", doc_id).alias("component_id"))


def keep_one(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row of each component: of the lowest doc_id, nulls last, then of the least text hash; of equal rows without shingles one."""
    found = materialise(cluster(docs, frequent).groupBy("did", "th", "label").agg(F.count(F.lit(1)).alias("times")), "rows")
    rank = F.struct(F.col("did") == -(1 << 63), "did", "th", "times")
    first = found.where("label is not null").groupBy("label").agg(F.min(rank).alias("r")).select("r.did", "r.th", "r.times")
    ids = materialise(first.unionByName(found.where("label is null").select("did", "th", "times")), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of theirs can clash
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"))
    kept = keyed.join(maybe_broadcast(ids), ["did", "th"])
    out = kept.where("times = 1").select("row.*")
    if not ids.where("times > 1").isEmpty():  # only repeated rows are brought together
        out = out.unionByName(kept.where("times > 1").groupBy("did", "th").agg(F.first("row").alias("row")).select("row.*"))
    return out
