"""The prefix trie of conversations, by truncation peeling.

Conversations that start with the same turns share the nodes of these turns.  A node is known by a chain of SHA-256
digests over its turns, so texts are read once and never shuffled.  From the greatest depth down, the
conversations that end there join the nodes that survive from below; a level is grouped by node, its sums are final,
and every node loses its last turn and goes on as a contribution to its parent.  Members, the smallest of them, leaves
and saved bytes are gathered on this one way down.

Scale: the nodes with more than ``GROUP`` members ("heavy": at most one for each GROUP rows) are found by counting, with partial
sums before the shuffle.  Below them each conversation has its first light node; those that share it, GROUP at
most, are peeled in one task, which holds one level of them and reads the rest as a stream.  What they hand on is summed
by Spark, a round for each depth of heavy nodes; a heavy node's members, however many, are counted and summed, never
gathered, but their ids pass through one task as a sorted stream, as the SHA-256 of their list is taken in that order.

Defined results: turns are ordered by turn, nulls first, ties by role, then by the text's digest; null role or text is the
empty text; repeated rows are turns of their own; very long texts count whole; rows whose conv_id is null belong to no
conversation and give no node; an empty table gives no nodes; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialise, maybe_broadcast, tidy

#: Members of nodes that are peeled within a task, at most.
GROUP = 4096
#: Rows of a batch that a task gives.
BATCH = 4096
ROOT = hashlib.sha256(b"").digest()
CHAIN = "conv_id long, depth long, node binary, parent binary, size long, ends boolean"
NODE = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and size (UTF-8 bytes of the text) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("conv_id", "place", "digest", "size")


def rebuilt(rows: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c starts with the first h turns of c - c % ``every`` and goes on with its own
    turns after its first h, where h is crc32(c) % ``most``; conversations that are left without turns are among the second."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    firsts = rows.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "digest", "size")
    given = firsts.join(convs, "base").where(F.col("place") <= F.col("h")).select("conv_id", "place", "digest", "size")
    lengths = firsts.groupBy("base").agg(F.max("place").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    own = rows.withColumn("h", h).where(F.col("place") > F.col("h")).withColumn("base", base).join(lengths, "base", "left")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("place"), "digest", "size")
    return given.unionByName(own), convs.select("conv_id")


def chains(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0: its node there, that node's parent, and whether it ends there."""
    whole = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size")))
    after = F.lead("place").over(Window.partitionBy("conv_id").orderBy("place"))
    whole = whole.withColumn("ends", after.isNull())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = ROOT  # of the turn before: rows come by conversation and place
        for b in batches:
            nodes, parents = [], []
            for depth, digest in zip(b.column("place").to_pylist(), b.column("digest").to_pylist(), strict=True):
                parents.append(node if depth else None)
                node = hashlib.sha256(node + digest).digest() if depth else ROOT
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column("size"), b.column("ends")], names=["conv_id", "depth", "node", "parent", "size", "ends"])

    # the window leaves each conversation in one partition and in this order; sorting says so once more
    return whole.sortWithinPartitions("conv_id", "place").mapInArrow(run, CHAIN)


class Level:
    """The nodes of one depth of one group: node -> [parent, size, members, least, children, leaves, saved, hash of ends]."""

    @staticmethod
    def new(parent: bytes | None, size: int) -> list:
        return [parent, size, 0, None, 0, 0, 0, None]

    @staticmethod
    def finish(level: dict[bytes, list]) -> None:
        for x in level.values():
            x[5] = x[5] or 1  # a node without children is a leaf
            x[6] += (x[2] - 1) * x[1]

    @staticmethod
    def strip(level: dict[bytes, list], above: dict[bytes, list]) -> None:
        """Every node loses its last turn and joins its parent, which is in ``above`` already: a member's own row says so."""
        for x in level.values():
            p = above[x[0]]
            p[2] += x[2]
            p[3] = x[3] if p[3] is None else min(p[3], x[3])
            p[4] += 1
            p[5] += x[5]
            p[6] += x[6]


def peel(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of light groups: ``rows`` are (top, depth, node, conv_id, parent, size, ends) by top, depth from the greatest, node
    and conv_id.  The parent_conv_id of a group's top is not known here and stays null."""
    top, depth, level, below = None, None, {}, {}

    def made(nodes: dict[bytes, list], d: int, parents: dict[bytes, list] | None) -> Iterator[tuple]:
        for node, x in nodes.items():
            yield node, x[0], x[3], d, parents[x[0]][3] if parents else None, x[2], x[4], x[5], x[6], (x[7] or hashlib.sha256()).hexdigest()

    def close() -> Iterator[tuple]:
        """``level`` has all its rows: what is left of the level below joins it, and that level's nodes are ready."""
        Level.strip(below, level)
        Level.finish(level)
        if below:
            yield from made(below, depth + 1, level)

    for t, d, node, conv, parent, size, ends in rows:
        if (t, d) != (top, depth):
            if depth is not None:
                yield from close()
                below = level
                if t != top:
                    yield from made(below, depth, None)
                    below = {}
            top, depth, level = t, d, {}
        x = level.get(node)
        if x is None:
            x = level[node] = Level.new(parent, size)
        if ends:
            x[2] += 1
            x[3] = conv if x[3] is None else min(x[3], conv)
            if x[7] is None:
                x[7] = hashlib.sha256(str(conv).encode())
            else:
                x[7].update(b",%d" % conv)
    if depth is not None:
        yield from close()
        yield from made(level, depth, None)


def ends_hash(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of the sorted conv_ids that end in each node of ``ends``: they pass as a stream."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out = []
            for n, conv in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if n != node:
                    out += [(node, h.hexdigest())] if h else []
                    node, h = n, hashlib.sha256(str(conv).encode())
                else:
                    h.update(b",%d" % conv)
            yield batch_of(out, "node binary, ends_sha256 string")
        if h:
            yield batch_of([(node, h.hexdigest())], "node binary, ends_sha256 string")

    return ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def light_nodes(rows: DataFrame) -> DataFrame:
    """The nodes below the heavy ones, as ``NODE``: ``rows`` are those of ``chains`` that are in no heavy node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for x in peel(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("top", "depth", "node", "conv_id", "parent", "size", "ends")), strict=True)):
            out.append(x)
            if len(out) == BATCH:
                yield batch_of(out, NODE)
                out = []
        if out:
            yield batch_of(out, NODE)

    top = F.first("node").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("top", top).repartition("top").sortWithinPartitions("top", F.desc("depth"), "node", "conv_id").mapInArrow(run, NODE)


def trie(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """The nodes of the conversations whose chains are ``rows`` (as ``chains`` gives them), as ``NODE``."""
    rows = materialise(rows, "trie-chains")
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.max("ends").alias("some_end"))
    heavy = materialise(counts.where(F.col("n_convs") > group), "trie-heavy")
    marked = rows.join(maybe_broadcast(heavy.select("node", F.lit(True).alias("heavy"))), "node", "left")
    light = materialise(light_nodes(marked.where(F.col("heavy").isNull()).drop("heavy")), "trie-light")

    empty = hashlib.sha256().hexdigest()
    ended = marked.where(F.col("heavy") & F.col("ends"))
    heavy = heavy.join(ends_hash(ended), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    parents = heavy.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    # tops of light groups hang from heavy nodes, or are roots
    tops = light.where(F.col("parent_conv_id").isNull()).join(maybe_broadcast(parents), "parent", "left").withColumn("parent_conv_id", F.col("of_parent")).drop("of_parent")
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]

    def handed_on(nodes: DataFrame) -> DataFrame:
        return nodes.where(F.col("parent").isNotNull()).groupBy("parent", (F.col("depth") - 1).alias("at")).agg(F.count(F.lit(1)).alias("n_children"), *sums[1:])

    deepest = heavy.agg(F.max("depth")).first()[0]
    carried, done = materialise(handed_on(tops), "trie-carried"), []
    for depth in range(-1 if deepest is None else deepest, -1, -1):  # a round for each depth of nodes with over ``group`` members
        level = (
            heavy.where(F.col("depth") == depth)
            .join(carried.where(F.col("at") == depth).select(F.col("parent").alias("node"), "n_children", "n_leaves", "saved_tokens"), "node", "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1)))
            .withColumn("saved_tokens", F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size"))
        )
        level = materialise(level, "trie-level")
        done.append(level)
        if depth:
            above = carried.where(F.col("at") < depth).unionByName(handed_on(level))
            carried = materialise(above.groupBy("parent", "at").agg(*sums), "trie-carried")
    names = [c.split()[0] for c in NODE.split(", ")]
    out = light.where(F.col("parent_conv_id").isNotNull()).select(*names).unionByName(tops.select(*names))
    for level in done:
        out = out.unionByName(level.join(maybe_broadcast(parents), "parent", "left").withColumn("parent_conv_id", F.col("of_parent")).select(*names))
    return out


def report(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, convs = rebuilt(materialise(turns(conversations), "trie-turns"))
    return trie(chains(rows, convs), group).drop("node", "parent")
