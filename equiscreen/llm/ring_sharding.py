"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

A key's home is the virtual node at or clockwise after its place on the ring.  Every shard takes its bounded
load and no more; keys that find their shard full go on clockwise to the next virtual node of a shard with
room.  The bounded loads are n // shards or one more, so row counts differ by at most one.

Scale: rows are reduced to (id, size, crc) in one scan.  Everything that decides who overflows is counts of
at most ``shards * vnodes`` arcs, so a few hundred numbers are walked whatever the input's size; the rows
themselves are numbered in windows of (arc, salt, sub), into more of which a hot key is split the more rows it has, and meet two small
tables: one of a size that the parameters bound, and a row for each window.

Defined results: null text has size 1 and crc32 of the empty text; a null id is a key like any other;
repeated rows are placed one by one; very long texts count whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast

#: Places on the ring; a virtual node or a key has one of them.
RING = 1 << 16
#: Salts by key; the rows of an arc and salt are numbered in more parts, by row, the more they are: about PART rows each.
SALTS, PART = 16, 500_000


def ring_table(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(place, arc, arc_shard) for every place of the ring: RING rows, whatever the data are."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("s"), F.floor(F.col("id") / shards).cast("int").alias("v"))
        .select("s", F.pmod(F.xxhash64(F.lit("node"), "s", "v"), F.lit(RING)).alias("place"))
        .groupBy("place").agg(F.min("s").alias("s"))
    )
    after = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    first = nodes.agg(F.min_by(F.struct(F.col("place").alias("arc"), F.col("s").alias("arc_shard")), "place").alias("first"))
    found = F.last(F.when(F.col("s").isNotNull(), F.struct(F.col("place").alias("arc"), F.col("s").alias("arc_shard"))), ignorenulls=True)
    return (
        spark.range(RING).select(F.col("id").alias("place")).join(F.broadcast(nodes), "place", "left")
        .select("place", found.over(after).alias("found"))
        .join(F.broadcast(first))
        .select("place", F.coalesce("found", "first").alias("found")).select("place", "found.*")
    )


def walk_ring(arcs: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """Which ranks of each arc go to which shard.

    ``arcs``: (place, shard, keys) clockwise, every arc of the ring, at most shards * vnodes of them.  Gives
    dicts (arc, from, to, shard, slot): keys of that arc ranked [from, to) get slots from ``slot`` on.
    In every round, arcs offer what is left of their keys to the next arc whose shard has room; a shard takes
    offers clockwise from the arc itself until it is full.  Each round but the last closes a shard.
    """
    total = sum(n for _, _, n in arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    waiting = [(i, 0, n) for i, (_, _, n) in enumerate(arcs) if n]
    plan: list[dict] = []
    while waiting:
        open_ = [i for i, (_, s, _) in enumerate(arcs) if room[s]]
        if not open_:  # only shards without virtual nodes have room left: they take the rest in turn
            for i, lo, hi in waiting:
                for s in range(shards):
                    take = min(hi - lo, room[s])
                    if take:
                        plan.append({"arc": arcs[i][0], "from": lo, "to": lo + take, "shard": s, "slot": used[s]})
                        used[s], room[s], lo = used[s] + take, room[s] - take, lo + take
            break
        offers: dict[int, list] = {}
        at = 0
        for i, lo, hi in waiting:
            while at < len(open_) and open_[at] < i:
                at += 1
            target = open_[at % len(open_)]
            offers.setdefault(target, []).append(((target - i) % len(arcs), i, lo, hi))
        waiting = []
        for target in sorted(offers):
            s = arcs[target][1]
            for _, i, lo, hi in sorted(offers[target]):
                take = min(hi - lo, room[s])
                if take:
                    plan.append({"arc": arcs[i][0], "from": lo, "to": lo + take, "shard": s, "slot": used[s]})
                    used[s] += take
                    room[s] -= take
                if lo + take < hi:
                    waiting.append((i, lo + take, hi))
        waiting.sort()
    return plan


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "ring-rows",
    )
    ring = ring_table(spark, shards, vnodes)
    keyed = (
        rows.withColumn("place", F.pmod(F.xxhash64(F.lit("key"), "doc_id"), F.lit(RING)))
        .withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).cast("int"))
        .join(F.broadcast(ring), "place")
    )
    loads = keyed.groupBy("arc", "salt").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    loads = materialise(loads, "ring-loads")  # at most shards * vnodes * SALTS rows
    keyed = keyed.join(F.broadcast(loads), ["arc", "salt"]).withColumn("sub", F.pmod(F.xxhash64("uid"), "parts").cast("int")).drop("parts")
    counts = materialise(keyed.groupBy("arc", "salt", "sub").agg(F.count(F.lit(1)).alias("n")), "ring-counts")
    have = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards * vnodes rows
    arcs = [(r["arc"], r["arc_shard"], have.get(r["arc"], 0)) for r in ring.select("arc", "arc_shard").distinct().collect()]
    plan = json.dumps(walk_ring(sorted(arcs), shards))
    kind = "array<struct<arc:bigint,`from`:bigint,`to`:bigint,shard:int,slot:bigint>>"
    spans = (
        spark.range(1).select(F.inline(F.from_json(F.lit(plan), kind)))
        .groupBy("arc").agg(F.collect_list(F.struct("from", "to", "shard", "slot")).alias("spans"))
    )
    before = Window.partitionBy("arc").orderBy("salt", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("arc", "salt", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("arc", "salt", "sub").orderBy("doc_id", "text_crc32", "uid")) - 1
    span = F.filter("spans", lambda x: (F.col("rank") >= x["from"]) & (F.col("rank") < x["to"]))[0]
    return (
        keyed.withColumn("number", number)
        .join(maybe_broadcast(starts), ["arc", "salt", "sub"])  # at most shards * vnodes * SALTS rows, and one more for each ``part`` rows
        .join(F.broadcast(spans), "arc")
        .withColumn("rank", F.col("start") + F.col("number"))
        .withColumn("span", span)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("span.shard").alias("shard"),
            (F.col("span.slot") + F.col("rank") - F.col("span.from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("arc_shard").alias("home_shard"),
        )
    )
