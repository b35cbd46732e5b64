"""Order statistics and ranks of tables of any size: exact, with no task that holds a group."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Values that a task may sort at once; bins into which a round splits a range.
SMALL, BINS = 10_000, 1024
#: Rows of a table of a few numbers a row that may be broadcast (40 MB or so once hashed).
BROADCAST_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the session's checkpoint folder names it.

    A temporary folder is made only where none is named and all of Spark is one process; elsewhere that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return named or sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut: a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """All ``names`` are equal on both sides; nulls are equal."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on ``names`` for which nulls are equal; the names come once."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    when = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    return left.join(other, when, how).drop(*[f"__{n}" for n in names])


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] | None = None, most: int = SMALL, bins: int = BINS) -> DataFrame:
    """``keys``, metric, n, q: the exact quantiles (linear between neighbours) of every column, by group; nulls and NaN do not count.

    Selection by rounds.  Every wanted rank has a range that holds it; a round counts a range's values in ``bins`` equal
    parts, with the least and greatest of each, and the part with the rank is the next range.  It ends where a range has one value
    or at most ``most`` rows, which are then sorted.  Counts are summed before the shuffle, so no task ever holds more of a group than
    ``bins`` counts or ``most`` values; rows that are in no range any more are not read on.
    """
    keys = list(keys or [])
    by = [*keys, "metric"]
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), X.real(c).alias("value")) for c in columns])
    rows = settled(df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").where("value is not null"))
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") + 1 for p in place for f in (F.floor, F.ceil)]))
    targets = settled(stats.select(*by, "n", "lo", "hi", F.col("n").alias("m"), F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("rank")))
    half = lambda c: F.col(c) / 2  # noqa: E731  differences of the greatest doubles do not overflow
    part = F.least(F.lit(bins - 1), F.floor((half("value") - half("lo")) / (half("hi") - half("lo")) * bins)).cast("int")
    while True:
        wide = (F.col("m") > most) & (F.col("lo") < F.col("hi"))
        open_ = targets.where(wide)
        if open_.isEmpty():
            break
        ranges = open_.select(*by, "lo", "hi").distinct()
        inside = joined(rows, small(ranges), by).where("value between lo and hi").withColumn("part", part)
        counts = inside.groupBy(*by, "lo", "hi", "part").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("a"), F.max("value").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*by, "lo", "hi").orderBy("part"))  # at most ``bins`` rows each
        found = joined(open_, counts.withColumn("upto", upto), [*by, "lo", "hi"]).where("rank > before + upto - c and rank <= before + upto")
        found = found.select(*by, "n", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("c").alias("m"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"), "rank")
        targets = settled(targets.where(~wide).unionByName(found))
    few = targets.where("lo < hi")
    held = joined(rows, small(few.select(*by, "lo", "hi").distinct()), by).where("value between lo and hi")
    sorted_ = held.groupBy(*by, "lo", "hi").agg(F.array_sort(F.collect_list("value")).alias("values"))  # at most ``most`` values
    picked = joined(few, sorted_, [*by, "lo", "hi"]).withColumn("value", F.get("values", (F.col("rank") - F.col("before") - 1).cast("int"))).select(*by, "n", "rank", "value")
    picked = picked.unionByName(targets.where("lo = hi").select(*by, "n", "rank", F.col("lo").alias("value")))
    made = picked.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a quantile
    value = lambda p, f: F.element_at("at", f(p).cast("long") + 1)
    q = [F.when(F.floor(p) == F.ceil(p), value(p, F.floor)).otherwise((F.ceil(p) - p) * value(p, F.floor) + (p - F.floor(p)) * value(p, F.ceil)) for p in place]
    return made.select(*by, "n", F.array(*q).alias("q"))


def counted(df: DataFrame, names: list[Column], alias: str) -> DataFrame:
    """``df`` with the number of rows that have the same ``names``, by sums and a join: a group that all rows share is no task's."""
    marked = df.withColumns({f"__k{i}": c for i, c in enumerate(names)})
    by = [f"__k{i}" for i in range(len(names))]
    return joined(marked, small(marked.groupBy(*by).agg(F.count(F.lit(1)).alias(alias))), by, "left").drop(*by)


def ranked(df: DataFrame, keys: list[str], score: str, alias: str, descending: bool = True) -> DataFrame:
    """``df`` with the competition rank of ``score`` within ``keys`` (1, 2, 2, 4); null scores come last.

    Rows are counted by score; the scores are dealt by ranges of (keys, score), summed within a range and over the ranges before
    it, and joined back.  So no task has a group's rows, and none but its own range of scores.
    """
    order = F.desc_nulls_last(score) if descending else F.asc_nulls_last(score)
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__n"))
    dealt = settled(counts.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    places = joined(dealt.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))), small(starts), [*keys, "__range"])
    places = places.select(*keys, score, (F.col("__start") + F.col("__before") + 1).alias(alias))
    return joined(df, small(places), [*keys, score])
