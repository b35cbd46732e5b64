"""Greedy acceptance on two keys (R6): a row is accepted if no earlier accepted row has one of its keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .orderings import settled, small

#: Pairs that one task may walk, in order; rounds after which what is left is parted into its components.
LOCAL, ROUNDS = 100_000, 6


def _walk(pairs: pd.DataFrame) -> pd.DataFrame:
    """The loop itself, over a bounded number of pairs."""
    pairs = pairs.sort_values("__o")
    left, right, out = set(), set(), []
    for a, b, o in zip(pairs["__a"], pairs["__b"], pairs["__o"], strict=True):
        a, b = None if pd.isna(a) else a, None if pd.isna(b) else b
        if a not in left and b not in right:
            out.append(o)
            left |= {a} - {None}
            right |= {b} - {None}
    return pairs[pairs["__o"].isin(out)]


def _walked(rest: DataFrame, groups: str) -> DataFrame:
    """The accepted of ``rest``, each of whose groups is walked in one task."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        return _walk(pairs)[["__a", "__b", "__o"]]

    kinds = dict(rest.dtypes)
    return rest.groupBy(groups).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("__a", "__b", "__o")))


def components(rest: DataFrame) -> DataFrame:
    """``rest`` (__a, __b, __o) with __c: the same for pairs that are linked through shared keys, the least __o among them.

    Every pair starts with its own label.  In a round, a label hooks to the least label that its pairs meet through their
    keys, and hooks are followed to their ends by doubling.  All labels but the least of their neighbours go in every round, so
    rounds grow with the logarithm of the number of pairs, and so do the doublings of a round.
    """
    rows = settled(rest.withColumn("__c", F.col("__o")))
    while True:
        least = [rows.where(f"{k} is not null").groupBy(k).agg(F.min("__c").alias(f"{k}_c")) for k in ("__a", "__b")]
        met = rows.join(least[0], "__a", "left").join(least[1], "__b", "left").withColumn("__m", F.least("__c", "__a_c", "__b_c"))
        hooks = settled(met.groupBy("__c").agg(F.min("__m").alias("__m")))
        if hooks.where("__m < __c").isEmpty():
            return rows
        while True:
            above = hooks.select(F.col("__c").alias("__m"), F.col("__m").alias("__mm"))
            further = settled(hooks.join(small(above), "__m").select("__c", F.col("__mm").alias("__m"), (F.col("__mm") < F.col("__m")).alias("__moved")))
            hooks = further.select("__c", "__m")
            if further.where("__moved").isEmpty():
                break
        rows = settled(rows.join(small(hooks), "__c").select("__a", "__b", "__o", F.col("__m").alias("__c")))


def greedy_two_keys(df: DataFrame, a: str, b: str, order: str = "input_ordinal", local: int = LOCAL, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with accepted.  ``order`` is different in every row.  A null is no key: it equals no other.

    Rounds settle what is the earliest under both of its keys, and what shares a key with it.  That leaves long chains, of which
    a round settles one link: after ``rounds`` rounds what is left is parted into components, and those of at most ``local``
    pairs are walked, each in one task; only larger ones go on in rounds.
    """
    free = df.where(F.col(a).isNull() & F.col(b).isNull()).select(F.col(order).alias("__o"))
    rest = df.where(F.col(a).isNotNull() | F.col(b).isNotNull()).groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.min(order).alias("__o"))
    rest = settled(rest)
    done = [free]
    n, turn = rest.count(), 0
    while n:
        turn += 1
        if n <= local:
            done.append(settled(_walked(rest.withColumn("__c", F.lit(0)), "__c")).select("__o"))
            break
        if turn % rounds == 0:
            parted = components(rest)
            sizes = settled(parted.groupBy("__c").agg(F.count(F.lit(1)).alias("__size")).withColumn("__fits", F.col("__size") <= local))
            parted = settled(parted.join(small(sizes), "__c"))
            packs = F.pmod(F.xxhash64("__c"), F.lit(-(-n // local)))  # about ``local`` pairs each, whole components
            done.append(settled(_walked(parted.where("__fits").withColumn("__g", packs), "__g")).select("__o"))
            rest = settled(parted.where("not __fits").select("__a", "__b", "__o"))
        else:
            first = [rest.where(f"{k} is not null").groupBy(k).agg(F.min("__o").alias(f"{k}_o")) for k in ("__a", "__b")]
            now = rest.join(first[0], "__a", "left").join(first[1], "__b", "left").where("coalesce(__a_o, __o) = __o and coalesce(__b_o, __o) = __o").select("__a", "__b", "__o")
            now = settled(now)
            # an accepted pair leaves by its own order, as a null key finds nothing
            rest = rest.join(now.select("__a"), "__a", "left_anti").join(now.select("__b"), "__b", "left_anti").join(now.select("__o"), "__o", "left_anti")
            rest = settled(rest.select("__a", "__b", "__o"))
            done.append(now.select("__o"))
        n = rest.count()
    taken = done[0]
    for d in done[1:]:
        taken = taken.unionByName(d)
    return df.join(taken.select(F.col("__o").alias(order), F.lit(True).alias("accepted")), order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
