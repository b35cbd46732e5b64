"""Acceptance on two keys against the loop over rows."""

import random

import pytest

from equiscreen.operators import greedy

SCHEMA = "input_ordinal long, isin string, ticker string"


def loop(rows):
    left, right, out = set(), set(), {}
    for o, a, b in sorted(rows):
        out[o] = (a is None or a not in left) and (b is None or b not in right)
        if out[o]:
            left |= {a} - {None}
            right |= {b} - {None}
    return out


def found(spark, rows, **more):
    return {r["input_ordinal"]: r["accepted"] for r in greedy.greedy_two_keys(spark.createDataFrame(rows, SCHEMA), "isin", "ticker", **more).collect()}


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(1)
    rows = [(i, r.choice([None, "a", f"a{r.randint(0, 300)}"]), r.choice([None, "b", f"b{r.randint(0, 300)}"])) for i in range(1500)]
    return rows + [(2000 + i, None, None) for i in range(5)]


@pytest.mark.parametrize("local, rounds", [(100_000, 6), (40, 2), (0, 10**9)])
def test_nulls_ties_and_hot_keys(spark, mixed, local, rounds):
    assert found(spark, mixed if local else mixed[:150], local=local, rounds=rounds) == loop(mixed if local else mixed[:150])


def chain(n):
    return [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(n)]


def test_a_chain_of_ten_thousand(spark):
    rows = chain(10_000)
    assert found(spark, rows) == loop(rows)


def test_many_chains_longer_than_the_rounds(spark):
    """No chain fits the whole residue's bound, each fits a task."""
    rows = [(1000 * i + o, f"{a}-{i}", f"{b}-{i}") for i in range(20) for o, a, b in chain(90)]
    random.Random(3).shuffle(rows)
    assert found(spark, rows, local=120, rounds=2) == loop(rows)


def test_components(spark):
    rows = [(o, f"{a}-{i}", f"{b}-{i}") for i in range(3) for o, a, b in ((i + 3 * p, a, b) for p, (_, a, b) in enumerate(chain(300)))]
    rows.append((10_000, None, "alone"))
    df = spark.createDataFrame(rows, "__o long, __a string, __b string")
    assert {(r["__o"], r["__c"]) for r in greedy.components(df).collect()} == {(o, o % 3 if o < 10_000 else o) for o, _, _ in rows}


def test_a_million_random_pairs(spark):
    rows = spark.range(1_000_000).selectExpr("id as input_ordinal", "cast(pmod(xxhash64(id, 1), 600000) as string) as isin", "cast(pmod(xxhash64(id, 2), 600000) as string) as ticker")
    accepted = greedy.greedy_two_keys(rows, "isin", "ticker").toPandas()
    want = loop(list(accepted[["input_ordinal", "isin", "ticker"]].itertuples(index=False, name=None)))
    assert dict(zip(accepted["input_ordinal"], accepted["accepted"], strict=True)) == want
