"""Exact quantiles and ranks against plain loops, where a range, a group or a score holds most rows; and what their plans may not hold."""

import random

import numpy as np
import pytest

from equiscreen.operators import orderings, reports, scoring


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(r.choice(["a", "a", "a", "a", "b", None]), r.choice([r.random(), 7.0, 7.0, -1e300, 1e300, r.gauss(0, 1e-9), None, float("nan")]), float(r.randint(0, 5))) for _ in range(5000)]
    return out + [("one", 3.5, None), ("none", None, None)]


@pytest.mark.parametrize("most, bins", [(10_000, 1024), (5, 4), (1, 1024)])
def test_quantiles(spark, rows, most, bins):
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {(r["g"], r["metric"]): (r["n"], r["q"]) for r in orderings.exact_quantiles(df, ["x", "y"], probs, ["g"], most, bins).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            v = [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            if v:
                want[g, c] = (len(v), v)
    assert set(found) == set(want)
    for k, (n, v) in want.items():
        assert found[k][0] == n and np.allclose(found[k][1], np.quantile(v, probs), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert orderings.exact_quantiles(df, ["x"], [0.5], ["g"]).count() == 0
    assert [r["median"] for r in reports.numeric_profile(df, ["x"]).collect()] == [None]
    assert reports.group_medians(df, "g", ["x"]).count() == 0


def test_ranks(spark):
    r = random.Random(4)
    rows = [(r.choice(["s", "t", None]), r.choice([1.0, 1.0, 1.0, None, float(r.randint(0, 30))]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "scenario string, score double, i long")
    found = {x["i"]: x["place"] for x in orderings.ranked(df, ["scenario"], "score", "place").collect()}
    key = lambda v: float("-inf") if v is None else v
    by = {s: [key(x[1]) for x in rows if x[0] == s] for s in ("s", "t", None)}
    assert found == {i: 1 + sum(x > key(v) for x in by[s]) for s, v, i in rows}
    up = {x["i"]: x["place"] for x in orderings.ranked(df.where("score is not null"), ["scenario"], "score", "place", descending=False).collect()}
    assert up == {i: 1 + sum(key(v) > x > float("-inf") for x in by[s]) for s, v, i in rows if v is not None}


def test_counts(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1.0), (4, 2.0), (5, 2.0)], "i long, x double")
    assert {r["i"]: r["n"] for r in orderings.counted(df, [df["x"]], "n").collect()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2}


def test_plans_hold_no_group(spark, rows):
    """No percentile that gathers a group, no window over all rows of a scenario."""
    df = spark.createDataFrame([(r[0] or "", r[2]) for r in rows], "scenario string, scenario_score double")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan(reports.numeric_profile(df, ["scenario_score"])).lower()
    text = plan(scoring.scenario_rank(df))
    assert "rank(scenario_score" not in text
    assert all("__range" in w.split("specifiedwindowframe")[0] for w in text.split("windowspecdefinition(scenario#")[1:])
