"""Reads, projections and sentences on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from equiscreen.functions import exprs as X
from equiscreen.operators import scoring, views


def test_bridge_fills_missing_columns(spark):
    df = spark.createDataFrame([("A", 7.5)], "ticker string, final_stage3_score double")
    out = views.bridge(df, {"ticker": "ticker", "country": "country", "score": "final_stage3_score"}, "s").first()
    assert out.asDict() == {"ticker": "A", "country": None, "score": 7.5, "source": "s"}


def test_canonical_rows(spark):
    df = spark.createDataFrame([(" 7203 ", None)], "code string, name string")
    out = views.canonical(df, {"ticker": "code", "company_name": "name", "isin": "absent"}, {"exchange": "TSE"}, ["ticker", "company_name", "isin", "exchange", "mic"]).first()
    assert tuple(out) == ("7203", "", "", "TSE", "")


def test_passed_needs_its_flag(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, passes_basic_filters boolean")
    assert [r.k for r in views.passed(df).collect()] == [1] and [r.k for r in views.passed(df, False).collect()] == [2]
    with pytest.raises(ValueError, match="passes_basic_filters"):
        views.passed(df.select("k"))


def test_lookup_and_run_rows(spark):
    rows = [(1, "r1", "AB", 5.0), (2, "r1", "ab", 9.0), (3, "r1", "AB", 9.0), (4, "r2", "AB", 1.0)]
    df = spark.createDataFrame(rows, "id int, run_id string, ticker string, score_priority double")
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, created_at int")
    assert [r.id for r in views.by_ticker(df, " ab ", "r1").collect()] == [2]
    assert views.by_ticker(df, "zz", "r1").isEmpty()
    assert [r.id for r in views.run_rows(df, runs, "id").collect()] == [4]
    assert [r.id for r in views.run_rows(df, runs, F.desc("score_priority"), "id", run_id="r1").collect()] == [2, 3, 1]
    assert views.run_rows(df, runs.limit(0), "id").isEmpty()


def test_feedback_of_a_run(spark):
    feedback = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 11, 9), (4, None, 9)], "id int, signal_id int, created_at int")
    signals = spark.createDataFrame([(10, "r1"), (11, "r2")], "id int, run_id string")
    assert [r.id for r in views.feedback_of_run(feedback, signals, "r1").collect()] == [2, 1]


def test_review_counts_have_all_states(spark):
    df = spark.createDataFrame([("pending_review",), ("done",), (None,), ("pending_review",)], "manual_status string")
    assert {r.manual_status: r.n for r in views.review_counts(df).collect()} == {"pending_review": 2, "reviewed_watchlist": 0, "reviewed_reject": 0, "needs_more_data": 0}
    assert {r.n for r in views.review_counts(df.limit(0)).collect()} == {0}


def test_flattened_names_and_aliases(spark):
    df = spark.sql("select named_struct('m', named_struct('Risk_Score', 4, 'tags', array('a', 'b')), 'n', 1) as r, 2 as fcf_margin, 3 as x_fcf_margin")
    out = X.flattened(df).first().asDict()
    assert out == {"r_m_Risk_Score": 4, "r_m_tags": '["a", "b"]', "r_n": 1, "fcf_margin": 2, "x_fcf_margin": 3, "risk_score": 4}


def test_json_with_fallback(spark):
    df = spark.createDataFrame([("[1,2]",), ("",), (None,), ("[1",), ("x",)], "t string")
    assert [r.v for r in df.select(X.parsed_json(F.col("t"), "array<int>", F.array(F.lit(0))).alias("v")).collect()] == [[1, 2], [0], [0], [0], [0]]
    df = spark.createDataFrame([(1, None)], "b int, a string")
    row = df.select(X.sorted_json(df, "b", "a").alias("j")).first()
    assert row.j == '{"a": null, "b": 1}'


def test_combined_summary(spark):
    df = spark.createDataFrame([(91.06, 88.0, 70.5, 60.0, list("abcde"), [])], "t double, m double, k double, f double, up array<string>, down array<string>")
    said = df.select(scoring.combined_summary("t", "m", "k", "f", F.col("up"), F.col("down")).alias("s")).first().s
    assert said == "COMBINED_SCORE_V1 91.06: metadata 88.0, market data 70.5, fundamentales 60.0. Sube por a, b, c, d; sin alertas fuertes. No es recomendación financiera."
