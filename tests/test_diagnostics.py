"""Analysis documents, header families and layout normalisation."""

import json

from pyspark.sql import functions as F

from equiscreen.operators import diagnostics


def test_analysis_errors(spark):
    good = {"ticker": "A", "scores": {"confidence_score": 6, "evidence_quality_score": 3}, "scenarios": {"bull": {"probability": 30}, "base": {"probability": 50}, "bear": {"probability": 20}}, "final_result": {"final_category": "WATCH", "confidence_level": "LOW"}}
    bad = {"scores": {"confidence_score": 8, "evidence_quality_score": 3, "moat": 11}, "scenarios": {"bull": {"probability": 30}, "base": {"probability": 50}, "bear": {"probability": 30}}, "final_result": {"final_category": "?"}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "not json"), (4, None)], "id int, doc string")
    errors = diagnostics.analysis_errors("doc", ["ticker"], ["confidence_score", "moat"], ["bull", "base", "bear"], ["WATCH"], ["LOW"])
    got = {r["id"]: r["e"] for r in df.select("id", errors.alias("e")).collect()}
    assert got[1] == []
    assert set(got[2]) == {"missing_top_level_field:ticker", "invalid_score_0_10_or_null:moat", "confidence_score_too_high:evidence_quality_score", "scenario_probabilities_must_sum_100", "invalid_final_category", "invalid_confidence_level"}
    assert "analysis_json_must_be_object" in got[3] and "analysis_json_must_be_object" in got[4]


def test_files_and_layouts(spark, tmp_path):
    spark.createDataFrame([("A", "Alpha", "XPAR")], "symbol string, company_name string, mic string").write.parquet(str(tmp_path / "p"))
    row = diagnostics.file_set_profile(spark.read.parquet(str(tmp_path / "p"))).where("rows > 0").first()
    assert row["route"] == "PARSE" and row["has_mic_or_venue_like_header"] and not row["has_currency_like_header"] and row["size"] > 0
    df = spark.createDataFrame([("1.5", "2.5")], "old string, new string")
    out = diagnostics.normalised(df, [{"score": "old"}, {"score": "new", "x": "gone"}], {"score": "double", "x": "string"})
    assert tuple(out.first()) == (2.5, None)


def test_classes(spark):
    df = spark.createDataFrame([("Equity", "CBBC"), ("Equity", "Acme"), ("?", "Acme")], "a string, b string")
    got = [r[0] for r in df.select(diagnostics.diagnostic_class([F.col("a"), F.col("b")], diagnostics.HKEX_OTHER, diagnostics.HKEX_EQUITY)).collect()]
    assert got == ["NON_ORDINARY_OR_REVIEW_REQUIRED", "EQUITY_CANDIDATE_DIAGNOSTIC_ONLY", "UNKNOWN_REVIEW_REQUIRED"]
