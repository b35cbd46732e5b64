"""Aggregates and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of
from .orderings import exact_quantiles, joined


def value_counts(df: DataFrame, c: str, n: int | None = 20, missing: str | None = None) -> DataFrame:
    """Counts, most first; nulls are dropped, or counted as ``missing``."""
    v = F.coalesce(X.blank_to_null(c), F.lit(missing)) if missing else F.col(c)
    out = df.select(v.alias(c)).where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    return out if n is None else out.orderBy(F.desc("count"), c).limit(n)


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts; rows with a null key are not counted."""
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def reason_counts(df: DataFrame, reasons: str, *keys: str, separator: str = ",") -> DataFrame:
    """A4: counts of each listed reason."""
    return df.select(*keys, F.explode(X.parts(reasons, separator)).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("count"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, min, quartiles, max, mean of each column, long form: one aggregate, and exact quartiles by rounds."""
    made = [F.struct(F.lit(c).alias("metric"), F.count(X.real(c)).alias("count"), F.min(X.real(c)).alias("min"), F.max(X.real(c)).alias("max"), F.avg(X.real(c)).alias("mean")) for c in columns]
    out = df.agg(F.array(*made).alias("m")).select(F.inline("m")).join(exact_quantiles(df, columns, [0.25, 0.5, 0.75]), "metric", "left")
    return out.select("metric", "count", *[X.rounded(e, 4).alias(n) for n, e in (("min", F.col("min")), ("p25", F.col("q")[0]), ("median", F.col("q")[1]), ("p75", F.col("q")[2]), ("max", F.col("max")), ("mean", F.col("mean")))])


def group_medians(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows and exact medians by group."""
    found = exact_quantiles(df, columns, [0.5], [key]).groupBy(key).agg(*[F.max(F.when(F.col("metric") == c, F.col("q")[0])).alias(f"median_{c}") for c in columns])
    return joined(df.groupBy(key).agg(F.count(F.lit(1)).alias("count")), found, [key], "left")


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present, missing and percent of each column, long form; blank is missing."""
    n = F.count(F.lit(1))
    made = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(X.blank_to_null(c)).alias("present"), n.alias("total")) for c in columns])
    out = df.agg(made.alias("m")).select(F.inline("m"))
    return out.select("column_name", "present", (F.col("total") - F.col("present")).alias("missing"), X.rate(F.col("present"), F.col("total")).alias("coverage_percent"))


def missing_by_row(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A13."""
    flags = [F.when(X.is_blank(c), F.lit(c)) for c in columns]
    n = reduce(lambda a, b: a + b, [X.is_blank(c).cast("int") for c in columns])
    return df.select(key, n.alias("missing_count"), F.concat_ws("|", *flags).alias("missing_columns"))


def coverage_summary(coverage: DataFrame, core: list[str] | None = None) -> DataFrame:
    """How well the ``core`` columns (all, unless told) are filled: their number, mean (0 of none) and how many are full."""
    rows = coverage if core is None else coverage.where(F.col("column_name").isin(core))
    return rows.agg(F.count(F.lit(1)).alias("columns"), F.coalesce(F.avg("coverage_percent"), F.lit(0.0)).alias("avg_coverage_percent"), F.count_if(F.col("coverage_percent") == 100).alias("full_columns"))


def least_covered(coverage: DataFrame, core: list[str] | None = None, n: int = 10) -> DataFrame:
    """The ``core`` columns that miss most (a report)."""
    rows = coverage if core is None else coverage.where(F.col("column_name").isin(core))
    return rows.orderBy("coverage_percent", "column_name").limit(n).select("column_name", "coverage_percent", "missing")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def duplicate_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Number of duplicate keys, rows too many, rows that share a key."""
    return duplicate_keys(df, *keys).agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"), F.coalesce(F.sum("count"), F.lit(0)).alias("sharing_rows"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """A16."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in columns])


def provider_breakdown(df: DataFrame, c: str = "source_provider", blank: str = "UNKNOWN") -> DataFrame:
    """A20."""
    return df.groupBy(F.coalesce(X.blank_to_null(c), F.lit(blank)).alias(c)).agg(F.count(F.lit(1)).alias("count"))


def expected_vs_actual(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Both have ``count``; status OK, MISMATCH (also where nothing is there) or UNEXPECTED_PROVIDER."""
    both = counts.withColumnRenamed("count", "actual").join(expected.withColumnRenamed("count", "expected"), key, "full_outer")
    status = first_of([("UNEXPECTED_PROVIDER", F.col("expected").isNull()), ("OK", F.col("actual") == F.col("expected"))], "MISMATCH")
    return both.withColumn("status", status).fillna(0, ["actual", "expected"])


def integrity_checks(df: DataFrame, keys: tuple[str, str], required: list[str], expected_rows: int | None = None) -> DataFrame:
    """A row for each check: name, severity, observed, passed.  Two aggregates, whatever the number of checks."""
    blanks = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(X.is_blank(c), 1)).alias(f"blank_{c}") for c in required])
    one = blanks.join(duplicate_summary(df, *keys))
    checks = [("rows_present", "critical", F.col("rows"), F.col("rows") > 0 if expected_rows is None else F.col("rows") == expected_rows), ("no_duplicate_keys", "critical", F.col("duplicate_keys"), F.col("duplicate_keys") == 0)]
    checks += [(f"no_blank_{c}", "critical" if c in keys else "warning", F.col(f"blank_{c}"), F.col(f"blank_{c}") == 0) for c in required]
    made = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), v.cast("long").alias("observed"), p.alias("passed")) for n, s, v, p in checks])
    return one.select(F.inline(made))


def integrity_status(checks: DataFrame) -> DataFrame:
    """A23, A34."""
    failed = lambda s: F.count(F.when(~F.col("passed") & (F.col("severity") == s), 1))
    out = checks.agg(F.count(F.lit(1)).alias("checks"), failed("critical").alias("critical_failures"), failed("warning").alias("warnings"))
    return out.withColumn("status", gate([("FAILED", F.col("critical_failures") > 0), ("PASSED_WITH_WARNINGS", F.col("warnings") > 0)], "PASSED"))


def gate(cases: list[tuple[str, Column]], default: str) -> Column:
    """Thresholds to a status."""
    return first_of(cases, default)


def coverage_metrics(candidates: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, distinct keys, overlap, net new and gain over the baseline; one row."""
    base = baseline.select(*keys).distinct().withColumn("__in", F.lit(True))
    found = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(base, keys, "left")
    out = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_rows"), F.count(F.lit(1)).alias("candidate_keys"), F.count("__in").alias("overlap_keys")).join(base.agg(F.count(F.lit(1)).alias("baseline_keys")))
    return out.withColumn("net_new_keys", F.col("candidate_keys") - F.col("overlap_keys")).withColumn("gain_percent", X.rate(F.col("net_new_keys"), F.col("baseline_keys")))


def status_matrix(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of ``a`` by the given values of ``b``, wide."""
    return df.groupBy(a).agg(*[F.count(F.when(F.col(b) == v, 1)).alias(v) for v in values])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A26."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, d in tables.items()])


def cost_totals(df: DataFrame, cost: str = "cost", model: str = "model") -> DataFrame:
    """A27."""
    return df.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(cost), F.lit(0)).alias("total_cost"), F.array_join(F.array_sort(F.collect_set(model)), ", ").alias("models"))


def spend(df: DataFrame, stamp: str, cost: str, unit: str, limit: float) -> DataFrame:
    """Cost by day or month against a limit."""
    return df.groupBy(F.date_trunc(unit, F.col(stamp)).alias("period")).agg(F.sum(cost).alias("cost")).withColumn("over_limit", F.col("cost") > limit)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric, before, after, delta of two one-row summaries with the same columns."""
    names = before.columns
    pairs = before.select(*[F.col(c).cast("double").alias(f"b_{c}") for c in names]).join(after.select(*[F.col(c).cast("double").alias(f"a_{c}") for c in names]))
    made = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")) for c in names])
    return pairs.select(F.inline(made)).withColumn("delta", F.col("after") - F.col("before"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Stage, in, passed and pass rate of each classified frame."""
    rows = []
    for name, df in stages.items():
        n = F.count(F.lit(1))
        passed = F.count(F.when(F.col(f"{name}_status") == "PASSED", 1))
        rows.append(df.agg(n.alias("companies"), passed.alias("passed")).select(F.lit(name).alias("stage"), "companies", "passed", X.rate(F.col("passed"), F.col("companies")).alias("pass_rate_percent")))
    return reduce(DataFrame.unionByName, rows)


def table_profile(df: DataFrame, ticker: str) -> DataFrame:
    """Rows, columns, empty, duplicate and unique tickers."""
    t = X.ticker(ticker)
    keys = df.groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("t") != ""
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("empty_tickers"), F.count(F.when(filled, 1)).alias("unique_tickers"), F.coalesce(F.sum(F.when(filled, F.col("n") - 1)), F.lit(0)).alias("duplicate_tickers"))
    return out.withColumn("columns", F.lit(len(df.columns)))


def bucketed(df: DataFrame) -> DataFrame:
    """cap, price and dollar-volume buckets."""
    cap = [(1e8, "<100M"), (3e8, "100M-300M"), (1e9, "300M-1B"), (1e10, "1B-10B"), (5e10, "10B-50B")]
    price = [(1, "<1"), (2, "1-2"), (5, "2-5"), (20, "5-20"), (100, "20-100")]
    volume = [(5e5, "<500K"), (1e6, "500K-1M"), (5e6, "1M-5M"), (2e7, "5M-20M"), (1e8, "20M-100M")]
    return df.withColumns({"market_cap_bucket": X.bucket(X.real("market_cap"), cap, ">50B"), "price_bucket": X.bucket(X.real("price"), price, ">100"), "dollar_volume_bucket": X.bucket(X.real("dollar_volume_90d"), volume, ">100M")})


def history_summary(df: DataFrame, category: str, confidence: str, risk: str) -> DataFrame:
    """Rows, means, and rows whose category says high quality or too little data."""
    has = lambda words: F.count_if(F.coalesce(F.col(category), F.lit("")).contains(words))
    return df.agg(F.count(F.lit(1)).alias("companies"), F.avg(confidence).alias("avg_confidence"), F.avg(risk).alias("avg_risk"), has("Alta calidad").alias("high_quality_count"), has("Datos insuficientes").alias("insufficient_data_count"))
