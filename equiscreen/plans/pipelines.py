"""Compositions of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import reason_log
from ..operators import market, memo, reports, scoring, stages, universe, views
from ..operators.orderings import settled, small
from ..sources.readers import with_ordinal
from . import policies


def quant(companies: DataFrame, history: DataFrame) -> DataFrame:
    """Clean universe, metrics, quality, filters, scores: one lazy plan."""
    snapshot = companies.join(market.market_metrics(history), "ticker", "left")
    return scoring.priority(market.basic_filters(market.data_quality(snapshot)))


def funnel_rows(companies: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """What passes Stage 1, with its fundamentals, Stage 2 and, if it passes that, Stage 3: one plan, each table read once.

    Clashing columns of the fundamentals get a suffix.
    """
    passed = stages.stage1(companies).where("stage1_status = 'PASSED'")
    clash = [c for c in fundamentals.columns if c in passed.columns and c != "ticker"]
    second = stages.stage2(passed.join(fundamentals.withColumnsRenamed({c: f"{c}_fundamental" for c in clash}), "ticker", "left"))
    third = stages.stage3(second)
    new = [c for c in third.columns if c not in second.columns]
    return third.withColumns({c: F.when(F.col("stage2_status") == "PASSED", F.col(c)) for c in new})


def funnel(companies: DataFrame, fundamentals: DataFrame) -> dict[str, DataFrame]:
    """The frames of the three stages, each of what passed the one before."""
    rows = funnel_rows(companies, fundamentals)
    return {"stage1": stages.stage1(companies), "stage2": rows, "stage3": rows.where("stage2_status = 'PASSED'")}


def pilot(raw: DataFrame, aliases: dict[str, list[str]], n: int, order: str = "input_ordinal") -> DataFrame:
    """The first rows of a raw universe, columns resolved and parsed, through Stage 1."""
    rows = views.resolve(raw.orderBy(order).limit(n), aliases)
    parsed = rows.withColumns({c: X.money(c) for c in ("market_cap", "price", "avg_volume_90d") if c in rows.columns})
    return stages.stage1(parsed)


def institutional_cleaning(listings: DataFrame, **switches: bool) -> tuple[DataFrame, DataFrame]:
    """What is in scope, and what is not with its reason."""
    marked = universe.instrument_class(listings, **switches)
    return marked.where("instrument_scope = 'IN_SCOPE'"), marked.where("instrument_scope <> 'IN_SCOPE'")


def policy_study(rows: DataFrame, generation: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions of every policy, their rates and the advice."""
    decisions = stages.what_if(rows, policies.WHAT_IF, generation)
    rates = stages.policy_rates(decisions)
    return decisions, rates, stages.policy_decision(rates)


def alignment(real: DataFrame, simulated: DataFrame, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Both decisions side by side, and the counts of those that differ."""
    both = views.compared(real, simulated, key)
    differ = both.where(~F.col("real_decision").eqNullSafe(F.col("simulated_decision")))
    return both, differ.groupBy("real_decision", "simulated_decision", "merge_side").agg(F.count(F.lit(1)).alias("count"))


#: The reason that is replaced, the one that replaces it, codes that reject and codes that do not block.
OLD_REASON, NEW_REASON = "MISSING_SHARES_DILUTION", "MISSING_SHARES_DILUTION_PROVIDER_LIMITATION"
HARD = ("MISSING_DATA_COMPLETENESS", "LOW_DATA_COMPLETENESS", "MISSING_REVENUE", "REVENUE_NOT_POSITIVE", "OPERATING_MARGIN_TOO_NEGATIVE", "FCF_MARGIN_TOO_NEGATIVE", "DEBT_TOO_HIGH", "HIGH_DILUTION")


def provider_policy(df: DataFrame, codes: str = "stage2_all_reasons") -> DataFrame:
    """Reasons with one replaced, and the status that follows from them."""
    listed = X.parts(codes, "|")
    new = F.when(F.array_contains(listed, OLD_REASON), F.concat(F.filter(listed, lambda c: c != OLD_REASON), F.array(F.lit(NEW_REASON)))).otherwise(listed)
    rows = df.withColumn("adjusted_reasons", new)
    hard = F.exists("adjusted_reasons", lambda c: c.isin(*HARD))
    blocking = F.exists("adjusted_reasons", lambda c: c != NEW_REASON)
    return rows.withColumn("adjusted_status", F.when(hard, F.lit("REJECTED")).when(blocking, F.lit("WATCHLIST")).otherwise(F.lit("PASSED")))


def local_chain(companies: DataFrame, manual: DataFrame, cache: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Fallback merge, local score, explanation, combined score."""
    merged = scoring.provider_fallback(companies, manual, cache).withColumn("company_name", F.coalesce(F.nullif(X.text("name"), F.lit("")), F.col("ticker")))
    return scoring.combined_score(scoring.explain(scoring.local_score(merged)), fundamentals)


def combined_until_stable(rows: DataFrame, fundamentals: DataFrame, previous: str = "local_score_v0", most: int = 50, price: str | None = None) -> DataFrame:
    """The combined score with itself as the previous score, again and again until no score moves; ``rounds`` says how often.

    A score's next value moves by under a quarter of its last move, so a few rounds do; only rows that still move are scored
    again, and each round is settled, so the plan does not grow.  Ties are looked for once all are stable.
    """
    moving, done = rows.withColumn("__begin", F.col(previous)), []
    for i in range(1, most + 1):
        scored = settled(scoring.combined_components(moving, fundamentals, previous, price=price).withColumn("rounds", F.lit(i)))
        done.append(scored.where("combined_score_delta = 0"))
        again = scored.where("combined_score_delta <> 0")
        if again.isEmpty():
            break
        moving = again.withColumn(previous, F.col("combined_score_v1")).select(*rows.columns, "__begin")
    else:
        done.append(again)
    out = scoring.with_ties(reduce(DataFrame.unionByName, done))
    return out.withColumn(previous, F.col("__begin")).drop("__begin")


def add_provider(baseline: DataFrame, candidates: DataFrame, keys: list[str], order: str = "input_ordinal") -> tuple[DataFrame, DataFrame]:
    """The baseline with what is new of a provider, and the audit of every candidate."""
    audit = universe.merge_audit(baseline, candidates, keys, order)
    new = audit.where("merge_action = 'ADDED'").drop("merge_action", order)
    return universe.union_widened(baseline, new), audit


def provider_validation(candidates: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage metrics with a readiness status."""
    out = reports.coverage_metrics(candidates, baseline, keys)
    return out.withColumn("status", reports.gate([("EMPTY", F.col("candidate_rows") == 0), ("NO_GAIN", F.col("net_new_keys") == 0)], "READY"))


def coverage_report(df: DataFrame, key: str, columns: list[str], core: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Coverage by column, what each row lacks, the summary of the core columns and those that miss most."""
    coverage = reports.column_coverage(df, columns)
    return coverage, reports.missing_by_row(df, key, columns), reports.coverage_summary(coverage, core), reports.least_covered(coverage, core)


def stage1_diagnostic(classified: DataFrame) -> dict[str, DataFrame]:
    """X12."""
    rows = reports.bucketed(classified)
    log = reason_log(classified, "stage1", ["ticker"])
    return {
        "buckets": reports.group_counts(rows, "market_cap_bucket", "stage1_status"), "profile": reports.numeric_profile(rows, ["market_cap", "price", "dollar_volume_90d"]),
        "watchlist": views.with_reasons(classified.where("stage1_status = 'WATCHLIST'").select("ticker"), log, "ticker"),
    }


def memos(rows: DataFrame, text_columns: list[str]) -> DataFrame:
    """Memo scores, flags, verdicts."""
    flagged = memo.red_flags(memo.memo_scores(rows), text_columns)
    out = flagged.join(memo.red_flag_summary(flagged), "ticker")
    verdict = memo.normalized_verdict(F.col("final_verdict"), F.col("memo_status"), F.col("data_gaps"))
    return out.withColumn("normalized_verdict", verdict).withColumn("enforced_verdict", memo.enforced_verdict(F.col("normalized_verdict"), F.col("has_high_or_critical")))


def research_queue(ranking: DataFrame, cards: DataFrame, key: str = "ticker") -> DataFrame:
    """X14."""
    rows = ranking.join(cards.select(key, "research_status", "manual_status"), key, "left")
    rows = rows.withColumn("queue_status", views.queue_status(F.col("research_status"), F.col("manual_status")))
    return rows.withColumn("priority", views.queue_priority(F.col("score"), F.col("queue_status")))


def scaled(seed: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """``n`` rows by repeating a seed (its rows are counted first) with suffixed keys; no task gets more than its share."""
    k = seed.count()
    rows = seed.sparkSession.range(n).select((F.col("id") % k + 1).alias("__i"), F.floor(F.col("id") / k).alias("__copy"))
    return rows.join(small(with_ordinal(seed.orderBy(key), "__i")), "__i").withColumn(key, F.concat_ws("_", key, F.col("__copy").cast("string"))).drop("__copy", "__i")
