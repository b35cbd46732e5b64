"""Read models: latest rows, joined views, comparisons, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of


def latest(df: DataFrame, keys: list[str], order: str, ties: bool = False, tie_break: str | None = None) -> DataFrame:
    """The newest row of each key; with ``ties`` all rows that share the newest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *([F.desc(tie_break)] if tie_break and not ties else []))
    n = F.rank() if ties else F.row_number()
    return df.withColumn("__n", n.over(w)).where("__n = 1").drop("__n")


def latest_run(runs: DataFrame, created: str = "created_at") -> DataFrame:
    """N6."""
    return runs.orderBy(F.desc(created)).limit(1)


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value and their difference; null with fewer than two rows."""
    many = F.count(F.lit(1)) > 1
    first, last = F.min_by(value, order), F.max_by(value, order)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(many, first).alias("first_value"), F.when(many, last).alias("last_value"), F.when(many, last - first).alias("delta"))


def enriched_signals(signals: DataFrame, snapshots: DataFrame, keys: list[str] = ["run_id", "ticker"]) -> DataFrame:  # noqa: B006
    """J1."""
    return signals.join(snapshots, keys, "left")


def final_view(signals: DataFrame, analysis: DataFrame | None, feedback: DataFrame | None, key: str = "id", analysis_columns: dict[str, str] | None = None, feedback_columns: dict[str, str] | None = None) -> DataFrame:
    """Signals with their latest analysis and feedback; where a side is absent, typed null columns."""
    out = signals
    for side, columns in ((analysis, analysis_columns or {}), (feedback, feedback_columns or {})):
        if side is None:
            out = out.withColumns({c: F.lit(None).cast(k) for c, k in columns.items()})
        else:
            out = out.join(side, key, "left")
    return out


def selected(df: DataFrame, sectors: list[str] | None = None, categories: list[str] | None = None, has: dict[str, bool] | None = None, least: float | None = None, score: str = "score_priority") -> DataFrame:
    """Optional predicates; ``has`` says of columns whether they must be there."""
    if sectors:
        df = df.where(F.col("sector").isin(sectors))
    if categories:
        df = df.where(F.col("category_final").isin(categories))
    for c, wanted in (has or {}).items():
        df = df.where(F.col(c).isNotNull() if wanted else F.col(c).isNull())
    return df if least is None else df.where(F.col(score) >= least)


def top(df: DataFrame, n: int, *order: Column | str, key: str = "ticker") -> DataFrame:
    """Sorted and cut; ``key`` breaks ties."""
    return df.orderBy(*order, key).limit(n)


def by_rank(df: DataFrame, rank: str = "ranking_position", score: str = "score", key: str = "ticker") -> DataFrame:
    """T6."""
    return df.orderBy(F.coalesce(rank, F.lit(999_999)), F.desc(F.coalesce(score, F.lit(-999_999.0))), key)


def ranked(df: DataFrame, partition: list[str], *order: Column | str) -> DataFrame:
    """Row numbers within ``partition``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer with a column merge_side: both, left_only, right_only."""
    x, y = a.withColumn("__a", F.lit(True)), b.withColumn("__b", F.lit(True))
    side = F.when(F.col("__a") & F.col("__b"), F.lit("both")).when(F.col("__a"), F.lit("left_only")).otherwise(F.lit("right_only"))
    return x.join(y, key, "full_outer").withColumn("merge_side", side).drop("__a", "__b")


def transitions(a: DataFrame, b: DataFrame, key: str, before: str, after: str, default: str = "UNKNOWN") -> DataFrame:
    """Rows of ``b`` with ``transition``, as in PASSED->WATCHLIST."""
    joined = b.join(a.select(key, before), key, "left")
    return joined.withColumn("transition", F.concat_ws("->", F.coalesce(F.col(before), F.lit(default)), F.coalesce(F.col(after), F.lit(default))))


def with_reasons(df: DataFrame, reasons: DataFrame, key: str, code: str = "reason_code") -> DataFrame:
    """Sorted distinct reasons of each key, joined."""
    listed = reasons.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(code)), ", ").alias("reasons"))
    return df.join(listed, key, "left")


def coverage_ratio(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """How many of ``whole``'s keys are in ``part``."""
    a, b = part.select(key).distinct(), whole.select(key).distinct()
    return b.join(a.withColumn("__in", F.lit(True)), key, "left").agg(F.count(F.lit(1)).alias("keys"), F.count("__in").alias("covered")).withColumn("coverage", F.col("covered") / F.col("keys"))


def last_known(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's last value that is not null."""
    return df.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def with_red_flags(memos: DataFrame, summary: DataFrame, key: str = "ticker") -> DataFrame:
    """No flags where there is no summary."""
    out = memos.join(summary, key, "left")
    return out.withColumns({"red_flag_count": F.coalesce("red_flag_count", F.lit(0).cast("long")), "max_severity": F.coalesce("max_severity", F.lit("LOW")), "has_high_or_critical": F.coalesce("has_high_or_critical", F.lit(False))})


#: Fixed values.
REVIEW_STATES = ("pending_review", "reviewed_watchlist", "reviewed_reject", "needs_more_data")


def review_queue(memos: DataFrame, reviews: DataFrame, key: str = "ticker") -> DataFrame:
    """Reviews made by hand are kept; what is no valid state is pending."""
    out = memos.join(reviews.select(key, "manual_status", "notes"), key, "left")
    return out.withColumns({"manual_status": F.when(F.col("manual_status").isin(*REVIEW_STATES), F.col("manual_status")).otherwise(F.lit("pending_review")), "notes": F.coalesce("notes", F.lit(""))})


def rank_deltas(a: DataFrame, b: DataFrame, key: str, rank: str = "rank", score: str = "score") -> DataFrame:
    """J17."""
    other = b.select(key, F.col(rank).alias("other_rank"), F.col(score).alias("other_score"))
    return a.join(other, key, "left").withColumns({"rank_delta": F.col("other_rank") - F.col(rank), "score_delta": F.col(score) - F.col("other_score")})


def queue_status(research: Column, manual: Column) -> Column:
    """C23."""
    r, m = F.upper(X.text(research)), F.upper(X.text(manual))
    return first_of([("REVIEWED", (r == "REVIEWED") | (m == "DONE")), ("IN_PROGRESS", (r == "IN_PROGRESS") | (m == "IN_PROGRESS")), ("REJECTED", (r == "REJECTED") | (m == "REJECTED"))], "PENDING_REVIEW")


def queue_priority(score: Column, state: Column) -> Column:
    """C23."""
    return first_of([("UNKNOWN", score.isNull()), ("HIGH", (score >= 85) & (state == "PENDING_REVIEW")), ("HIGH_IN_PROGRESS", (score >= 85) & (state == "IN_PROGRESS")), ("MEDIUM", score >= 70)], "NORMAL")


def decision_status(research: Column, manual: Column) -> Column:
    """C23, the comparison's rules: reviewed only if both columns say so."""
    r, m = F.upper(F.coalesce(research, F.lit(""))), F.upper(F.coalesce(manual, F.lit("")))
    both = r.isin("APPROVED", "REVIEWED") & m.isin("DONE", "REVIEWED", "APPROVED")
    return first_of([("REVIEWED", both), ("IN_PROGRESS", (r == "IN_PROGRESS") | (m == "IN_PROGRESS")), ("REJECTED", r.isin("REJECTED", "DISCARDED"))], "PENDING_REVIEW")


def priority_flag(score: Column, state: Column) -> Column:
    """C23, the comparison's rules."""
    waits = state == "PENDING_REVIEW"
    return first_of([("UNKNOWN_SCORE", score.isNull()), ("HIGH_SCORE_PENDING_REVIEW", (score >= 85) & waits), ("MEDIUM_SCORE_PENDING_REVIEW", (score >= 70) & waits), ("REVIEWED", state == "REVIEWED")], "WATCH")


def flat_records(df: DataFrame, record: str, sizes: dict[str, str], keep: list[str]) -> DataFrame:
    """P20: ``keep``, the fields of the struct ``record`` at every depth as columns, and the sizes (0 if null) of the lists that ``sizes`` names by alias."""
    counts = [F.when(F.col(path).isNotNull(), F.size(path)).otherwise(0).alias(alias) for alias, path in sizes.items()]
    return X.flattened(df.select(*keep, record, *counts))


def stage_decisions(stages: dict[str, DataFrame], key: str, *columns: str) -> DataFrame:
    """The rows of several stage outputs with the decision that each output stands for."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [d.select(key, *columns, F.lit(name).alias("decision")) for name, d in stages.items()])


def keys_not_in(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of ``a`` that ``b`` has not; null keys equal each other."""
    return a.select(*keys).subtract(b.select(*keys))


def display(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The named columns under their labels; those that are not there are left out."""
    return df.select(*[F.col(c).alias(t) for c, t in labels.items() if c in df.columns])


def resolve(df: DataFrame, aliases: dict[str, list[str]], fuzzy: bool = False) -> DataFrame:
    """One column for each target, from the first of its aliases that ``df`` has, whatever its case; null if none.

    ``fuzzy`` compares letters and digits only, whole names first, then parts of names.
    """
    import re

    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower()) if fuzzy else s.strip().lower()
    have = {plain(c): c for c in reversed(df.columns)}
    out = []
    for target, names in aliases.items():
        found = next((have[plain(n)] for n in [target, *names] if plain(n) in have), None)
        if found is None and fuzzy:
            found = next((c for n in names for k, c in have.items() if plain(n) in k), None)
        out.append(F.col(f"`{found}`").alias(target) if found else F.lit(None).cast("string").alias(target))
    return df.select(*out)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """P5: the first of the named columns that has a value."""
    return F.coalesce(*[X.blank_to_null(c) for c in names if c in df.columns], F.lit(None).cast("string"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """P1."""
    return [c for c in required if c not in df.columns]


def bridge(df: DataFrame, columns: dict[str, str], source: str) -> DataFrame:
    """``columns`` by target name, null where ``df`` has none, and where the rows came from."""
    return df.select(*[F.col(c).alias(t) if c in df.columns else F.lit(None).cast("string").alias(t) for t, c in columns.items()], F.lit(source).alias("source"))


def canonical(df: DataFrame, mapping: dict[str, str], constants: dict[str, str], columns: list[str]) -> DataFrame:
    """A provider's rows as canonical ones: trimmed text from ``mapping``'s columns, ``constants``, empty text elsewhere."""
    given = {t: X.text(c) for t, c in mapping.items() if c in df.columns} | {t: F.lit(v) for t, v in constants.items()}
    return df.select(*[given.get(c, F.lit("")).alias(c) for c in columns])


def passed(df: DataFrame, wanted: bool = True, flag: str = "passes_basic_filters") -> DataFrame:
    """Companies that passed the filters, or those that did not; a null flag is neither."""
    if flag not in df.columns:
        raise ValueError(f"column {flag} is missing: apply the basic filters first")
    return df.where(F.col(flag) == wanted)


def by_id(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    """P18."""
    return df.where(F.col(key) == value)


def by_ticker(df: DataFrame, ticker: str, run_id: str, score: str = "score_priority", key: str = "id") -> DataFrame:
    """The row of a ticker in a run, the best one if there are more; ``key`` breaks ties."""
    return df.where((F.col("run_id") == run_id) & (F.upper("ticker") == ticker.strip().upper())).orderBy(F.desc(score), key).limit(1)


def run_rows(df: DataFrame, runs: DataFrame, *order: Column | str, run_id: str | None = None) -> DataFrame:
    """The rows of a run in order; of the latest one unless told otherwise."""
    chosen = df.where(F.col("run_id") == run_id) if run_id is not None else df.join(latest_run(runs).select("run_id"), "run_id", "left_semi")
    return chosen.orderBy(*order)


def feedback_of_run(feedback: DataFrame, signals: DataFrame, run_id: str) -> DataFrame:
    """Feedback with its signal's run, newest first.  The run is asked of the signal, so feedback without one goes."""
    of_run = signals.where(F.col("run_id") == run_id).select(F.col("id").alias("signal_id"), "run_id")
    return feedback.join(of_run, "signal_id").orderBy(F.desc("created_at"), F.desc("id"))


def review_counts(reviews: DataFrame) -> DataFrame:
    """How many reviews are in each of the four states, 0 where there are none; other states are not counted."""
    is_in = [F.struct(F.lit(s).alias("manual_status"), F.count_if(F.col("manual_status") == s).alias("n")) for s in REVIEW_STATES]
    return reviews.agg(F.array(*is_in).alias("counts")).select(F.explode("counts").alias("c")).select("c.*")
