"""Ordered rule cascades as column expressions: what every row classifier here is made of.

A ``Rule`` has a condition and an effect.  All rules that hold give a reason, in order; the row's status is that
of the gravest effect.  Nothing here runs Python on rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reason_texts import REASON_TEXTS

REJECT, WATCH, WARN = "REJECTED", "WATCHLIST", "WARNING"
REASON = "struct<code:string,text:string,metric:string,value:string,threshold:string,severity:string,recoverable:boolean>"


@dataclass(frozen=True)
class Rule:
    code: str
    when: Column
    effect: str
    metric: str = ""
    value: Column | None = None
    threshold: Any = ""
    severity: str = "medium"
    recoverable: bool = True
    text: str = ""

    def reason(self) -> Column:
        threshold = "|".join(sorted(self.threshold)) if isinstance(self.threshold, (set, frozenset, list, tuple)) else str(self.threshold)
        value = F.lit(None).cast("string") if self.value is None else self.value.cast("string")
        made = F.struct(
            F.lit(self.code).alias("code"), F.lit(self.text or REASON_TEXTS.get(self.code, "")).alias("text"), F.lit(self.metric).alias("metric"), value.alias("value"),
            F.lit(threshold).alias("threshold"), F.lit(self.severity).alias("severity"), F.lit(self.recoverable).alias("recoverable"),
        )
        return F.when(self.when, made)


def reasons(rules: list[Rule]) -> Column:
    return F.filter(F.array(*[r.reason() for r in rules]), lambda x: x.isNotNull())


def codes(rules: list[Rule], separator: str = "|") -> Column:
    return F.concat_ws(separator, *[F.when(r.when, F.lit(r.code)) for r in rules])


def any_of(rules: list[Rule], effect: str) -> Column:
    out = F.lit(False)
    for r in rules:
        if r.effect == effect:
            out = out | F.coalesce(r.when, F.lit(False))
    return out


def status(rules: list[Rule]) -> Column:
    return F.when(any_of(rules, REJECT), F.lit(REJECT)).when(any_of(rules, WATCH), F.lit(WATCH)).otherwise(F.lit("PASSED"))


def first_of(cases: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first case that holds."""
    out = F.when(F.lit(False), F.lit(""))
    for label, when in cases:
        out = out.when(when, F.lit(label))
    return out.otherwise(F.lit(default))


def classified(df: DataFrame, rules: list[Rule], stage: str) -> DataFrame:
    """``df`` with <stage>_status, <stage>_primary_reason, <stage>_all_reasons and <stage>_reasons (structs).

    What holds is found once, as an array of booleans; status, reasons and log are read from it.
    """
    held = f"__{stage}_held"
    found = df.withColumn(held, F.array(*[F.coalesce(r.when, F.lit(False)) for r in rules]))
    known = [replace(r, when=F.get(F.col(held), F.lit(i))) for i, r in enumerate(rules)]
    out = found.withColumns({f"{stage}_reasons": reasons(known), f"{stage}_status": status(known)}).drop(held)
    return out.withColumns({
        f"{stage}_primary_reason": F.coalesce(F.get(F.col(f"{stage}_reasons"), F.lit(0))["code"], F.lit("")),
        f"{stage}_all_reasons": F.array_join(F.transform(f"{stage}_reasons", lambda r: r["code"]), "|"),
    })


def reason_log(df: DataFrame, stage: str, keep: list[str]) -> DataFrame:
    """A row for each reason of each row: the rejection log.

    Rows without reasons are dropped after the explosion: before it, the optimizer would ask for the list's size by a copy of all
    rules below every projection.
    """
    rows = df.select(*keep, F.lit(stage).alias("stage"), F.col(f"{stage}_status").alias("status"), F.explode_outer(f"{stage}_reasons").alias("reason")).where("reason is not null")
    return rows.select(
        *keep, "stage", "status", F.col("reason.code").alias("reason_code"), F.col("reason.text").alias("reason_text"), F.col("reason.metric").alias("metric_name"),
        F.col("reason.value").alias("metric_value"), F.col("reason.threshold").alias("threshold"), F.col("reason.severity").alias("severity"), F.col("reason.recoverable").alias("recoverable"),
    )
