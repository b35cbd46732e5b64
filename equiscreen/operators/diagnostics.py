"""Diagnostic classes of listings, row screens, analysis documents and header families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of
from .universe import dedupe_first, looks_like_ticker

# Words of what is no ordinary share, and of what may be one.
HKEX_OTHER = ["exchange traded fund", "etf", "leveraged", "inverse product", "warrant", "cbbc", "debt", "bond", "derivative", "structured", "inline warrant", "real estate investment trust", "reit", "depositary receipt", "stapled security"]
HKEX_EQUITY = ["equity", "ordinary", "shares", "stock"]
JPX_OTHER = ["etf", "etn", "reit", "infrastructure fund", "preferred", "foreign stock", "foreign share", "beneficiary", "investment trust", "fund", "warrant", "bond", "debt", "certificate"]
JPX_EQUITY = ["prime", "standard", "growth", "tokyo stock exchange", "tse", "domestic stock", "common stock", "stock"]


def diagnostic_class(cols: list[Column], other: list[str], equity: list[str]) -> Column:
    """By words anywhere in the joined columns; what is no share comes first."""
    blob = F.concat_ws(" ", *[X.text(c) for c in cols])
    return first_of([("NON_ORDINARY_OR_REVIEW_REQUIRED", X.contains_any(blob, other)), ("EQUITY_CANDIDATE_DIAGNOSTIC_ONLY", X.contains_any(blob, equity))], "UNKNOWN_REVIEW_REQUIRED")


def symbol_screen(df: DataFrame, symbol: str, name: str, exchange: str | None, route: Column, order: str = "input_ordinal", default: str = "CBOE") -> DataFrame:
    """Rows that look like tickers, the first of each exchange and ticker, with scope and confidence by their route."""
    rows = df.withColumns({"ticker": X.ticker(symbol), "company_name": X.text(name), "exchange": F.coalesce(F.nullif(X.text(exchange) if exchange else F.lit(""), F.lit("")), F.lit(default)), "__route": route})
    rows = rows.where(looks_like_ticker(F.col("ticker"))).withColumn("__key", F.upper("exchange"))
    rows = dedupe_first(rows, ["__key", "ticker"], order)
    listed = F.col("__route").contains("listed")
    return rows.withColumns({
        "instrument_scope": F.when(listed, F.lit("CANDIDATE_LISTED_SECURITY_PENDING_VALIDATION")).otherwise(F.lit("REFERENCE_TRADED_SYMBOL_PENDING_VALIDATION")),
        "classification_confidence": F.when(listed, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
    }).drop("__route", "__key")


def analysis_errors(doc: str | Column, required: list[str], scores: list[str], scenarios: list[str], categories: list[str], levels: list[str]) -> Column:
    """Errors of an analysis document in JSON: missing fields, scores outside 0 to 10, probabilities that do not add up
    to 100, confidence above its evidence, words outside their vocabulary."""
    c = X.col(doc)
    at = lambda path: F.get_json_object(c, f"$.{path}")
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    cases = [(F.get_json_object(c, "$").isNull(), "analysis_json_must_be_object")]
    cases += [(~F.array_contains(keys, f), f"missing_top_level_field:{f}") for f in required]
    for s in scores:
        x = X.number(at(f"scores.{s}"))
        cases.append((at(f"scores.{s}").isNotNull() & (x.isNull() | (x < 0) | (x > 10)), f"invalid_score_0_10_or_null:{s}"))
    sure = X.number(at("scores.confidence_score"))
    cases += [((X.number(at(f"scores.{s}")) <= 4) & (sure >= 7), f"confidence_score_too_high:{s}") for s in ("evidence_quality_score", "data_freshness_score")]
    chances = [X.number(at(f"scenarios.{k}.probability")) for k in scenarios]
    cases += [((p < 0) | (p > 100), f"invalid_scenario_probability:{k}") for k, p in zip(scenarios, chances, strict=True)]
    if chances:
        cases.append((X.rounded(reduce(lambda a, b: a + b, chances)) != 100, "scenario_probabilities_must_sum_100"))
    cases += [(~F.coalesce(at("final_result.final_category"), F.lit("")).isin(*categories), "invalid_final_category"), (~F.coalesce(at("final_result.confidence_level"), F.lit("")).isin(*levels), "invalid_confidence_level")]
    return F.filter(F.array(*[F.when(w, F.lit(e)) for w, e in cases]), lambda e: e.isNotNull())


#: Header families: whole names, and parts of names.
FAMILIES = {
    "symbol": (("symbol", "ticker", "bats name", "bats_name", "instrument", "security", "isin"), ("symbol", "ticker")),
    "name": (("name", "company", "company name", "issuer", "issuer name", "security name"), ("issuer", "company", "security name")),
    "mic_or_venue": (("mic", "venue", "market", "exchange", "book", "listing market"), ("mic", "venue", "market", "exchange")),
    "currency": (("currency", "trading currency", "price currency", "ccy"), ("currency",)),
    "country": (("country", "domicile", "country of incorporation"), ("country", "domicile")),
    "asset_class": (("asset_class", "asset class", "asset type", "security type", "instrument type"), ("asset", "security type", "instrument type")),
}


def header_families(columns: list[str]) -> dict[str, list[str]]:
    """A36, at plan time: which columns look like which family."""
    names = [c.strip().lower() for c in columns]
    return {f: [n for n in names if n in whole or any(p in n for p in parts)] for f, (whole, parts) in FAMILIES.items()}


def file_set_profile(df: DataFrame) -> DataFrame:
    """Rows, size and header families of each file of a scan, and the route that follows."""
    found = {f"has_{f}_like_header": bool(v) for f, v in header_families(df.columns).items()}
    usable = found["has_symbol_like_header"] and found["has_name_like_header"]
    out = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    return out.withColumns({k: F.lit(v) for k, v in found.items()} | {"route": F.when(F.lit(usable) & (F.col("rows") > 0), F.lit("PARSE")).otherwise(F.lit("REVIEW"))})


def normalised(df: DataFrame, mappings: list[dict[str, str]], kinds: dict[str, str]) -> DataFrame:
    """Several versions of a row layout to one: of the sources that ``df`` has for a target, the last mapping's wins."""
    chosen = {t: s for m in mappings for t, s in m.items() if s in df.columns}
    return df.select(*[(F.col(f"`{chosen[t]}`").cast(k) if t in chosen else F.lit(None).cast(k)).alias(t) for t, k in kinds.items()])
