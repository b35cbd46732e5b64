"""Listing universe: classifiers of instruments, acceptance cascades, anti-joins, dedupe and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of
from .greedy import greedy_two_keys

# What a security's name says, in the order in which it is asked: (type, in scope, confidence, words).
BY_NAME = [
    ("WARRANT", False, "HIGH", ["warrant"]),
    ("RIGHT", False, "HIGH", [" right"]),
    ("UNIT", False, "HIGH", [" unit"]),
    ("PREFERRED", False, "HIGH", ["preferred", "preference share", "depositary shares each representing"]),
    ("ETF", False, "HIGH", ["etf", "exchange traded fund", "exchange-traded fund"]),
    ("ETN", False, "HIGH", ["etn", "exchange traded note", "exchange-traded note"]),
    ("CLOSED_END_FUND", False, "HIGH", ["closed end", "closed-end"]),
    ("BOND_OR_NOTE", False, "HIGH", ["bond", "note due", "notes due", "senior notes", "subordinated notes"]),
    ("SPAC_OR_BLANK_CHECK", False, "MEDIUM", ["acquisition corp", "blank check", "special purpose acquisition", "spac"]),
    ("REIT", True, "MEDIUM", ["reit", "real estate investment trust"]),
    ("ADR", True, "MEDIUM", ["american depositary", "ads", "adr"]),
]
COMMON_WORDS = ["common stock", "ordinary shares", "common shares", "class a common", "class b common"]


def instrument_class(df: DataFrame, symbol: str = "symbol", name: str = "name", strict: bool = False, spacs: bool = False, reits: bool = True, adrs: bool = True) -> DataFrame:
    """instrument_type, instrument_scope, classification_confidence, and for what is out of scope reason_code.

    Words match inside other words, as the rules say; ``strict`` asks for word boundaries.  Name comes before symbol.
    """
    s, n = X.ticker(symbol), X.text(name)
    five = F.length(s) >= 5
    suffix = first_of([("WARRANT", five & (s.endswith("W") | s.endswith("WS"))), ("RIGHT", five & s.endswith("R")), ("UNIT", five & s.endswith("U")), ("PREFERRED", s.contains("-P") | s.contains(".P") | s.contains(" PR"))], "")
    cases = [(t, X.contains_any(n, words, strict)) for t, _, _, words in BY_NAME]
    found = first_of(cases, "")
    kind = F.when(found != "", found).when(suffix != "", suffix).otherwise(F.lit("COMMON_STOCK"))
    sure = first_of([(c, found == t) for t, _, c, _ in BY_NAME], "")
    confidence = F.when(sure != "", sure).when(suffix != "", F.lit("MEDIUM")).when(X.contains_any(n, COMMON_WORDS), F.lit("HIGH")).otherwise(F.lit("LOW"))
    allowed = ["COMMON_STOCK", *(["SPAC_OR_BLANK_CHECK"] if spacs else []), *(["REIT"] if reits else []), *(["ADR"] if adrs else [])]
    df = df.withColumns({"instrument_type": kind, "classification_confidence": confidence})
    scope = F.when(F.col("instrument_type").isin(*allowed), F.lit("IN_SCOPE")).otherwise(F.lit("OUT_OF_SCOPE"))
    df = df.withColumn("instrument_scope", scope)
    out = F.col("instrument_scope") != "IN_SCOPE"
    return df.withColumn("reason_code", F.when(out, F.concat(F.lit("OUT_OF_SCOPE_"), F.col("instrument_type"))))


# Fixed values of the flag classifier: (type, scope, confidence, word).
BY_FLAG = [
    ("WARRANT", "OUT_OF_SCOPE", "HIGH", "WARRANT"), ("RIGHT", "OUT_OF_SCOPE", "HIGH", "RIGHT"), ("UNIT", "OUT_OF_SCOPE", "HIGH", " UNIT"), ("UNIT", "OUT_OF_SCOPE", "HIGH", "UNITS"),
    ("PREFERRED", "OUT_OF_SCOPE", "HIGH", "PREFERRED"), ("PREFERRED", "OUT_OF_SCOPE", "HIGH", " PFD"), ("ADR_OR_PREFERRED_REVIEW", "OUT_OF_SCOPE", "MEDIUM", "DEPOSITARY SHARES"),
    ("DEBT", "OUT_OF_SCOPE", "HIGH", "NOTE DUE"), ("DEBT", "OUT_OF_SCOPE", "HIGH", "NOTES DUE"), ("DEBT", "OUT_OF_SCOPE", "HIGH", "BOND"),
    ("ADR", "IN_SCOPE_ADR", "MEDIUM", "AMERICAN DEPOSITARY"), ("ADR", "IN_SCOPE_ADR", "MEDIUM", "AMERICAN DEPOSITORY"), ("ADR", "IN_SCOPE_ADR", "MEDIUM", "ADS"), ("ADR", "IN_SCOPE_ADR", "MEDIUM", "ADR"),
    ("COMMON_STOCK", "IN_SCOPE", "HIGH", "COMMON STOCK"), ("COMMON_STOCK", "IN_SCOPE", "HIGH", "ORDINARY SHARES"), ("COMMON_STOCK", "IN_SCOPE", "HIGH", "CLASS A"), ("COMMON_STOCK", "IN_SCOPE", "HIGH", "CLASS B"), ("COMMON_STOCK", "IN_SCOPE", "HIGH", "CLASS C"),
]


def instrument_flags(name: Column, etf: Column, test: Column) -> Column:
    """struct(instrument_type, instrument_scope, classification_confidence)."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    yes = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))) == "Y"
    made = lambda t, s, c: F.struct(F.lit(t).alias("instrument_type"), F.lit(s).alias("instrument_scope"), F.lit(c).alias("classification_confidence"))
    out = F.when(yes(test), made("TEST_ISSUE", "OUT_OF_SCOPE", "HIGH")).when(yes(etf), made("ETF", "OUT_OF_SCOPE", "HIGH"))
    for t, s, c, word in BY_FLAG:
        out = out.when(upper.contains(word), made(t, s, c))
    return out.otherwise(made("COMMON_STOCK", "IN_SCOPE", "MEDIUM"))


def exchange_family(exchange: Column) -> Column:
    """C10."""
    e = F.trim(F.coalesce(exchange, F.lit("")))
    return first_of([("PRIMARY_EXCHANGE_CANDIDATE", e.isin("NASDAQ", "NYSE", "CBOE")), ("ENRICHMENT_OR_EXCLUSION_CANDIDATE", e.isin("OTC", "None", ""))], "UNKNOWN_EXCHANGE_REVIEW_REQUIRED")


# Fixed values of the Xetra taxonomy; group prefixes are asked in this order.
XETRA_OUT = ("ETF", "ETN", "ETC", "ETP", "FUND", "MF", "BOND", "WAR", "WARRANT", "CERT", "CERTIFICATE", "RIGHT", "RIGHTS", "FUT", "OPT", "OPTION")
XETRA_GROUPS = ("ETF", "ETN", "ETC", "FON", "FUND", "BON", "CRT", "WAR")


def xetra_taxonomy(kind: Column, group: Column) -> Column:
    """C11: struct(taxonomy, reason)."""
    t, g = F.upper(X.text(kind)), F.upper(X.text(group))
    made = lambda a, b: F.struct(F.lit(a).alias("taxonomy"), b.alias("reason"))
    out = F.when(t == "CS", made("equity_like_candidate", F.lit("instrument_type_cs")))
    out = out.when(t.isin(*XETRA_OUT), made("excluded_non_common_equity", F.concat(F.lit("instrument_type_"), F.lower(t))))
    for p in XETRA_GROUPS:
        out = out.when(g.startswith(p), made("excluded_non_common_equity", F.lit(f"group_prefix_{p.lower()}")))
    return out.otherwise(made("manual_review_unknown_type", F.lit("unmapped_taxonomy")))


#: C12, C33, fixed values: regular expressions over the joined type columns; the first that matches says what it is not.
NON_EQUITY = [
    ("etf", r"\betf\b|exchange traded fund|active etf"), ("etn", r"\betn\b|exchange traded note"), ("etc", r"\betc\b|exchange traded commodit"), ("etp", r"\betp\b|exchange traded product"),
    ("fund", r"\bfund\b|\bfonds\b|investment fund|mutual fund"), ("bond", r"\bbond\b|\banleihe\b|fixed income|debt"), ("certificate", r"certificate|zertifikat|certificat"), ("warrant", r"warrant|optionsschein"),
    ("derivative", r"future|option|derivative|swap"), ("commodity", r"commodity|rohstoff"), ("crypto", r"crypto|bitcoin|ethereum"), ("index", r"\bindex\b|indice"),
    ("reit", r"\breit\b|real estate investment trust"), ("rights_or_units", r"subscription right|rights issue|\bright\b|\bunit\b"), ("depositary_receipt", r"depositary receipt|\badr\b|\bgdr\b"),
]
#: Words of which one must be there.
EQUITY = r"\bequity\b|\bequities\b|\bshare\b|\bshares\b|\bstock\b|\bstocks\b|\bcommon\b|\bordinary\b|\bregistered shares?\b|\bbearer shares?\b|\baktie\b|\baktien\b|\bstammaktie\b|\bvorzugsaktie\b|\binhaber-?aktien\b|\bnamens-?aktien\b"


def regex_taxonomy(*cols: Column | str) -> Column:
    """struct(class, reason) by group, type and name."""
    joined = F.lower(F.concat_ws(" | ", *map(X.text, cols)))
    reason = X.first_match(joined, NON_EQUITY, "")
    made = lambda c, r: F.struct(F.lit(c).alias("class"), r.alias("reason"))
    return F.when(reason != "", made("excluded_non_common_equity", reason)).when(joined.rlike(EQUITY), made("equity_like_candidate", F.lit("equity_pattern"))).otherwise(made("manual_review_unknown_type", F.lit("insufficient_type_signal")))


#: C13, C14, fixed values: subcategories and segments that are accepted, and words that are not.
HKEX_ALLOWED = ("Equity Securities (Main Board)", "Equity Securities (GEM)", "Investment Companies", "Trading Only Securities")


def hkex_decision(code: Column, name: Column, category: Column, subcategory: Column) -> Column:
    """C13."""
    c = X.text(category)
    return first_of([("MISSING_STOCK_CODE", X.text(code) == ""), ("MISSING_COMPANY_NAME", X.text(name) == ""), ("MISSING_CATEGORY_REVIEW_REQUIRED", c == ""), ("NON_EQUITY_CATEGORY_EXCLUDED", c != "Equity"),
                     ("EQUITY_SUBCATEGORY_NOT_IN_ALLOWLIST", ~X.text(subcategory).isin(*HKEX_ALLOWED))], "ACCEPTED_HKEX_EQUITY_ALLOWLIST")


JPX_SEGMENTS = ("primemarket(domestic)", "standardmarket(domestic)", "growthmarket(domestic)")
JPX_OTHER = ["etf", "etn", "reit", "venture fund", "country fund", "infrastructure fund", "preferred", "equity contribution", "investment trust", "fund", "warrant", "bond", "debt", "certificate"]


def own_if_blank(key: Column, order: str) -> Column:
    """A key for windows: blank keys, however many rows have one, are each row's own."""
    return F.when(key != "", key).otherwise(F.concat(F.lit(" "), F.col(order).cast("string")))


def jpx_decisions(df: DataFrame, baseline: DataFrame, order: str = "input_ordinal", exchange: str = "JPX") -> DataFrame:
    """``df`` (local_code, company_name, market_segment, industry) with its exclusion_reason, "" if accepted.

    A code is a duplicate if an earlier row that has a code and a name has it, accepted or not.
    """
    code, name, segment = F.upper(X.local_code("local_code")), X.text("company_name"), F.lower(F.regexp_replace(X.text("market_segment"), r"\s+", ""))
    named = (code != "") & (name != "")
    seen = F.count(F.when(named, 1)).over(Window.partitionBy(own_if_blank(code, order)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)) > 0
    base = baseline.where(F.upper(X.text("exchange")) == exchange).select(X.ticker("ticker").alias("__code")).distinct().withColumn("__in", F.lit(True))
    rows = df.withColumns({"__seen": seen, "__code": code}).join(base, "__code", "left")
    blob = F.lower(F.concat_ws(" ", X.text("market_segment"), X.text("industry"), name))
    outside = ~segment.isin(*JPX_SEGMENTS)
    reason = first_of([
        ("BLANK_LOCAL_CODE", code == ""), ("BLANK_COMPANY_NAME", name == ""), ("DUPLICATE_LOCAL_CODE_IN_JPX_SOURCE", F.col("__seen")), ("OVERLAP_BASELINE_EXCHANGE_TICKER", F.coalesce(F.col("__in"), F.lit(False))),
        ("FOREIGN_MARKET_SEGMENT_EXCLUDED", outside & segment.contains("foreign")), ("ETF_ETN_MARKET_SEGMENT_EXCLUDED", outside & (segment.contains("etfs") | segment.contains("etns"))),
        ("REIT_OR_FUND_MARKET_SEGMENT_EXCLUDED", outside & (segment.contains("reit") | segment.contains("fund"))), ("PRO_MARKET_REVIEW_EXCLUDED", outside & segment.contains("promarket")),
        ("MARKET_SEGMENT_NOT_IN_ALLOWLIST", outside), ("NON_COMMON_EQUITY_REVIEW_EXCLUDED", X.contains_any(blob, JPX_OTHER)),
    ], "")
    return rows.withColumn("exclusion_reason", reason).drop("__seen", "__code", "__in")


def key_table(df: DataFrame, *keys: Column, marker: str) -> DataFrame:
    """Distinct non-blank keys with a marker column, for labelled anti-joins."""
    names = [f"k{i}" for i in range(len(keys))]
    out = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    for n in names:
        out = out.where(F.col(n) != "")
    return out.distinct().withColumn(marker, F.lit(True))


def net_new(candidates: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not in the baseline."""
    return candidates.join(baseline.select(*keys).distinct(), keys, "left_anti")


def overlap(candidates: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """J12, U4."""
    return candidates.join(baseline.select(*keys).distinct(), keys, "left_semi")


def baseline_status(df: DataFrame, baseline: DataFrame, isin: str = "isin", ticker: str = "ticker", spellings: tuple[str, ...] = ("XETR", "XETRA")) -> DataFrame:
    """By ISIN, then by exchange and ticker under any of the exchange's spellings, with how it was found."""
    i, t = X.ticker(isin, spaces=True), X.ticker(ticker, spaces=True)
    isins = key_table(baseline, X.ticker("isin", spaces=True), marker="__by_isin").withColumnRenamed("k0", "__isin")
    keys = baseline.where(X.ticker("exchange", spaces=True).isin(*[s.replace(" ", "") for s in spellings]))
    keys = key_table(keys, X.ticker("ticker", spaces=True), marker="__by_key").withColumnRenamed("k0", "__ticker")
    rows = df.withColumns({"__isin": i, "__ticker": t}).join(isins, "__isin", "left").join(keys, "__ticker", "left")
    status = first_of([("already_in_baseline_by_isin", F.coalesce(F.col("__by_isin"), F.lit(False))), ("already_in_baseline_by_exchange_ticker", F.coalesce(F.col("__by_key"), F.lit(False))), ("diagnostic_not_found_in_baseline", (i != "") | (t != ""))], "missing_identifier")
    return rows.withColumn("baseline_status", status).drop("__isin", "__ticker", "__by_isin", "__by_key")


def dedupe_first(df: DataFrame, keys: list[str], order: str = "input_ordinal", last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedupe_labelled(df: DataFrame, keys: list[str], order: str = "input_ordinal") -> DataFrame:
    """All rows, with duplicate_number (1 is kept) and decision KEPT or DUPLICATE."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("duplicate_number", n).withColumn("decision", F.when(F.col("duplicate_number") == 1, F.lit("KEPT")).otherwise(F.lit("DUPLICATE")))


def duplicates_of_accepted(df: DataFrame, key: str, eligible: str, order: str = "input_ordinal") -> DataFrame:
    """is_duplicate where an earlier row of the same key was eligible; only accepted rows count as seen, blank keys are nobody's."""
    w = Window.partitionBy(own_if_blank(F.coalesce(F.col(key).cast("string"), F.lit("")), order)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_duplicate", F.coalesce(F.max(F.col(eligible).cast("int")).over(w), F.lit(0)) == 1)


def cboe_europe_decisions(df: DataFrame, baseline: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """exclusion_reason, "" if accepted.  ``df``: bats_name, company_name, isin, live."""
    name, isin, live = X.text("bats_name"), X.text("isin"), F.lower(X.text("live")).isin("t", "true", "1", "yes", "y")
    rows = df.withColumns({"__t": F.upper(name), "__i": F.upper(isin)})
    rows = rows.join(key_table(baseline, X.ticker("ticker"), marker="__bt").withColumnRenamed("k0", "__t"), "__t", "left").join(key_table(baseline, X.ticker("isin"), marker="__bi").withColumnRenamed("k0", "__i"), "__i", "left")
    in_t, in_i = F.coalesce(F.col("__bt"), F.lit(False)), F.coalesce(F.col("__bi"), F.lit(False))
    fine = (name != "") & (X.text("company_name") != "") & (isin != "") & live
    rows = duplicates_of_accepted(rows.withColumns({"__fine": fine & ~in_t & ~in_i, "__key": name}), "__key", "__fine", order)
    reason = first_of([("MISSING_BATS_NAME", name == ""), ("MISSING_COMPANY_NAME", X.is_blank("company_name")), ("MISSING_ISIN", isin == ""), ("NOT_LIVE", ~live), ("DUPLICATE_CBOE_BATS_NAME", F.col("is_duplicate")),
                       ("BASELINE_TICKER_ALREADY_PRESENT", in_t), ("BASELINE_ISIN_ALREADY_PRESENT", in_i)], "")
    return rows.withColumn("exclusion_reason", reason).drop("__t", "__i", "__bt", "__bi", "__fine", "__key", "is_duplicate")


def xetra_decisions(df: DataFrame, baseline: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """C17: ``df`` (instrument_type, isin, ticker) with exclusion_reason, empty for accepted rows."""
    kind, isin, ticker = F.upper(X.text("instrument_type")), X.ticker("isin", spaces=True), X.ticker("ticker", spaces=True)
    rows = df.withColumns({"__isin": isin, "__key": F.when(ticker != "", F.concat(F.lit("XETR|"), ticker)).otherwise(F.lit(""))})
    rows = rows.join(baseline.select(F.upper(X.text("isin")).alias("__isin")).where("__isin <> ''").distinct().withColumn("__bi", F.lit(True)), "__isin", "left")
    rows = rows.join(baseline.select(F.concat_ws("|", F.upper(X.text("exchange")), F.upper(X.text("ticker"))).alias("__key")).distinct().withColumn("__bk", F.lit(True)), "__key", "left")
    early = F.when(kind != "CS", F.concat(F.lit("excluded_non_common_equity_instrument_type_"), F.when(kind == "", F.lit("blank")).otherwise(kind))).when(isin == "", F.lit("missing_isin")).when(ticker == "", F.lit("missing_ticker"))
    early = early.when(F.col("__bi"), F.lit("already_in_baseline_by_isin")).when(F.col("__bk"), F.lit("already_in_baseline_by_exchange_ticker")).otherwise(F.lit(""))
    rows = rows.withColumn("__early", early)
    taken = greedy_two_keys(rows.where("__early = ''").select("__isin", "__key", order), "__isin", "__key", order).where("accepted")
    rows = rows.join(taken.select(order, F.lit(True).alias("__ok")), order, "left").join(taken.select("__isin", F.col(order).alias("__by")), "__isin", "left")
    late = F.when(F.col("__ok"), F.lit("")).when(F.col("__by") < F.col(order), F.lit("duplicate_within_xetra_by_isin")).otherwise(F.lit("duplicate_within_xetra_by_exchange_ticker"))
    return rows.withColumn("exclusion_reason", F.when(F.col("__early") != "", F.col("__early")).otherwise(late)).drop("__isin", "__key", "__bi", "__bk", "__early", "__ok", "__by")


def union_widened(baseline: DataFrame, additions: DataFrame) -> DataFrame:
    """All rows under the columns of both, blanks for what a side has not; the baseline's columns first."""
    both = baseline.unionByName(additions, allowMissingColumns=True)
    return both.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in both.columns])


def merge_audit(baseline: DataFrame, candidates: DataFrame, keys: list[str], order: str = "input_ordinal") -> DataFrame:
    """One labelled row for each candidate: ADDED, DUPLICATE_IN_SOURCE or ALREADY_IN_BASELINE."""
    base = baseline.select(*keys).distinct().withColumn("__in", F.lit(True))
    rows = dedupe_labelled(candidates, keys, order).join(base, keys, "left")
    action = F.when(F.col("__in"), F.lit("ALREADY_IN_BASELINE")).when(F.col("duplicate_number") > 1, F.lit("DUPLICATE_IN_SOURCE")).otherwise(F.lit("ADDED"))
    return rows.withColumn("merge_action", action).drop("__in", "decision", "duplicate_number")


#: P10: synonyms of the one asset type that the clean universe keeps.
ASSET_TYPES = {"equity": "common_stock", "stock": "common_stock", "common stock": "common_stock", "commonstock": "common_stock"}


def clean_universe(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """USA, USD, common stock, active; the first row of a ticker, whether it is kept or not."""
    rows = df.withColumns({"ticker": X.ticker("ticker"), "country": F.upper(X.text("country")), "currency": F.upper(X.text("currency")), "asset_type": X.mapped(F.lower(X.text("asset_type")), ASSET_TYPES), "is_active": X.two_state("is_active")})
    rows = dedupe_first(rows.where("ticker <> ''"), ["ticker"], order)
    return rows.where("country = 'USA' and currency = 'USD' and asset_type = 'common_stock' and is_active")


def listing_filter(df: DataFrame, symbol: str = "symbol", etf: str = "etf", test: str = "test_issue", etfs: bool = False, tests: bool = False, order: str = "input_ordinal") -> DataFrame:
    """Without ETFs, test issues, odd symbols and the directory's footer; of what is left, the first row of each symbol."""
    flag = lambda c: F.upper(X.text(c)) == "Y"
    out = df.where((X.text(symbol) != "") & ~X.text(symbol).rlike(r"[$^/]") & ~F.lower(X.text(symbol)).contains("file creation time"))
    out = out if etfs else out.where(~flag(etf))
    out = out if tests else out.where(~flag(test))
    return dedupe_first(out.withColumn("__symbol", X.text(symbol)), ["__symbol"], order).drop("__symbol")


def looks_like_ticker(c: Column) -> Column:
    """P16."""
    return c.rlike(r"^[A-Z0-9][A-Z0-9.\-]{0,15}$")


#: One-letter exchange codes of the pipe directory.
EXCHANGE_CODES = {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}
EXCHANGE_CODES_SHORT = {"A": "AMEX", "N": "NYSE", "P": "ARCA", "Z": "BATS", "V": "IEXG"}
