"""What the rules' reason codes say to a reader."""

#: The text of each reason code, stage by stage.
REASON_TEXTS = {
    "MISSING_TICKER": "Ticker missing.",
    "INACTIVE_SECURITY": "Security is not active.",
    "NOT_COMMON_STOCK": "Asset type is not allowed for Stage 1.",
    "OTC_NOT_ALLOWED": "OTC/Pink Sheet security excluded in Stage 1.",
    "MISSING_EXCHANGE": "Exchange missing.",
    "EXCHANGE_NOT_IN_ALLOWED_LIST": "Exchange is not in the default allowed list.",
    "MISSING_MARKET_CAP": "Market cap missing.",
    "MARKET_CAP_BELOW_MINIMUM": "Market cap below Stage 1 minimum.",
    "MARKET_CAP_WATCHLIST_RANGE": "Market cap is below pass threshold but above rejection threshold.",
    "MISSING_PRICE": "Price missing.",
    "PRICE_BELOW_MINIMUM": "Price below Stage 1 minimum.",
    "PRICE_STRONG_WATCHLIST_RANGE": "Price is below pass threshold but above rejection threshold.",
    "PRICE_WEAK_WATCHLIST_RANGE": "Price is below weak warning threshold but does not trigger watchlist by itself.",
    "MISSING_DOLLAR_VOLUME": "Dollar volume cannot be calculated.",
    "LOW_DOLLAR_VOLUME": "Dollar volume below Stage 1 minimum.",
    "DOLLAR_VOLUME_WATCHLIST_RANGE": "Dollar volume is below pass threshold but above rejection threshold.",
    "MISSING_DATA_COMPLETENESS": "Data completeness score missing.",
    "LOW_DATA_COMPLETENESS": "Data completeness below Stage 2 minimum.",
    "DATA_COMPLETENESS_WATCHLIST_RANGE": "Data completeness below pass threshold but above rejection threshold.",
    "MISSING_FINANCIAL_DATA_DATE": "Financial data date missing.",
    "MISSING_REVENUE_SPECIAL_CASE": "Revenue missing but company is marked as special case.",
    "MISSING_REVENUE": "Revenue missing and company is not special case.",
    "REVENUE_NOT_POSITIVE_SPECIAL_CASE": "Revenue not positive but company is marked as special case.",
    "REVENUE_NOT_POSITIVE": "Revenue is not positive.",
    "MISSING_OPERATING_MARGIN": "Operating margin missing.",
    "OPERATING_MARGIN_TOO_NEGATIVE_BUT_RECOVERABLE": "Operating margin is very negative, but company has special/growth exception.",
    "OPERATING_MARGIN_TOO_NEGATIVE": "Operating margin below Stage 2 minimum.",
    "OPERATING_MARGIN_WATCHLIST_RANGE": "Operating margin below pass threshold but above rejection threshold.",
    "MISSING_FCF_MARGIN": "FCF margin missing.",
    "FCF_MARGIN_TOO_NEGATIVE_BUT_RECOVERABLE": "FCF margin very negative, but company has special/growth exception.",
    "FCF_MARGIN_TOO_NEGATIVE": "FCF margin below Stage 2 minimum.",
    "FCF_MARGIN_WATCHLIST_RANGE": "FCF margin below pass threshold but above rejection threshold.",
    "MISSING_NET_DEBT_TO_EBITDA": "Net debt to EBITDA missing.",
    "DEBT_TOO_HIGH": "Net debt to EBITDA above Stage 2 maximum.",
    "DEBT_WATCHLIST_RANGE": "Net debt to EBITDA above pass threshold but below rejection threshold.",
    "MISSING_SHARES_DILUTION": "Shares dilution 3Y missing.",
    "MISSING_SHARES_DILUTION_PROVIDER_LIMITATION": "Shares dilution 3Y unavailable from the current free fundamentals provider; tracked as provider limitation, not as a clean-pass blocker.",
    "HIGH_DILUTION": "Shares dilution 3Y above Stage 2 maximum.",
    "DILUTION_WATCHLIST_RANGE": "Shares dilution 3Y above pass threshold but below rejection threshold.",
    "HIGH_RISK_SCORE": "Risk score is too high for Stage 3.",
    "LOW_DATA_QUALITY": "Data quality score is too low for Stage 3.",
    "LOW_FINAL_SCORE": "Final Stage 3 score below watchlist threshold.",
    "RISK_SCORE_WATCHLIST_RANGE": "Risk score above clean pass threshold.",
    "DATA_QUALITY_WATCHLIST_RANGE": "Data quality score below clean pass threshold.",
    "FINAL_SCORE_WATCHLIST_RANGE": "Final score below clean pass threshold.",
}
