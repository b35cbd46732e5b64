"""Scalar functions, Column to Column.

Missing values: null, NaN and, for text, blank are the same.  Numbers that cannot be read are missing, never
an error.  Rounding is half up by ``floor(x * 10**n + 0.5) / 10**n``, the same steps in any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import json_text

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed text; missing becomes the empty text."""
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blank and the words nan and None become null."""
    t = F.trim(col(c).cast("string"))
    return F.when(~t.isin("", "nan", "None"), t)


def is_blank(c: Column | str) -> Column:
    return text(c) == ""


def number(c: Column | str) -> Column:
    """A double; null where it is missing, NaN or not a plain number."""
    t = F.trim(col(c).cast("string"))
    x = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(~F.isnan(x), x)


def real(c: Column | str) -> Column:
    """A double column with NaN as null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def rounded(c: Column, digits: int = 2) -> Column:
    """F33."""
    p = float(10**digits)
    return F.floor(c * p + 0.5) / p


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """F11; null stays null (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def scale10(c: Column, low: float, high: float) -> Column:
    """0 at ``low`` to 10 at ``high``; 0 if missing."""
    return F.coalesce(clamp((c - low) / (high - low) * 10.0, 0.0, 10.0), F.lit(0.0))


def inverse10(c: Column, low: float, high: float) -> Column:
    """10 at ``low`` to 0 at ``high``; 0 if missing, not 10."""
    return F.when(c.isNotNull(), 10.0 - scale10(c, low, high)).otherwise(F.lit(0.0))


def steps(c: Column, ladder: list[tuple[float, float]], least: float | None, missing: float | None = None) -> Column:
    """The value of the first rung that ``c`` reaches (from the highest), else ``least``; ``missing`` if null."""
    out = reduce(lambda acc, s: acc.when(c >= s[0], F.lit(s[1])), ladder, F.when(c.isNull(), F.lit(missing).cast("double")))
    return out.otherwise(F.lit(least).cast("double"))


def steps_down(c: Column, ladder: list[tuple[float, float]], most: float | None, missing: float | None = None) -> Column:
    """As ``steps``, for values that should be low: the first rung that ``c`` does not exceed."""
    out = reduce(lambda acc, s: acc.when(c <= s[0], F.lit(s[1])), ladder, F.when(c.isNull(), F.lit(missing).cast("double")))
    return out.otherwise(F.lit(most).cast("double"))


def mean_present(*parts: Column, default: float | None = None) -> Column:
    """Mean of those that are not null (F12, without rounding)."""
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(n > 0, total / n).otherwise(F.lit(default).cast("double"))


def ticker(c: Column | str, dollars: bool = False, spaces: bool = False) -> Column:
    """trimmed and upper; optionally without ``$`` or inner white space."""
    t = F.upper(text(c))
    t = F.replace(t, F.lit("$"), F.lit("")) if dollars else t
    return F.regexp_replace(t, r"\s+", "") if spaces else t


def provider_symbol(c: Column | str) -> Column:
    """F2."""
    return F.translate(ticker(c), "./", "--")


def collapse(c: Column | str) -> Column:
    """F3."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def compact(c: Column | str) -> Column:
    """lower letters and digits only."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def money(c: Column | str, parentheses: bool = True) -> Column:
    """``$1,234.5M``, ``(3K)``; the multiplier is the last letter of K, M, B, T."""
    t = F.trim(F.regexp_replace(text(c), "[$,%]", ""))
    negative = t.startswith("(") & t.endswith(")") if parentheses else F.lit(False)
    t = F.regexp_replace(t, r"^\(+|\)+$", "")
    unit = F.upper(F.right(t, F.lit(1)))
    times = F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)
    x = number(F.regexp_replace(t, r"[^0-9.\-]", "")) * times
    return F.when(negative, -x).otherwise(x)


def percent_or_ratio(c: Column | str) -> Column:
    """with a percent sign, or beyond 1.5, a percentage; else a ratio already."""
    x = money(c)
    return F.when(text(c).contains("%") | (F.abs(x) > 1.5), x / 100.0).otherwise(x)


def percent_to_ratio(c: Column) -> Column:
    """F7."""
    return rounded(c / 100.0, 6)


def percent_change(old: Column, new: Column) -> Column:
    """F8."""
    return F.when(old != 0, rounded((new / old - 1.0) * 100.0, 2))


def ratio(a: Column, b: Column) -> Column:
    """null where ``b`` is 0 or missing."""
    return F.try_divide(a, b)


def bucket(c: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """the first bucket whose upper edge ``c`` is below."""
    out = F.when(c.isNull(), F.lit("missing"))
    for edge, name in edges:
        out = out.when(c < edge, F.lit(name))
    return out.otherwise(F.lit(last))


def mapped(c: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    """Look ``c`` up; as it is, or ``default``, where the table has it not."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(c))
    return F.coalesce(found, col(c) if default is None else default)


#: What counts as true and false.
TRUE, FALSE = ("true", "1", "yes", "y", "si", "sí", "active", "activo"), ("false", "0", "no", "n", "inactive", "inactivo")


def tri_state(c: Column | str) -> Column:
    """true, false or null."""
    t = F.lower(text(c))
    return F.when(t.isin(*TRUE), F.lit(True)).when(t.isin(*FALSE), F.lit(False))


def two_state(c: Column | str) -> Column:
    """true for the four plain words only."""
    return F.lower(text(c)).isin("true", "1", "yes", "y")


def special_state(c: Column | str) -> Column:
    """true for what marks a special case."""
    return F.lower(text(c)).isin("true", "1", "yes", "y", "si", "sí", "special", "especial")


def region(country: Column | str) -> Column:
    """F15."""
    return F.when(F.upper(text(country)).isin("USA", "US", "UNITED STATES", "UNITED STATES OF AMERICA", "CANADA", "CA"), F.lit("North America")).otherwise(F.lit("Unknown"))


def isin_country(isin: Column | str) -> Column:
    """the prefix of two letters."""
    return F.substring(F.upper(text(isin)), 1, 2)


def derived_ratios(df: DataFrame, one_side: bool = False) -> DataFrame:
    """net debt, free cash flow margin and net debt to EBITDA where they are missing and can be had.

    With ``one_side``, debt or cash that is missing counts as 0 if the other is there.
    """
    debt, cash = real("total_debt"), real("cash")
    known = F.when(debt.isNotNull() | cash.isNotNull(), F.coalesce(debt, F.lit(0.0)) - F.coalesce(cash, F.lit(0.0))) if one_side else debt - cash
    out = df.withColumn("net_debt", F.coalesce(real("net_debt"), known))
    ratio = lambda x, y: F.when(real(y) != 0, real(x) / real(y))
    return out.withColumns({"fcf_margin": F.coalesce(real("fcf_margin"), ratio("free_cash_flow", "revenue_ttm")), "net_debt_to_ebitda": F.coalesce(real("net_debt_to_ebitda"), ratio("net_debt", "ebitda"))})


def local_code(c: Column | str) -> Column:
    """F18."""
    return F.regexp_replace(text(c), r"\.0$", "")


def contains_any(c: Column, words: list[str], strict: bool = False) -> Column:
    """does lower-cased ``c`` contain any of ``words``; with ``strict`` only at word boundaries."""
    low = F.lower(c)
    if strict:
        return low.rlike("|".join(rf"\b{w.strip()}\b" for w in words))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def first_match(c: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """the label of the first regular expression found in ``c``."""
    out = F.when(F.lit(False), F.lit(""))
    for label, pattern in patterns:
        out = out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def stamp_of_name(c: Column) -> Column:
    """the time in a file's stem, as in ``ABC_20240131_094500.json``."""
    found = F.regexp_extract(c, r"(\d{8})_(\d{6})", 0)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("yyyyMMdd_HHmmss")))


def number_text(c: Column, digits: int = 2) -> Column:
    """F23."""
    return F.coalesce(F.format_number(c, digits), F.lit(""))


def compact_usd(c: Column, units: str = "TBM") -> Column:
    """``$1.50B``; amounts beyond the largest of ``units`` stay in it."""
    parts = [(size, unit) for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M")) if unit in units]
    out = F.when(c.isNull(), F.lit(""))
    for size, unit in parts:
        out = out.when(F.abs(c) >= size, F.concat(F.lit("$"), F.regexp_replace(F.format_number(c / size, 2), ",", ""), F.lit(unit)))
    return out.otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))


def percent_text(c: Column) -> Column:
    """a ratio as ``12.34%``."""
    return F.coalesce(F.concat(F.regexp_replace(F.format_number(c * 100.0, 2), ",", ""), F.lit("%")), F.lit(""))


def shortened(c: Column, size: int = 120) -> Column:
    """F25."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 3), F.lit("..."))).otherwise(c)


def parts(c: Column | str, separator: str = "|") -> Column:
    """split, trimmed, without empty parts."""
    split = F.split(text(c), "\\" + separator if separator in "|.^$*+?()[]{}\\" else separator)
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")


def listed(*items: Column, separator: str = ";") -> Column:
    """Join those that are not null."""
    return F.concat_ws(separator, *items)


def joined(items: Column, separator: str = " | ") -> Column:
    """An array's distinct items, first come first, joined."""
    return F.array_join(F.array_distinct(items), separator)


def row_text(*cols: Column | str) -> Column:
    """F32: all values, upper-cased, for token search."""
    return F.upper(F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]))


def fingerprint(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the named columns of ``df`` as a JSON object with sorted keys."""
    return F.sha2(sorted_json(df, *columns), 256)


def rate(part: Column, whole: Column) -> Column:
    """percent, two decimals, 0 of 0 is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(rounded(part / whole * 100.0, 2))


#: Names that the red flags look for, under whatever prefix.
FLAG_NAMES = ("risk_score", "valuation_score", "growth_score", "data_quality_score", "data_completeness_score", "net_debt_to_ebitda", "operating_margin", "fcf_margin", "shares_dilution_3y")


def flattened(df: DataFrame) -> DataFrame:
    """nested fields as columns, names joined by ``_``, arrays and maps as JSON; the first field that ends in one of
    ``FLAG_NAMES`` is also there under that name.  The schema alone decides, so there is no look at the rows."""
    out: dict[str, Column] = {}

    def visit(prefix: str, c: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{prefix}_{f.name}" if prefix else f.name, c[f.name], f.dataType)
        else:
            out[prefix] = F.when(c.isNotNull(), json_text(c, kind, sort=False)) if isinstance(kind, (T.ArrayType, T.MapType)) else c

    for f in df.schema.fields:
        visit(f.name, F.col(f"`{f.name}`"), f.dataType)
    for name in FLAG_NAMES:
        found = next((c for k, c in out.items() if k.lower().endswith(name)), None)
        if name not in out and found is not None:
            out[name] = found
    return df.select(*[c.alias(k) for k, c in out.items()])


def parsed_json(c: Column, kind: str, fallback: Column) -> Column:
    """the value of a JSON text; ``fallback`` where it is null, empty or malformed."""
    return F.coalesce(F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, kind)), fallback)


def sorted_json(df: DataFrame, *columns: str) -> Column:
    """a JSON object of the named columns of ``df``: keys sorted at every depth, nulls kept, as ``canonical`` writes it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return json_text(F.struct(*[F.col(c) for c in columns]), T.StructType([T.StructField(c, kinds[c]) for c in columns]))
