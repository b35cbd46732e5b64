"""JSON texts whose bytes are fixed, so that hashes of them are the same everywhere.

A value is written as ``json.dumps(value, ensure_ascii=False)`` writes it: ``", "`` and ``": "`` between items, nulls kept, and with
``sort`` the keys of every object, at every depth, in the order of their code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMED = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all others as they are."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for n in range(32):
        rare = F.replace(rare, F.lit(chr(n)), F.lit(NAMED.get(chr(n), f"\\u{n:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def real_text(c: Column) -> Column:
    """A double by its shortest digits: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    s = c.cast("string")
    plain = s.cast("decimal(38,21)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    wide = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    size = F.abs(c)
    finite = F.when(c == 0, s).when((size >= 1e-4) & (size < 1e16), plain).otherwise(wide)
    return F.when(F.isnan(c), F.lit("NaN")).when(size == float("inf"), F.when(c > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))).otherwise(finite)


def json_text(c: Column, kind: T.DataType, sort: bool = True) -> Column:
    """The text of a value of type ``kind``; a null is ``null``."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name) if sort else kind.fields
        made = [F.concat(quoted(F.lit(f.name)), F.lit(": "), json_text(c[f.name], f.dataType, sort)) for f in fields]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *made), F.lit("}")))
    elif isinstance(kind, T.MapType):
        entries = F.map_entries(c)
        entries = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)) if sort else entries
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType, sort))), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType, sort)), ", "), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = real_text(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        out = c.cast("string")
    else:
        out = quoted(c.cast("string"))
    return F.coalesce(out, F.lit("null"))
