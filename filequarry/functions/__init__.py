"""The scalar functions, as Column builders and as the SQL that the dialect puts in their place.

Strings count in characters. A null string is an empty one to CONCAT, and COALESCE and IFNULL pass over empty strings.
What cannot be computed is null: a division by zero, the root of a negative number, the year of what is no date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r"
_SPACES_SQL = r"' \t\n\r'"


def trim(s: Column) -> Column:
    return F.trim(s, F.lit(SPACES))


def ltrim(s: Column) -> Column:
    return F.ltrim(s, F.lit(SPACES))


def rtrim(s: Column) -> Column:
    return F.rtrim(s, F.lit(SPACES))


def substr(s: Column, pos: Column | int, length: Column | int | None = None) -> Column:
    """Characters from position pos, from 1; empty if pos is below 1 or length below 0."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    length = F.length(s) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.when(s.isNull(), None).when((pos < 1) | (length < 0), F.lit("")).otherwise(F.substring(s, pos, length))


def concat(*parts: Column) -> Column:
    return F.concat_ws("", *[p.cast("string") for p in parts]) if parts else F.lit("")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def as_date(s: Column) -> Column:
    """A date from YYYY-MM-DD, with a time or not, MM/DD/YYYY or DD-MM-YYYY; null for what is none."""
    t = s.cast("string")
    return F.coalesce(t.try_cast("date"), F.try_to_date(t, "MM/dd/yyyy"), F.try_to_date(t, "dd-MM-yyyy"))


def date(s: Column | None = None) -> Column:
    """Today, or the date of s as text; text that is no date stays as it is."""
    return F.current_date().cast("string") if s is None else F.coalesce(as_date(s).cast("string"), s.cast("string"))


def year(s: Column) -> Column:
    return F.year(as_date(s))


def month(s: Column) -> Column:
    return F.month(as_date(s))


def day(s: Column) -> Column:
    return F.day(as_date(s))


def filled(s: Column) -> Column:
    """A string column with empty values as nulls."""
    return F.nullif(s, F.lit(""))


def coalesce(*parts: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[filled(p.cast("string")) for p in parts])


def ifnull(s: Column, default: Column) -> Column:
    return F.coalesce(filled(s.cast("string")), default.cast("string"))


def is_blank(s: Column) -> Column:
    return s.isNull() | (s == "")


# ---- SQL: name -> (least and most arguments, text from normalised arguments)


def _as_date_sql(a: str) -> str:
    t = f"CAST({a} AS STRING)"
    return f"coalesce(try_cast({t} AS DATE), try_to_date({t}, 'MM/dd/yyyy'), try_to_date({t}, 'dd-MM-yyyy'))"


def _substr_sql(*a: str) -> str:
    size = a[2] if len(a) > 2 else f"length({a[0]})"
    return f"CASE WHEN {a[0]} IS NOT NULL THEN CASE WHEN ({a[1]}) < 1 OR ({size}) < 0 THEN '' ELSE substring({a[0]}, {a[1]}, {size}) END END"


def _date_sql(*a: str) -> str:
    return f"coalesce(CAST({_as_date_sql(a[0])} AS STRING), CAST({a[0]} AS STRING))" if a else "CAST(current_date() AS STRING)"


SQL: dict[str, tuple[int, int, Callable[..., str]]] = {
    "LEN": (1, 1, lambda s: f"length({s})"),
    "SUBSTR": (2, 3, _substr_sql),
    "SUBSTRING": (2, 3, _substr_sql),
    "TRIM": (1, 1, lambda s: f"trim(BOTH {_SPACES_SQL} FROM {s})"),
    "LTRIM": (1, 1, lambda s: f"trim(LEADING {_SPACES_SQL} FROM {s})"),
    "RTRIM": (1, 1, lambda s: f"trim(TRAILING {_SPACES_SQL} FROM {s})"),
    "CONCAT": (0, 255, lambda *a: f"concat_ws('', {', '.join(a)})" if a else "''"),
    "FLOOR": (1, 1, lambda x: f"CAST(floor({x}) AS DOUBLE)"),
    "CEIL": (1, 1, lambda x: f"CAST(ceil({x}) AS DOUBLE)"),
    "CEILING": (1, 1, lambda x: f"CAST(ceil({x}) AS DOUBLE)"),
    "MOD": (2, 2, lambda a, b: f"try_mod({a}, {b})"),
    "MODULO": (2, 2, lambda a, b: f"try_mod({a}, {b})"),
    "POW": (2, 2, lambda a, b: f"power({a}, {b})"),
    "SQRT": (1, 1, lambda x: f"CASE WHEN ({x}) >= 0 THEN sqrt({x}) END"),
    "SIGN": (1, 1, lambda x: f"CAST(signum({x}) AS INT)"),
    "NOW": (0, 0, lambda: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')"),
    "DATE": (0, 1, _date_sql),
    "YEAR": (1, 1, lambda s: f"year({_as_date_sql(s)})"),
    "MONTH": (1, 1, lambda s: f"month({_as_date_sql(s)})"),
    "DAY": (1, 1, lambda s: f"day({_as_date_sql(s)})"),
}
