"""Column functions whose results differ between Spark and the host dialect, with the dialect's semantics.

All are compositions of built-in functions, so they stay in generated code and can be pushed down where Spark can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .regexps import every_match, first_match


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def substring(c: Column | str, start: int, length: int | None = None) -> Column:
    """From character start (1 is the first, negative counts from the end); start 0 leaves one character less."""
    c = _col(c)
    if start == 0:
        return F.substring(c, 1, 2**31 - 1) if length is None else F.substring(c, 1, max(0, length - 1))
    return F.substring(c, start, 2**31 - 1 if length is None else length)


def strlen(c: Column | str) -> Column:
    """Bytes of the UTF-8 form."""
    return F.octet_length(_col(c)).cast("long")


def length(c: Column | str) -> Column:
    """Characters."""
    return F.char_length(_col(c)).cast("long")


def like(c: Column | str, pattern: str) -> Column:
    r"""LIKE without an escape character: a backslash is a backslash."""
    return _col(c).like(pattern.replace("\\", "\\\\"))


def concat_ignore_null(*cols: Column | str) -> Column:
    """concat(): a null adds nothing."""
    return F.concat_ws("", *map(_col, cols))


def regexp_replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    r"""Replaces the first match alone; \1 in the replacement is the pattern's first group."""
    whole, put = first_match(pattern, replacement)
    return F.regexp_replace(_col(c), whole, put)


def regexp_replace_all(c: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(c), pattern, every_match(replacement))


def cast_int_round(c: Column | str, kind: str = "long", decimal: bool = False) -> Column:
    """A cast to a whole number that rounds: decimals half away from zero, doubles half to even."""
    c = _col(c)
    return (F.round(c, 0) if decimal else F.rint(c)).cast(kind)


def divide(a: Column | str, b: Column | str) -> Column:
    """/ of doubles: x / 0 is an infinity and 0 / 0 not a number, as IEEE has it, and not an error."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNull(), None).otherwise(zero)).otherwise(F.try_divide(a, b))


def int_divide(a: Column | str, b: Column | str) -> Column:
    """//: towards zero; null where b is 0, as TRY() of it is."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0)))).cast("long")


def modulo(a: Column | str, b: Column | str) -> Column:
    """%: the sign of a; null where b is 0."""
    return F.try_mod(_col(a), _col(b))


def millisecond(ts: Column | str) -> Column:
    """Milliseconds of the minute's seconds: 12.345 s gives 12345."""
    return F.floor(F.date_part(F.lit("SECOND"), _col(ts)) * 1000).cast("long")


def microsecond(ts: Column | str) -> Column:
    return F.floor(F.date_part(F.lit("SECOND"), _col(ts)) * 1000000).cast("long")


def date_trunc(unit: str, ts: Column | str) -> Column:
    """Without a time zone, as the argument."""
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


def count_distinct_tuple(*cols: Column | str) -> Column:
    """COUNT(DISTINCT (a, b)): a tuple counts though a member be null."""
    return F.count_distinct(F.struct(*map(_col, cols)))


def avg_double(c: Column | str) -> Column:
    """The mean as a double: a decimal's own mean has only four digits more than the decimal."""
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def money(c: Column | str, scale: int = 2) -> Column:
    """A double that holds exact hundredths as a decimal: sums are exact in any order."""
    return _col(c).cast(DecimalType(15, scale))


def asc(c: Column | str) -> Column:
    """Ascending, nulls last: the dialect's default both ways."""
    return _col(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    return _col(c).desc_nulls_last()


def error(message: str) -> Column:
    return F.raise_error(F.lit(message))
