"""Scalar expressions.  All are built-in Catalyst expressions, so they stay in generated code.

Where Spark's own answer differs from SQL with IEEE arithmetic, a guard closes the gap:
division and remainder by zero, logarithms outside their domain, rounding casts, and the
types of ``floor`` and ``ceil``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def _double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add(a, b) -> Column:
    return _column(a) + _column(b)


def subtract(a, b) -> Column:
    return _column(a) - _column(b)


def multiply(a, b) -> Column:
    return _column(a) * _column(b)


def negate(a) -> Column:
    return -_column(a)


def compare(op: str, a, b) -> Column:
    """One of ``= <> < > <= >=``; null if either side is."""
    a, b = _column(a), _column(b)
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def divide(a, b) -> Column:
    """Double division; a zero divisor gives an infinity, or NaN for 0/0 and NaN/0."""
    a, b = _double(a), _double(b)
    negative_zero = b.cast("string").startswith("-")  # compared, -0.0 equals 0.0
    infinity = F.when((a > 0) != negative_zero, F.lit(_INF)).otherwise(F.lit(-_INF))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).otherwise(infinity)
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def modulo(a, b, floating: bool = False) -> Column:
    """Remainder with the dividend's sign.  A floating remainder by zero is NaN; an integer one raises."""
    a, b = _column(a), _column(b)
    if not floating:
        return a % b
    a, b = a.cast("double"), b.cast("double")
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(_NAN)).otherwise(a % F.when(b != 0, b))


def absolute(x) -> Column:
    return F.abs(_column(x))


def sqrt(x) -> Column:
    return F.sqrt(_double(x))


def exp(x) -> Column:
    return F.exp(_double(x))


def _logarithm(f, x) -> Column:
    """-inf at zero, NaN below; null only for null."""
    x = _double(x)
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(f(x))


def ln(x) -> Column:
    return _logarithm(F.log, x)


def log10(x) -> Column:
    return _logarithm(F.log10, x)


def log(x) -> Column:
    """Base 10, as in SQL with one argument; not Spark's natural logarithm."""
    return log10(x)


def log2(x) -> Column:
    return _logarithm(F.log2, x)


def sin(x) -> Column:
    return F.sin(_double(x))


def cos(x) -> Column:
    return F.cos(_double(x))


def tan(x) -> Column:
    return F.tan(_double(x))


def asin(x) -> Column:
    return F.asin(_double(x))


def acos(x) -> Column:
    return F.acos(_double(x))


def atan(x) -> Column:
    return F.atan(_double(x))


def atan2(y, x) -> Column:
    return F.atan2(_double(y), _double(x))


def power(x, y) -> Column:
    return F.pow(_double(x), _double(y))


def floor(x) -> Column:
    """A double, so that large values and infinities survive."""
    return _rounded(F.floor, x)


def ceil(x) -> Column:
    return _rounded(F.ceil, x)


def _rounded(f, x) -> Column:
    x = _double(x)
    # From 2**52 on every double is whole; Spark's BIGINT result would overflow at 2**63.
    return F.when(F.abs(x) >= float(1 << 52), x).when(F.isnan(x), x).otherwise(f(F.when(F.abs(x) < float(1 << 52), x)).cast("double"))


def radians(x) -> Column:
    return F.radians(_double(x))


def degrees(x) -> Column:
    return F.degrees(_double(x))


_WHOLE = {"tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte"}


def cast(x, to: str, source: str | None = None) -> Column:
    """CAST.  From a floating source to a whole type it rounds half to even, where Spark truncates."""
    x = _column(x)
    if to in _WHOLE and source in {"float", "double"}:
        return F.rint(x).cast(to)
    return x.cast(to)


def relaxed(f, *xs) -> Column:
    """``f`` on single-precision arguments, widened again: cheap, and only about seven digits good."""
    return f(*[_column(x).cast("float").cast("double") for x in xs]).cast("float").cast("double")
