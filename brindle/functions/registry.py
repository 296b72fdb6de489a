"""The scalar functions by SQL name, with arity, cost and whether results are exact."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from . import scalar as S


@dataclass(frozen=True)
class ScalarFunction:
    name: str
    arity: int
    build: Callable[..., Column]
    cost: int
    exact: bool  # the same bits on every IEEE platform


#: Relative cost of one evaluation.  Simple arithmetic 1, multiplication and
#: division 2, roots 4, transcendental functions 30.
SIMPLE, PRODUCT, ROOT, TRANSCENDENTAL = 1, 2, 4, 30


def _entries() -> list[ScalarFunction]:
    out = [ScalarFunction(op, 2, f, c, True) for op, f, c in (("+", S.add, SIMPLE), ("-", S.subtract, SIMPLE), ("*", S.multiply, PRODUCT), ("/", S.divide, PRODUCT), ("%", S.modulo, PRODUCT))]
    out += [ScalarFunction(op, 2, lambda a, b, op=op: S.compare(op, a, b), SIMPLE, True) for op in ("=", "<>", "<", ">", "<=", ">=")]
    out += [ScalarFunction(n, 1, getattr(S, f), SIMPLE, True) for n, f in (("negate", "negate"), ("abs", "absolute"), ("floor", "floor"), ("ceil", "ceil"), ("ceiling", "ceil"), ("radians", "radians"), ("degrees", "degrees"))]
    out += [ScalarFunction("sqrt", 1, S.sqrt, ROOT, True)]
    out += [ScalarFunction(n, 1, getattr(S, n), TRANSCENDENTAL, False) for n in ("exp", "ln", "log", "log10", "log2", "sin", "cos", "tan", "asin", "acos", "atan")]
    out += [ScalarFunction(n, 2, getattr(S, f), TRANSCENDENTAL, False) for n, f in (("pow", "power"), ("power", "power"), ("atan2", "atan2"))]
    return out


FUNCTIONS: dict[str, ScalarFunction] = {f.name: f for f in _entries()}


def names(exact_only: bool = False) -> list[str]:
    """Function names; with ``exact_only`` those that strict floating-point mode allows."""
    return sorted(n for n, f in FUNCTIONS.items() if f.exact or not exact_only)
