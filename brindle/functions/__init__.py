"""Scalar functions with the engine's documented semantics (IEEE arithmetic, base-10 ``log``)."""

from .registry import FUNCTIONS, ScalarFunction, names
from .scalar import (
    absolute,
    acos,
    add,
    asin,
    atan,
    atan2,
    cast,
    ceil,
    compare,
    cos,
    degrees,
    divide,
    exp,
    floor,
    ln,
    log,
    log2,
    log10,
    modulo,
    multiply,
    negate,
    power,
    radians,
    relaxed,
    sin,
    sqrt,
    subtract,
    tan,
)

__all__ = [
    "FUNCTIONS", "ScalarFunction", "absolute", "acos", "add", "asin", "atan", "atan2", "cast", "ceil", "compare", "cos", "degrees", "divide", "exp",
    "floor", "ln", "log", "log10", "log2", "modulo", "multiply", "names", "negate", "power", "radians", "relaxed", "sin", "sqrt", "subtract", "tan",
]
