from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from brindle import functions as fn

CASES = [
    (lambda: fn.divide(F.lit(1.0), F.lit(0.0)), math.inf),
    (lambda: fn.divide(F.lit(1.0), F.lit(-0.0)), -math.inf),
    (lambda: fn.divide(F.lit(-1.0), F.lit(0.0)), -math.inf),
    (lambda: fn.divide(F.lit(0.0), F.lit(0.0)), math.nan),
    (lambda: fn.divide(F.lit(None).cast("double"), F.lit(0.0)), None),
    (lambda: fn.divide(F.lit(7), F.lit(2)), 3.5),
    (lambda: fn.modulo(F.lit(5.0), F.lit(0.0), floating=True), math.nan),
    (lambda: fn.modulo(F.lit(-7), F.lit(3)), -1),
    (lambda: fn.ln(F.lit(0.0)), -math.inf),
    (lambda: fn.ln(F.lit(-1.0)), math.nan),
    (lambda: fn.log(F.lit(100.0)), 2.0),
    (lambda: fn.log2(F.lit(8.0)), 3.0),
    (lambda: fn.log(F.lit(None).cast("double")), None),
    (lambda: fn.floor(F.lit(-1.5)), -2.0),
    (lambda: fn.ceil(F.lit(1.2)), 2.0),
    (lambda: fn.floor(F.lit(math.inf)), math.inf),
    (lambda: fn.floor(F.lit(1e300)), 1e300),
    (lambda: fn.floor(F.lit(math.nan)), math.nan),
    (lambda: fn.asin(F.lit(2.0)), math.nan),
    (lambda: fn.cast(F.lit(3.5), "int", "double"), 4),
    (lambda: fn.cast(F.lit(2.5), "int", "double"), 2),
    (lambda: fn.cast(F.lit(-2.5), "int", "double"), -2),
    (lambda: fn.degrees(fn.radians(F.lit(180.0))), 180.0),
    (lambda: fn.power(F.lit(2.0), F.lit(10.0)), 1024.0),
    (lambda: fn.negate(F.lit(3)), -3),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_semantics(spark, i):
    build, want = CASES[i]
    got = spark.range(1).select(build().alias("v")).first()["v"]
    assert (isinstance(want, float) and math.isnan(want) and math.isnan(got)) or got == want


def test_overflow_and_narrowing_raise(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.sql("SELECT CAST(2147483647 AS INT) + CAST(1 AS INT) AS v").collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(fn.cast(F.lit(3e9), "int", "double")).collect()


def test_registry_has_every_form():
    assert {"=", "<>", "<", ">", "<=", ">="} <= set(fn.names())
    assert {"+", "-", "*", "/", "%", "negate", "abs"} <= set(fn.names())
    assert set(fn.names(exact_only=True)) & {"sin", "exp", "ln"} == set()
    assert {"sqrt", "floor", "ceil", "abs", "radians", "degrees"} <= set(fn.names(exact_only=True))
    assert fn.FUNCTIONS["sin"].cost == 30 and fn.FUNCTIONS["sqrt"].cost == 4 and fn.FUNCTIONS["%"].cost == 2
