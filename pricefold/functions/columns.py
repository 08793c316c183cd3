"""Expression helpers.

Operators build Spark SQL *expression strings* and apply them with
``selectExpr`` / ``F.expr``: the whole expression is parsed JVM-side in one
call, which keeps plan construction cheap (building large Column trees one
py4j call at a time is far slower than parsing one string), and the result is
the same Catalyst expression tree, fully inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 97.5 % standard normal quantile (fixed value used for 95 % two-sided intervals).
Z975 = 1.959963984540054
TWO_PI = 2.0 * math.pi


def E(s: str) -> Column:
    return F.expr(s)


def D(x: float) -> str:
    """A DOUBLE literal in Spark SQL text (plain 1.5 would parse as DECIMAL)."""
    return f"{float(x)!r}D"


def clip(x: str, lo: float, hi: float) -> str:
    return f"greatest({D(lo)}, least({D(hi)}, {x}))"


def sig(x: str, digits: int = 6) -> str:
    """Round a DOUBLE expression to ``digits`` significant digits (Spark SQL text).

    Reported outputs are rounded so results do not depend on the order in
    which partial sums were combined. Only exact operations are used (powers
    of ten, floor(x + 0.5)), so every IEEE engine gets the same bits.
    """
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (
        f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) = 0 OR abs({x}) = double('Infinity') THEN ({x}) "
        f"WHEN {k} >= 0 THEN floor(({x}) * pow(10.0D, {k}) + 0.5D) / pow(10.0D, {k}) "
        f"ELSE floor(({x}) / pow(10.0D, -{k}) + 0.5D) * pow(10.0D, -{k}) END)"
    )


def sig_sql(expr: str, digits: int = 6) -> str:
    """The same rounding as :func:`sig`, as DuckDB SQL text for the oracle."""
    e = f"floor(log10(abs({expr})))"
    k = f"({digits - 1} - {e})"
    return (
        f"(CASE WHEN ({expr}) IS NULL OR isnan({expr}) OR ({expr}) = 0 OR isinf({expr}) THEN ({expr}) "
        f"WHEN {k} >= 0 THEN floor(({expr}) * pow(10.0, {k}) + 0.5) / pow(10.0, {k}) "
        f"ELSE floor(({expr}) / pow(10.0, -{k}) + 0.5) * pow(10.0, -{k}) END)"
    )


def _t_terms() -> tuple[float, float, float, float]:
    z = Z975
    t1 = (z**3 + z) / 4.0
    t2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    t3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    t4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0
    return t1, t2, t3, t4


def t975(v: str) -> str:
    """Student-t 97.5 % quantile for ``v`` degrees of freedom (Spark SQL text).

    Cornish-Fisher expansion around the normal quantile (4 terms); accurate
    to ~1e-4 for df >= 8, which is all the elasticity fit uses (n >= 10).
    """
    t1, t2, t3, t4 = _t_terms()
    vv = f"CAST({v} AS DOUBLE)"
    return (
        f"({Z975!r}D + {t1!r}D / {vv} + {t2!r}D / ({vv} * {vv}) + {t3!r}D / ({vv} * {vv} * {vv})"
        f" + {t4!r}D / ({vv} * {vv} * {vv} * {vv}))"
    )

