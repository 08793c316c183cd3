"""Query registry: every operator as (spark, sf_dir) -> DataFrame plus its oracle SQL.

Reported DOUBLE columns are rounded to 6 significant digits on both sides
(``sig`` / ``sig_sql``), so results compare exactly regardless of the order
in which partial sums were combined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pricefold.functions.columns import sig, sig_sql


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = field(default_factory=tuple)
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if not self.doubles:
            return df
        return df.selectExpr(*[f"{sig(c, self.digits)} AS {c}" if c in self.doubles else c for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rep = ", ".join(f"{sig_sql(c, self.digits)} AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = (), digits: int = 6):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles), digits)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from pricefold.plans import queries_core  # noqa: F401
    from pricefold.plans import queries_table  # noqa: F401
    from pricefold.plans import queries_models  # noqa: F401
    from pricefold.plans import queries_reports  # noqa: F401
    from pricefold.plans import queries_backtest  # noqa: F401
    from pricefold.plans import queries_ml  # noqa: F401
    return REGISTRY

