"""Registry of named queries. A query is a callable plus, where possible, the same result in SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import prepare
            return rounded(fn(prepare(spark), sf_dir))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def stable(c):
    """Six digits. The nudge keeps exact ties from falling either way with summation order."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column, so that results compare across engines."""
    return df.select(*[
        stable(F.col(f"`{f.name}`").cast("double")).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])
