"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources import sample_view

# The engines round a decimal tie such as 0.0078125 in different ways; both sides are pushed
# off the tie by an amount far above float noise and far below the last digit kept.
NUDGE = 1e-10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, timestamps as microseconds, whole numbers as long."""
    def column(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.round(c + NUDGE, digits)
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(c)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint")
        return c
    return df.select(*[column(f).alias(f.name) for f in df.schema.fields])


def round_sql(x: str, digits: int = 6) -> str:
    return f"round(cast({x} as double) + {NUDGE}, {digits})"


def rounded(sql: str, *names: str, digits: int = 6) -> str:
    """The same rounding on the SQL side."""
    if not names:
        return sql
    swaps = ", ".join(f"{round_sql(n, digits)} as {n}" for n in names)
    return f"select * replace ({swaps}) from (\n{sql}\n) as q"


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_view.transactions(spark, sf_dir)


def with_tx(sql: str, *names: str) -> str:
    """Put the transaction view in front of a query that reads `tx`."""
    joiner = "" if sql.startswith(",") else "\n"
    return f"with tx as (\n{sample_view.duck_transactions(*names)}\n){joiner}{sql}"


def log1p(x: str) -> str:
    return f"ln(1e0 + ({x}))"


def clip_sql(x: str, low, high) -> str:
    return f"case when ({x}) is not null then least(greatest(({x}), {low}), {high}) end"
