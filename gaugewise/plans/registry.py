"""Registry of runnable queries, each with the SQL that defines its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Sums of doubles depend on their order in the last digits, so results are rounded. Means of
# decimal data often lie exactly between two roundings; the shift takes them off that point.
SHIFT = "1e-9"


def e6(expression: str, alias: str | None = None) -> str:
    """Spark text: rounded to six decimals."""
    return f"round({expression} + {SHIFT}D, 6)" + (f" AS `{alias}`" if alias else "")


def r6(column: str, alias: str | None = None) -> Column:
    return F.expr(e6(column)).alias(alias or column)


def s6(expression: str, alias: str | None = None) -> str:
    """Oracle text: the same rounding, without negative zeros."""
    return f"round({expression} + {SHIFT}, 6) + 0.0 AS {alias or expression}"


def time_text(column: str = "ts", alias: str | None = None) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(alias or column)


def sql_time_text(column: str = "ts", alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column.split('.')[-1]}"
