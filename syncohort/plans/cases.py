"""Registered queries: each is a Spark plan and, where SQL can say it, a SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncohort.plans.derived import COHORT_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in columns.split()]


def _spark_output(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind == "i":
        return column.cast("bigint").alias(name)
    if kind == "s":
        return column.cast("string").alias(name)
    return (F.round(column.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def _sql_output(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    digits = int(kind[1:])
    return f'round(CAST("{name}" AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS "{name}"'


def case(
    name: str, columns: str, sql: str | None = None, ctes: str = "", recursive: bool = False
):
    """Register a query.

    `columns` names the output with its type: `i` integer, `s` text, `f6` a double
    rounded to six digits in the last projection. `sql` is the body of the check;
    the derived cohort's common table expressions and `ctes` come before it, `recursive`
    says that one of them refers to itself.
    """
    spec = _parse(columns)

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            return build(spark, folder).select(*[_spark_output(n, k) for n, k in spec])

        query.__doc__ = build.__doc__
        QUERIES[name] = query
        if sql is not None:
            outputs = ", ".join(_sql_output(n, k) for n, k in spec)
            extra = f", {ctes.strip().rstrip(',')}" if ctes.strip() else ""
            CHECKS[name] = (
                f"WITH {'RECURSIVE ' if recursive else ''}{COHORT_SQL.strip()}{extra}, "
                f"result AS ({sql}) SELECT {outputs} FROM result"
            )
        return build

    return register
