"""Where queries and the SQL that they must agree with are registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def pick(values: Sequence[str], at: Column) -> Column:
    """The value at place ``at`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: Sequence[str], at: str) -> str:
    return f"{sql_list(values)}[CAST(({at}) % {len(values)} + 1 AS INTEGER)]"


def sql_case(rules: Sequence[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {holds} THEN {quoted(name)}" for name, holds in rules) + f" ELSE {quoted(otherwise)} END"


def sql_says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)}, 'i')"
