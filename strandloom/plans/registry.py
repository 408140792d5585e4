"""Registered queries: each has a Spark plan and, where SQL can say it, a DuckDB query with the same columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.derive import sql_with, table

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Entry:
    plan: Plan
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, plan: Plan, sql: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """``plan`` maps a table lookup to a DataFrame; ``sql`` may use the derived ``tables``."""
    if name in ENTRIES:
        raise ValueError(f"query {name} is registered twice")
    if sql is not None and tables:
        head = sql_with(*tables)
        body = sql.strip()
        if body[:15].upper() == "WITH RECURSIVE ":
            head, body = "WITH RECURSIVE " + head[5:], "WITH " + body[15:]
        sql = head.rstrip() + ",\n" + body[5:] if body[:5].upper() == "WITH " else head + body
    ENTRIES[name] = Entry(plan, sql)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES[name].plan(lambda t: table(spark, sf_dir, t))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, n=n: run(n, spark, sf_dir)) for n in ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in ENTRIES.items() if e.sql is not None}
