"""Registered queries: a Spark plan, its result columns, and SQL for the cross-check."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import views

# kind -> (Spark type, SQL type)
KINDS = {"i": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN"),
         "d": ("double", "DOUBLE")}
DIGITS = 9  # sums differ in order between runs, so doubles are compared after rounding


def parse_columns(text: str) -> list[tuple[str, str]]:
    """``"n:i auc:d name"`` -> [(name, kind)]; the default kind is a string."""
    out = []
    for item in text.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "s"))
    return out


def shaped(df: DataFrame, columns: str) -> DataFrame:
    def one(name, kind) -> Column:
        c = F.col(name).cast(KINDS[kind][0])
        if kind == "d":
            c = F.round(F.when(F.isnan(c), F.lit(None)).otherwise(c), DIGITS) + F.lit(0.0)
        return c.alias(name)
    return df.select(*[one(n, k) for n, k in parse_columns(columns)])


def shaped_sql(sql: str, columns: str) -> str:
    def one(name, kind):
        c = f"CAST({name} AS {KINDS[kind][1]})"
        if kind == "d":
            c = f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, {DIGITS}) + 0.0"
        return f"{c} AS {name}"
    cols = ", ".join(one(n, k) for n, k in parse_columns(columns))
    return f"{views.with_clause(sql)}SELECT {cols} FROM (\n{sql.strip()}\n) AS result"


@dataclass
class Query:
    name: str
    columns: str
    build: Callable
    sql: str | None

    def run(self, spark, sf_dir: str) -> DataFrame:
        return shaped(self.build(views.Tables(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else shaped_sql(self.sql, self.columns)


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, columns, fn, sql)
        return fn
    return register


def words(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
