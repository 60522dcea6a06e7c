"""Registration of a query with its output columns and reference SQL.

Output columns are declared once, ``"series:s d:d v:f n:n ok:b"``, and both
sides are shaped by that declaration: dates become ISO text, doubles are
rounded to six places, counts are 64-bit.  ``@name`` in SQL refers to a shared
base table of :mod:`tidemark.catalogue.bases`."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalogue.bases import BASE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHAPE = {
    "s": lambda c: F.col(c).cast("string"),
    "d": lambda c: F.col(c).cast("date").cast("string"),
    "f": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "n": lambda c: F.col(c).cast("bigint"),
    "b": lambda c: F.col(c).cast("boolean"),
}
SHAPE_SQL = {
    "s": "CAST({c} AS VARCHAR)", "d": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "f": "round(CAST({c} AS DOUBLE), 6) + 0.0", "n": "CAST({c} AS BIGINT)", "b": "CAST({c} AS BOOLEAN)",
}


def _with_bases(sql: str) -> tuple[str, list[str]]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"@(\w+)", text):
            if name not in order:
                visit(BASE_SQL[name])
                order.append(name)

    visit(sql)
    return re.sub(r"@(\w+)", r"base_\1", sql), order


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    spec = [c.split(":") for c in columns.split()]

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[SHAPE[k](c).alias(c) for c, k in spec])

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            body, order = _with_bases(sql)
            ctes = ", ".join(f"base_{b} AS ({_with_bases(BASE_SQL[b])[0]})" for b in order)
            cols = ", ".join(f"{SHAPE_SQL[k].format(c=c)} AS {c}" for c, k in spec)
            SQL[name] = (f"WITH {ctes} " if ctes else "") + f"SELECT {cols} FROM ({body.strip()}) AS result"
        return fn

    return register
