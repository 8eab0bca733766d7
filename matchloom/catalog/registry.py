"""Registry: a query name, its Spark builder and (where SQL can say it) its check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.session import jit_sized
from matchloom.sources.derived import TABLES, Tables, duck_table

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in BUILDERS:
            raise ValueError(f"duplicate query {name}")
        BUILDERS[name] = fn
        if sql:
            CHECKS[name] = with_inputs(sql)
        return fn

    return register


def with_inputs(sql: str) -> str:
    """Prefix the derived input tables the statement mentions as CTEs."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{t} AS MATERIALIZED ({duck_table(t)})" for t in used)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive'):].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def r4(e: str) -> str:
    """Round half up to 4 digits with the same floating operations in both engines."""
    return f"floor(({e}) * 10000e0 + 0.5e0) / 10000e0"


def r1(e: str) -> str:
    return f"floor(({e}) * 10e0 + 0.5e0) / 10e0"


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = BUILDERS[name]
    return lambda spark, sf_dir: fn(Tables(jit_sized(spark), sf_dir))
