"""Registry of queries: a Spark job, its output columns, and the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .bindings import SQL_BINDINGS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    job: Callable[[Tables], DataFrame]
    body: str | None
    uses: str

    @property
    def sql(self) -> str | None:
        return _normalized_sql(self.body, self.columns, self.uses) if self.body else None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalized(self.job(Tables(configure(spark), sf_dir)), self.columns)


REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(item.split(":")) for item in spec.split())


def normalized(df: DataFrame, columns) -> DataFrame:
    """Cast to the three output types both engines share; doubles to six decimals, never -0."""
    out = []
    for name, kind in columns:
        value = F.col(name)
        if kind == "i":
            value = value.cast("bigint")
        elif kind == "s":
            value = value.cast("string")
        else:
            value = F.round(F.nullif(value.cast("double"), F.lit(float("nan"))), 6) + F.lit(0.0)
        out.append(value.alias(name))
    return df.select(*out)


def _normalized_sql(body: str, columns, uses: str) -> str:
    casts = {
        "i": "CAST({0} AS BIGINT) AS {0}",
        "s": "CAST({0} AS VARCHAR) AS {0}",
        "d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}",
    }
    select = ", ".join(casts[kind].format(f'"{name}"') for name, kind in columns)
    ctes: list[str] = []

    def add(name: str) -> None:
        needs, text = SQL_BINDINGS[name]
        for other in needs:
            add(other)
        # Shared parts are evaluated once; a recursive part can't be marked so.
        once = "" if re.search(rf"\b{name}\b", text) else "MATERIALIZED "
        cte = f"{name} AS {once}({text})"
        if cte not in ctes:
            ctes.append(cte)

    for name in uses.split():
        add(name)
    ctes.append(f"answer AS ({body.strip()})")
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {select} FROM answer"


def query(name: str, spec: str, sql: str | None = None, uses: str = ""):
    """Register ``job(tables) -> DataFrame`` under ``name``.

    ``spec`` lists ``column:type`` with types i (bigint), d (double) and s (string).
    """

    def wrap(job: Callable[[Tables], DataFrame]):
        columns = _columns(spec)
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, columns, job, sql, uses)
        return job

    return wrap
