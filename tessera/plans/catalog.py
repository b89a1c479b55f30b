"""Registration of queries: a name, what builds the DataFrame, and the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import NAMES, Tables
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as the query name; sql states its result in the host dialect."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return build

    return add


def text(name: str, sql: str) -> None:
    """Registers a text of the host dialect: the engine and the oracle run the same words."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        Tables(spark, folder).register(*(n for n in NAMES if re.search(rf"\b{n}\b", sql)))
        return Engine(spark).sql(sql)

    QUERIES[name], ORACLE[name] = run, sql


def again_as_text(*names: str) -> None:
    """Registers sql_<name> for queries built of columns: the text that states their result, run by the engine as it stands."""
    for name in names:
        text(f"sql_{name}", ORACLE[name])
