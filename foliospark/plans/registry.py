"""Registry of named operations: each has a query and, where SQL can express it, SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
OPERATIONS: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, version: int = 1) -> Callable[[Query], Query]:
    """Names a query `<name>.v<version>`; a name that is taken in that version is refused."""
    key = f"{name}.v{version}"

    def add(query: Query) -> Query:
        if key in OPERATIONS:
            raise ValueError(f"operation {key} is registered already")
        OPERATIONS[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


def latest(found: dict) -> dict:
    """By plain name, what is registered under its highest version."""
    split = sorted((key.rpartition(".v") for key in found), key=lambda x: int(x[2]))
    return {name: found[f"{name}.v{version}"] for name, _, version in split}


def chain(df: DataFrame, steps: list[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """Steps applied one after another, each with its own options."""
    for step, options in steps:
        df = df.transform(step, **options)
    return df
