"""Named queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import load, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = load(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def wide(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table whose rows carry much work: spread over the cluster when it sits in few files."""
    return spread(table(spark, sf_dir, name, *cols))


# SQL fragments shared by the checks
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')"


def toks(expr: str) -> str:
    return TOKENS.format(expr)


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def hashed(seed: int, *exprs: str) -> str:
    """The same 60-bit key as ``corpusloom.ids.seeded_key``."""
    parts = ", ".join(f"cast({e} as varchar)" for e in exprs)
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 15) as bigint)"
