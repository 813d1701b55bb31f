"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import queries_corpus, queries_monitor, queries_render, queries_reward, queries_score

_MODULES = [queries_corpus, queries_score, queries_reward, queries_render, queries_monitor]


def _shipped(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update({k: _shipped(v) for k, v in m.queries().items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.oracles())
    return out
