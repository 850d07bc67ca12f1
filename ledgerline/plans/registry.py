"""Query registry: name -> (Spark builder, DuckDB oracle SQL).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the driver
tables in ``sf_dir`` (or data Spark derives from them). Oracles are DuckDB SQL
over views named like the tables; ``None`` marks an operator that SQL cannot
express (it is then covered by a unit test against brute force).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    survey_id: str
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, survey_id: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Query(name, survey_id, fn, oracle)
        return fn
    return deco


def in_order(df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted DataFrame as they come out, from 1, so that
    an oracle can check the order (values alone are compared without it)."""
    from ledgerline.operators.numbering import number_as_sorted
    return number_as_sorted(df, name)


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    from ledgerline.plans import (  # noqa: F401
        q_catalog,
        q_diff,
        q_feed,
        q_orders,
        q_quality,
        q_reconcile,
        q_sources,
        q_stream,
        q_text,
    )
    return REGISTRY
