"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a query builder with its oracle SQL (None = rows-only)."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from maskforge.plans import (  # noqa: F401
        q_corpus, q_tokens, q_marking, q_curation, q_metrics, q_stats, q_packing,
        q_runlog, q_streaming, q_paths, q_syntax,
    )
    return REGISTRY
