"""Where queries over a corpus, and the SQL that gives the same rows, are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.stages import Corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Registers a query over a corpus, with the SQL that gives the same rows."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return register


def joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")
