"""Named queries, each with its Spark function and, where SQL can say it, its twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import CTES, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(model) -> DataFrame`` as ``name``; ``sql`` follows the model's CTEs."""

    def add(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Model(spark, sf_dir))
        if sql is not None:
            text = f"{CTES}{sql}" if sql.lstrip().startswith(",") else f"{CTES}\n{sql}"
            # Tables that several others read are computed once.
            ORACLES[name] = re.sub(r"\b(\w+) as \(\n", r"\1 as materialized (\n", text)
        return build

    return add
