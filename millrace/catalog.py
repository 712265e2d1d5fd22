"""All relational queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions import user
from .isolation import queries as isolation
from .plans import relational
from .sources import formats
from .sources.tables import TABLES, register
from .streaming import queries as streaming

_ALL = {**relational.QUERIES, **formats.QUERIES, **user.QUERIES, **streaming.QUERIES, **isolation.QUERIES}


def _sql(text: str):
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(text)

    return run


def queries():
    return {name: _sql(q) if isinstance(q, str) else q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; queries that SQL cannot express have none."""
    out = {}
    for name, (q, other) in _ALL.items():
        if other or isinstance(q, str):
            out[name] = other or q
    return out
