"""The named queries and the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded, so that summation order does not show."""
    name = column if isinstance(column, str) else None
    out = F.round(F.col(column) if name else column, digits)
    return out.alias(name) if name else out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files a query writes and reads back.

    It lies in the shared checkpoint folder when the cluster names one.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix=f"lociframe-{name}-")
    import uuid

    return f"{shared}/lociframe-{name}-{uuid.uuid4().hex}"
