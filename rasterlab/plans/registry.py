"""Registry pairing each Spark query with an independent SQL statement for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlab.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``uses`` lists the views its SQL builds on."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(uses, sql)
        return fn

    return register


def statement(uses: str, sql: str) -> str:
    """Prefixes ``sql`` (a SELECT, or further CTEs then a SELECT) with the named views."""
    sql = sql.strip()
    ctes = ",\n".join(f"{v} AS ({views.SQL[v].strip()})" for v in uses.split())
    # RECURSIVE only permits self-reference; statements without it are unaffected
    if not ctes:
        return sql if sql.upper().startswith("SELECT") else f"WITH RECURSIVE {sql}"
    return f"WITH {ctes}\n{sql}" if sql.upper().startswith("SELECT") else f"WITH RECURSIVE {ctes},\n{sql}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column, so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
