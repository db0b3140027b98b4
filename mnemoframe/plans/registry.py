"""Registry of queries: a callable over the test tables and, where SQL can say the same, its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables and to the views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        from . import views
        if name in views.VIEWS:
            return views.VIEWS[name](self)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(name: str, sql: str | None = None, rounded: dict[str, int] | tuple = ()):
    """Register a query. `rounded` names double columns that both sides round (6 digits unless given)."""
    digits = rounded if isinstance(rounded, dict) else {c: 6 for c in rounded}

    def wrap(fn):
        def run(spark, path):
            df = fn(Tables(spark, path))
            for c, d in digits.items():
                df = df.withColumn(c, F.round(F.col(c).cast("double"), d) + F.lit(0.0))
            return df

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if digits:
                rep = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + 0.0e0 AS {c}" for c, d in digits.items())
                text = f"SELECT * REPLACE ({rep}) FROM ({text}) AS q"
            ORACLES[name] = text
        return fn

    return wrap
