"""Registered queries and their SQL."""

from logloom.session import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark, folder: str, name: str, deal: bool = True):
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if deal else rows
