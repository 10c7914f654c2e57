"""Registered queries of this subpackage and their SQL."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Rows of an Arrow batch: with long texts a batch must stay small beside a worker's memory.
ARROW_ROWS = 512


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark, folder: str):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")
