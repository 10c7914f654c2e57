"""Streams of log files and of scored batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.operators import kb
from logloom.operators.parse import parse_lines
from logloom.functions.scalars import row_id
from logloom.sources.log_table import exists, folder_names


def numbered_stream(spark: SparkSession, folder: str, glob: str = "*.log", files_per_trigger: int | None = None) -> DataFrame:
    """(line, source_path, source_file, line_number) of files as they arrive; the checkpoint is the resume point.

    Lines are numbered inside their block of the file. In a file of one block the number, and with it the
    row id, is the batch reader's; later blocks of a file are named as sources of their own.
    """
    reader = spark.readStream.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(folder).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
    )
    numbered = lines.mapInPandas(
        _numbered, "line string, source_path string, source_file string, block bigint, line_number bigint"
    )
    place = F.when(F.col("block") == 0, F.col("source_path")).otherwise(F.concat_ws(":", "source_path", "block"))
    return numbered.withColumn("source_path", place).drop("block")


def parsed_stream(spark: SparkSession, folder: str, glob: str = "*.log", files_per_trigger: int | None = None) -> DataFrame:
    """The same, parsed, with row ids."""
    lines = numbered_stream(spark, folder, glob, files_per_trigger)
    return parse_lines(lines).withColumn("log_id", row_id(F.col("source_path"), F.col("line_number")))


def _numbered(batches):
    """The lines of a file's block come in order, one block after the other."""
    last, count = None, 0
    for batch in batches:
        numbers = batch.groupby(["source_path", "block"], sort=False).cumcount() + 1
        if len(batch):
            same = (batch["source_path"] == (last or [None])[0]) & (batch["block"] == (last or [None, None])[1])
            numbers = numbers + same.astype("int64") * count
            last, count = (batch["source_path"].iloc[-1], batch["block"].iloc[-1]), int(numbers.iloc[-1])
        yield batch.assign(line_number=numbers)


def append_stream(parsed: DataFrame, path: str, checkpoint: str):
    """Append everything that is there now, then stop; call again to go on."""
    return (
        parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def ingest_stream(lines: DataFrame, home: str, checkpoint: str):
    """A stream of numbered lines (source_path, source_file, line_number, line) into log rows with templates.

    Every batch goes on from the templates that the batch before it left, so two instalments give the rows and templates
    of one. A batch writes its rows, its new members and its templates to folders of its number: repeated
    after a failure, it reads and writes the same ones.
    """
    from logloom.plans.jobs import log_rows

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = f"run={_run(spark, home, checkpoint)}"
        before = [n for n in _numbers(spark, f"{home}/templates/{run}") if n < number]
        known = None
        if before:
            members = spark.read.parquet(*(f"{home}/members/{run}/batch={n}" for n in before))
            known = spark.read.parquet(f"{home}/templates/{run}/batch={before[-1]}"), members
        rows, found, members = log_rows(batch, known=known)
        if known:
            members = members.join(known[1].select("masked"), "masked", "left_anti")
        for name, df in (("members", members), ("logs", rows), ("templates", found)):
            df.write.mode("overwrite").parquet(f"{home}/{name}/{run}/batch={number}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """(log rows, templates) of the latest run's batches so far."""
    run = f"run={_numbers(spark, f'{home}/templates')[-1]}"
    last = [n for n in _numbers(spark, f"{home}/templates/{run}") if exists(spark, f"{home}/templates/{run}/batch={n}/_SUCCESS")][-1]
    return spark.read.parquet(f"{home}/logs/{run}").drop("batch"), spark.read.parquet(f"{home}/templates/{run}/batch={last}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in folder_names(spark, path) if "=" in name)


def _run(spark: SparkSession, home: str, checkpoint: str) -> int:
    """The number of the run that a checkpoint belongs to: a new checkpoint is a new run, whose batches count from 0."""
    mark = f"{home}/_runs/{hashlib.sha1(checkpoint.encode()).hexdigest()}"
    if not exists(spark, f"{mark}/_SUCCESS"):
        number = len(folder_names(spark, f"{home}/_runs"))
        spark.range(number, number + 1).coalesce(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(mark).first()["id"]


def score_stream(features: DataFrame, model, anomalies_path: str, checkpoint: str):
    """Score each batch and put its anomalies into the collection; a repeated batch changes nothing.

    Each batch is written to a folder of its run and number, and `read_anomalies` keeps the latest row per key,
    so no batch rewrites what earlier ones stored.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = kb.anomaly_rows(model.transform(batch).filter("is_anomaly"))
        rows.write.mode("overwrite").parquet(f"{anomalies_path}/run={_run(batch.sparkSession, anomalies_path, checkpoint)}/batch={number}")

    return (
        features.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_anomalies(spark: SparkSession, anomalies_path: str) -> DataFrame:
    rows = spark.read.parquet(anomalies_path)
    return kb._latest(rows, "log_id", ["run", "batch"])
