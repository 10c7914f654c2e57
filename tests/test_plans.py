"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import bm25, knn, stats
from logloom.operators.parse import parse_lines, with_row_ids
from logloom.session import fits
from logloom.sources import log_table


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "logs")
    lines = spark.createDataFrame([("f", i, f"2024-01-01 00:00:0{i} INFO text {i}") for i in range(9)], "source_file string, line_number long, line string")
    rows = with_row_ids(parse_lines(lines)).withColumn("template_id", F.lit("E1")).withColumn("template_str", F.lit("text <*>")).withColumn(
        "dynamic_params", F.array(F.lit("1"))
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_columns_are_pruned_and_filters_pushed(table):
    text = plan(stats.template_statistics(table))
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "raw_line" not in schema and "message" not in schema and "template_id" in schema
    text = plan(log_table.feature_scan(log_table.of_source(table, "f"), "http_status >= 200"))
    assert "EqualTo(source_file,f)" in text and "GreaterThanOrEqual(http_status,200)" in text


def test_no_pair_joins(spark, table):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], f"w{i}") for i in range(5)], "id long, embedding array<double>, text string")
    for df in (
        knn.nearest(vectors, vectors, 2, "id", "id"), knn.nearest(vectors, vectors, 2, "id", "id", broadcast_floats=0),
        bm25.search(vectors, vectors, 2, "id", "id"),
    ):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_aggregates_combine_before_the_shuffle(table):
    text = plan(stats.template_statistics(table))
    assert "partial_count" in text


def test_small_side_is_checked_by_rows_and_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, b"k", [1, 2]), (None, None, None)], "a string, b binary, c array<int>")
    assert fits(rows) and fits(rows.limit(0)) and not fits(rows, max_rows=1) and not fits(rows, max_bytes=1000)
