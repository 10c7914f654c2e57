"""Log lines -> typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.scalars import http_flags, parse_timestamp, row_id, trim_all
from logloom.functions.text import cap
from logloom.schema import source_of

# The four line shapes in the order they are tried, and their groups. Longer
# level names come first, a time may carry a zone, and a syslog tag may carry its process id.
LEVELS = "DEBUG|INFO|WARNING|WARN|ERROR|FATAL|CRITICAL|TRACE"
ACCESS = r'(\S+) \S+ \S+ \[([^\]]+)\] "(\S+)? (\S+)? \S+?" (\d{3}) (\S+)'
SYSLOG = r"(\w{3}\s+\d+\s+\d+:\d+:\d+) (\S+) (\S+?)(?:\[(\d+)\])?: (.+)"
LOG4J = (
    r"(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}[,\.]\d+)\s+"
    r"(DEBUG|INFO|WARN|ERROR|FATAL|TRACE)\s+(\S+)\s+-\s+(.+)"
)
GENERIC = (
    r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\.,]?\d*(?:Z|[+-]\d{2}:?\d{2})?)\s*"
    rf"({LEVELS})?\s*(.+)"
)
_MARK = "\u0001"


def _groups(line: Column, pattern: str, count: int) -> Column:
    """All groups of the first hit in one pass: [marker, group 1, ...]; one element if no hit."""
    slots = _MARK + _MARK.join(f"${i}" for i in range(1, count + 1)) + _MARK
    clean = F.translate(line, _MARK, "\ufffd")
    return F.split(F.regexp_replace(clean, rf"(?d)^.*?{pattern}(?s:.*)$", slots), _MARK)


def parse_lines(lines: DataFrame, line: str = "line", year: int = 1900, raw_cap: int | None = None) -> DataFrame:
    """Adds raw_line, timestamp, level, service, http_status, the status flags and message.

    The first shape that matches decides. Unmatched optional groups stay NULL; a line of no
    known shape is its own message with everything else NULL. Blank lines are dropped.
    """
    text = F.col("_line")
    staged = (
        lines.withColumn("_line", trim_all(F.col(line)))
        .filter(F.col("_line") != "")
        .withColumn(
            "_shape",
            # A plain search for what a shape must contain spares most lines its costly pattern.
            F.when(text.contains('] "') & text.rlike("(?d)" + ACCESS), "access")
            .when(text.contains(": ") & text.rlike("(?d)" + SYSLOG), "syslog")
            .when(text.rlike("(?d)" + LOG4J), "log4j")
            .when(text.rlike("(?d)" + GENERIC), "generic"),
        )
        .withColumn(
            "_g",
            F.when(F.col("_shape") == "access", _groups(text, ACCESS, 6))
            .when(F.col("_shape") == "syslog", _groups(text, SYSLOG, 5))
            .when(F.col("_shape") == "log4j", _groups(text, LOG4J, 4))
            .when(F.col("_shape") == "generic", _groups(text, GENERIC, 3)),
        )
    )
    shape, group = F.col("_shape"), lambda i: F.nullif(F.get("_g", i), F.lit(""))
    time_text = F.when(shape == "access", group(2)).otherwise(group(1))
    parsed = (
        staged.withColumn("raw_line", cap(text, raw_cap))
        .withColumn("timestamp", parse_timestamp(time_text, year))
        .withColumn(
            "level",
            F.when(shape.isin("access", "syslog"), F.lit("UNKNOWN")).when(
                shape.isin("log4j", "generic"), group(2)
            ),
        )
        .withColumn(
            "service",
            F.when(shape.isin("syslog", "log4j"), group(3)).when(shape.isNotNull(), F.lit("unknown")),
        )
        .withColumn("http_status", F.when(shape == "access", group(5).cast("int")))
        .withColumn(
            "message",
            F.when(shape == "syslog", group(5))
            .when(shape == "log4j", group(4))
            .when(shape == "generic", group(3))
            .otherwise(text),
        )
    )
    return parsed.withColumns(http_flags(F.col("http_status"))).drop("_line", "_shape", "_g")


def with_row_ids(df: DataFrame) -> DataFrame:
    """A row is known by its full path and line: two files of one name keep all their lines."""
    return df.withColumn("log_id", row_id(F.col(source_of(df.columns)), F.col("line_number")))
