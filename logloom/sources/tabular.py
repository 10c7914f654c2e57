"""Tables of any shape -> log lines, with status and service kept as columns."""

from __future__ import annotations

import csv
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.scalars import (
    http_flags, or_default, severity_level, status_level, tolerant_double, trim_all,
)
from logloom.functions.text import cap
from logloom.schema import ACCESS_CSV
from logloom.sources.text_lines import format_of, list_inputs, numbered, position, read_lines

# Column names that hold the time, the level and the service.
TIME_NAMES = ["timestamp", "time", "datetime", "date", "ts", "created_at", "event_time"]
LEVEL_NAMES = ["level", "severity", "log_level", "loglevel", "priority"]
SERVICE_NAMES = ["service", "source", "host", "component", "module", "logger"]
SHEET_TIME_NAMES = ["timestamp", "time", "datetime", "date", "ts", "created_at"]
SHEET_LEVEL_NAMES = ["level", "severity", "log_level", "priority"]
SEPARATORS = [",", ";", "\t", "|"]
EMPTY_VALUES = ["", "-", "nan", "None"]
TELEMETRY_LABEL = "Anomaly_Type"
ROUTED = ["source_path", "source_file", "line_number", "line", "http_status", "service"]


def access_lines(rows: DataFrame) -> DataFrame:
    """Access-log table (11 text columns) -> `time LEVEL user METHOD path status= bytes= rt=`."""
    c = lambda name: trim_all(F.coalesce(F.col(name).cast("string"), F.lit("nan")))
    stamp = F.concat_ws(" ", c("ts_part"), c("zone"))
    # The wall clock of the line's own zone is what the line shows.
    local = F.try_to_timestamp(
        F.regexp_extract(stamp, r"^\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}) [+-]\d{4}\]$", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")
    )
    status = c("status").try_cast("int")
    request = F.filter(F.split(c("request"), r"\s+"), lambda p: p != "")
    rt = trim_all(F.coalesce(F.col("rt_ms").cast("string"), F.lit("0")))
    line = F.concat_ws(
        " ",
        F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), stamp),
        status_level(status),
        c("user"),
        F.coalesce(F.get(request, F.lit(0)), F.lit("UNKNOWN")),
        F.coalesce(F.get(request, F.lit(1)), F.lit("/")),
        F.concat(F.lit("status="), c("status")),
        F.concat(F.lit("bytes="), c("bytes")),
        F.concat(F.lit("rt="), rt, F.lit("ms")),
    )
    return rows.withColumn("line", line).withColumn("http_status", status).withColumn("service", c("user"))


def telemetry_lines(rows: DataFrame) -> DataFrame:
    """Telemetry table -> `time LEVEL source key=value ...`; an absent column takes its default."""
    def field(name: str, default: str) -> Column:
        if name not in rows.columns:
            return F.lit(default)
        return trim_all(F.coalesce(F.col(name).cast("string"), F.lit("")))

    line = F.format_string(
        "%s %s %s anomaly_type=%s status=%s host=%s error_code=%s rt=%sms cpu=%s%% mem=%sMB disk=%s%% svc=%s id=%s",
        field("Timestamp", ""), severity_level(field("Severity", "Low")), field("Source", "unknown"),
        field(TELEMETRY_LABEL, "Unknown"), field("Status", "Open"), field("Host_IP", ""),
        field("Error_Code", "0"), field("Response_Time_ms", "0"), field("CPU_Usage_Percent", "0"),
        field("Memory_Usage_MB", "0"), field("Disk_Usage_Percent", "0"), field("Service_Type", ""),
        field("Anomaly_ID", ""),
    )
    return rows.withColumn("line", line)


def _pick(columns: list[str], names: list[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() in names), None)


def _flatten(rows: DataFrame, times, levels, services, default_service: str, render) -> DataFrame:
    time_col, level_col, service_col = (_pick(rows.columns, n) for n in (times, levels, services))
    text = lambda name: trim_all(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
    rest = [c for c in rows.columns if c not in (time_col, level_col, service_col, "_at")]
    parts = [F.when(~text(c).isin(EMPTY_VALUES), render(c, text(c))) for c in rest]
    line = F.concat(
        text(time_col) if time_col else F.lit(""), F.lit(" "),
        text(level_col) if level_col else F.lit("INFO"), F.lit(" "),
        text(service_col) if service_col else F.lit(default_service), F.lit(" "),
        F.concat_ws(" ", *parts) if parts else F.lit(""),
    )
    return rows.withColumn("line", line)


def row_lines(rows: DataFrame, value_cap: int | None = None) -> DataFrame:
    """Rows of unknown shape -> `time LEVEL service column=value ...`.

    The first column with a known name is the time, level or service; empty values are left out.
    """
    render = lambda name, v: F.concat(F.lit(f"{name}="), cap(v, value_cap))
    return _flatten(rows, TIME_NAMES, LEVEL_NAMES, SERVICE_NAMES, "unknown", render)


def sheet_lines(sheets: dict[str, DataFrame], value_cap: int | None = None) -> DataFrame:
    """Named tables -> one table (sheet, line); the sheet's name is the default service."""
    out = None
    for name, rows in sheets.items():
        render = lambda col, v: cap(v, value_cap) if "=" in col else F.concat(F.lit(f"{col}="), cap(v, value_cap))
        flat = _flatten(
            rows, SHEET_TIME_NAMES, SHEET_LEVEL_NAMES, SERVICE_NAMES, f"excel_{name}", render
        ).select(F.lit(name).alias("sheet"), "line")
        out = flat if out is None else out.unionByName(flat)
    return out


def page_lines(pages: DataFrame, text: str = "text", page: str = "page", line_cap: int | None = None) -> DataFrame:
    """One row per non-blank text line of a page: `pdf_page=N INFO pdf_source <line>`."""
    split = pages.select("*", F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("_pos", "_text"))
    body = trim_all(F.col("_text"))
    return (
        split.filter(body != "")
        .withColumn("line", F.format_string("pdf_page=%d INFO pdf_source %s", F.col(page), cap(body, line_cap)))
        .withColumn("line_in_page", F.col("_pos") + 1)
        .drop("_pos", "_text")
    )


def cell_lines(table_rows: DataFrame, cells: str = "cells", page: str = "page", line_cap: int | None = None) -> DataFrame:
    """One row per table row with any cell: `pdf_page=N INFO pdf_table a | b`."""
    kept = F.filter(F.transform(F.col(cells), lambda c: trim_all(c)), lambda c: c.isNotNull() & (c != ""))
    joined = F.array_join(kept, " | ")
    return table_rows.filter(F.size(kept) > 0).withColumn(
        "line", F.format_string("pdf_page=%d INFO pdf_table %s", F.col(page), cap(joined, line_cap))
    )


def csv_heads(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, bool]]:
    """(path, first line, whether a line has an odd number of quotes) of every file, in one job.

    Such a line starts or ends a cell that holds a line break. The result has one row per file.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    heads = lines.groupBy("path").agg(
        F.min_by(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("row"))).alias("head"),
        F.max(odd % 2 == 1).alias("broken"),
    )
    return [(r["path"], r["head"] or "", r["broken"]) for r in heads.orderBy("path").collect()]


def separator_of(path: str, head: str) -> str:
    """Tab for `.tsv`, else the separator that cuts the first line into most cells; comma if none does."""
    if path.lower().endswith(".tsv"):
        return "\t"
    return max(SEPARATORS, key=lambda s: len(_cells(head, s)))


def _cells(head: str, separator: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([head], delimiter=separator), [])]


def csv_dialect(head: str, separator: str = ",") -> str:
    """`access` if the first cell is an IPv4 address, `telemetry` by its label column, else `generic`."""
    cells = _cells(head, separator) or [""]
    numbers = cells[0].split(".")
    if len(numbers) == 4 and all(n.isdigit() for n in numbers):
        return "access"
    return "telemetry" if TELEMETRY_LABEL in cells else "generic"


def read_csv_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files of any dialect -> (source_path, source_file, line_number, line, http_status, service).

    Quotes inside quoted cells are doubled. Files with the same dialect and header are read together, so
    the plan grows with the number of layouts, not of files. Only files whose cells hold line breaks
    are read unsplit; there `line_number` counts records.
    """
    paths = [paths] if isinstance(paths, str) else paths
    layouts: dict[tuple, list[str]] = {}
    for path, head, broken in csv_heads(spark, paths):
        separator = separator_of(path, head)
        dialect = csv_dialect(head, separator)
        layouts.setdefault((dialect, separator, "" if dialect == "access" else head, broken), []).append(path)
    out = None
    for (dialect, separator, _, broken), group in layouts.items():
        reader = spark.read.option("sep", separator).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", broken)
        if dialect == "access":
            rows = access_lines(reader.schema(ACCESS_CSV).csv(group).select("*", position()))
        else:
            plain = reader.csv(group, header=True)
            service = "Source" if dialect == "telemetry" else _pick(plain.columns, SERVICE_NAMES)
            shown = telemetry_lines if dialect == "telemetry" else row_lines
            rows = shown(plain.select("*", position()))
            rows = rows.withColumn("service", trim_all(F.col(f"`{service}`")) if service else F.lit(None).cast("string"))
        if "http_status" not in rows.columns:
            rows = rows.withColumn("http_status", F.lit(None).cast("int"))
        part = numbered(
            rows.select(
                "_at", "line", F.col("http_status").cast("int").alias("http_status"),
                or_default(F.col("service"), "unknown").alias("service"),
            )
        ).select(*ROUTED)
        out = part if out is None else out.unionByName(part)
    return out


def route(spark: SparkSession, path: str) -> DataFrame:
    """Any supported input -> (source_path, source_file, line_number, line, http_status, service), no intermediate file.

    Workbooks and paged documents come in as tables (`sheet_lines`, `page_lines`): their
    binary decoding is not part of this package.
    """
    kind = format_of(path)
    if kind == "csv":
        return read_csv_lines(spark, path)
    if kind in ("excel", "pdf"):
        raise ValueError(f"decode {path} to tables first, then use sheet_lines or page_lines")
    return _plain_lines(spark, path)


def _plain_lines(spark: SparkSession, paths) -> DataFrame:
    return read_lines(spark, paths).select(
        "source_path", "source_file", "line_number", "line", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("service")
    )


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def route_folder(spark: SparkSession, folder: str) -> DataFrame | None:
    """All text and CSV inputs directly in a folder; `_` names are no inputs. Workbooks and paged
    documents are named in a warning: they come in as tables."""
    # File names only, one row per file.
    files = list_inputs(spark, folder).orderBy("path").collect()
    skipped = [r["path"] for r in files if r["kind"] not in ("csv", "log")]
    if skipped:
        warnings.warn(f"decode these to tables first: {', '.join(skipped)}")
    logs = [r["path"] for r in files if r["kind"] == "log"]
    tables = [r["path"] for r in files if r["kind"] == "csv"]
    out = _plain_lines(spark, logs) if logs else None
    if tables:
        part = read_csv_lines(spark, tables)
        out = part if out is None else out.unionByName(part)
    return out


def labelled_records(rows: DataFrame, text_cap: int | None = None) -> DataFrame:
    """Labelled telemetry -> knowledge-base records; rows without a label fall out."""
    f = lambda name, default: trim_all(F.coalesce(F.col(name).cast("string"), F.lit(default)))
    severity = F.lower(f("Severity", ""))
    text = F.format_string(
        "%s anomaly on %s service. Severity=%s. ErrorCode=%s. ResponseTime=%sms. "
        "CPU=%s%% Memory=%sMB Disk=%s%% ServiceType=%s",
        f(TELEMETRY_LABEL, ""), f("Source", ""), severity, f("Error_Code", ""), f("Response_Time_ms", ""),
        f("CPU_Usage_Percent", ""), f("Memory_Usage_MB", ""), f("Disk_Usage_Percent", ""), f("Service_Type", ""),
    )
    failed = severity.isin("high", "critical") & (tolerant_double(F.col("Error_Code").cast("string")) > 0)
    return rows.filter(f(TELEMETRY_LABEL, "") != "").select(
        F.concat(F.lit("ANOMALY_"), f("Anomaly_ID", "")).alias("template_id"),
        cap(text, text_cap).alias("template_str"),
        F.lit(1).cast("long").alias("frequency"),
        F.lit(0.0).alias("avg_entropy"),
        F.lit(0.0).alias("avg_burstiness"),
        tolerant_double(F.col("Response_Time_ms").cast("string")).alias("avg_volatility"),
        F.lit(0.0).alias("avg_time_delta"),
        F.when(failed, 1.0).otherwise(0.0).alias("error_rate"),
        F.lit(False).alias("is_golden"),
        f(TELEMETRY_LABEL, "").alias("label"),
    )


def attach_status(parsed: DataFrame) -> DataFrame:
    """Let the router's own status and service columns win over what the text shows."""
    status = F.coalesce("routed_status", "http_status")
    return (
        parsed.withColumn("http_status", status)
        .withColumn("service", F.coalesce("routed_service", "service"))
        .withColumns(http_flags(F.col("http_status")))
        .drop("routed_status", "routed_service")
    )
