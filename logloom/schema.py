"""Column layouts of the log table and the knowledge base."""

from pyspark.sql import types as T

LOG_COLUMNS = [
    ("log_id", T.StringType()),
    ("line_number", T.LongType()),
    ("source_path", T.StringType()),
    ("source_file", T.StringType()),
    ("raw_line", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("level", T.StringType()),
    ("service", T.StringType()),
    ("template_id", T.StringType()),
    ("template_str", T.StringType()),
    ("dynamic_params", T.ArrayType(T.StringType())),
    ("http_status", T.IntegerType()),
    ("http_1xx", T.BooleanType()),
    ("http_2xx", T.BooleanType()),
    ("http_3xx", T.BooleanType()),
    ("http_4xx", T.BooleanType()),
    ("http_5xx", T.BooleanType()),
    ("ingested_at", T.TimestampType()),
]
LOG_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in LOG_COLUMNS])

HTTP_FLAGS = ["http_1xx", "http_2xx", "http_3xx", "http_4xx", "http_5xx"]

# The columns a feature scan reads, in the order it hands them out.
FEATURE_SCAN = [
    "log_id", "timestamp", "level", "service", "template_id", "template_str",
    "dynamic_params", "raw_line", "http_status", *HTTP_FLAGS,
]

ACCESS_CSV = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ip", "ident", "user", "ts_part", "zone", "request", "status", "bytes",
            "referrer", "user_agent", "rt_ms",
        )
    ]
)

TEMPLATE_METRICS = [
    "frequency", "avg_entropy", "avg_burstiness", "avg_volatility", "avg_time_delta", "error_rate",
]

UNLABELLED = "unlabelled"


def source_of(columns: list[str]) -> str:
    """The column that tells sources apart: the full path; the name only where rows came from no file."""
    return "source_path" if "source_path" in columns else "source_file"
