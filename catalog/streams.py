"""Streaming queries: replayed over the given tables, they must equal the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import BURST_SQL, DELTA_SQL, EVENT_LOGS, VOLATILITY_SQL, event_lines, event_logs
from logloom.functions.text import numeric_params
from logloom.session import scratch_path
from logloom.streaming import ingest, state


def _instalments(spark, folder, home, run):
    """The dense event logs arrive in two instalments, in time order; after each, the streams run
    until nothing is left and stop. The second run takes up the state the first one left."""
    logs = event_logs(spark, folder).select(
        "template_id", "service", "timestamp", "source_file", "line_number", numeric_params(F.col("dynamic_params")).alias("numbers")
    )
    for part in ("timestamp < timestamp'2024-01-01 00:43:00'", "timestamp >= timestamp'2024-01-01 00:43:00'"):
        logs.filter(part).write.mode("append").parquet(f"{home}/in")
        run(spark.readStream.schema(logs.schema).parquet(f"{home}/in"))


@query(
    "stream_features_replay",
    f"""WITH {EVENT_LOGS}, {BURST_SQL}, {DELTA_SQL}, {VOLATILITY_SQL}
SELECT line_number, burstiness, volatility, time_delta FROM lg JOIN bu USING (event_id) JOIN de USING (event_id) JOIN vo USING (event_id)""",
)
def stream_features_replay(spark, folder):
    home = scratch_path(spark, "stream")

    def run(events):
        state.replay(state.template_state(events, "1 day"), f"{home}/t", f"{home}/ct")
        state.replay(state.service_state(events, "1 day"), f"{home}/s", f"{home}/cs")

    _instalments(spark, folder, home, run)
    templates, services = spark.read.parquet(f"{home}/t"), spark.read.parquet(f"{home}/s")
    return templates.join(services, ["source_file", "line_number"]).select("line_number", "burstiness", "volatility", "time_delta")


@query(
    "stream_window_counts",
    f"""WITH {EVENT_LOGS}, w AS (SELECT template_id, unnest([sec // 5 * 5, sec // 5 * 5 - 5]) AS start FROM lg),
c AS (SELECT template_id, start, count(*) AS n FROM w GROUP BY ALL)
SELECT template_id, start AS window_start, n FROM c""",
)
def stream_window_counts(spark, folder):
    home = scratch_path(spark, "stream")
    _instalments(
        spark, folder, home, lambda events: state.replay_counts(state.coarse_counts(events, "5 seconds", "1 minute"), f"{home}/w", f"{home}/cw")
    )
    return state.read_counts(spark, f"{home}/w").select("template_id", F.unix_seconds("window_start").alias("window_start"), "n")


@query(
    "stream_templates",
    """SELECT 'E' || row_number() OVER (ORDER BY min(event_id)) AS template_id, event_type || ' of svc <*> took <DURATION> k <*>' AS template_str,
  count(*) AS n, count(*) AS n_rows, count(*) AS n_ids FROM events GROUP BY event_type""",
)
def stream_templates(spark, folder):
    """Event lines arrive in two instalments; the second batch goes on from the first one's templates."""
    home = scratch_path(spark, "arrivals")
    lines = event_lines(spark, folder)
    words = F.concat(F.substring("line", 1, 26), F.lit(" INFO "), "event_type", F.lit(" of svc_"), "user_id", F.lit(" took "), "value", F.lit(" ms k="), "k")
    for part in ("ts < timestamp'2024-01-20'", "ts >= timestamp'2024-01-20'"):
        lines.filter(part).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(words).write.mode("append").text(f"{home}/in")
        ingest.ingest_stream(ingest.numbered_stream(spark, f"{home}/in", "*.txt"), home, f"{home}/check").awaitTermination()
    rows, templates = ingest.read_ingested(spark, home)
    held = rows.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("log_id").alias("n_ids"))
    return templates.join(held, "template_id").select("template_id", "template_str", "n", "n_rows", "n_ids")


@query(
    "stream_ingest",
    f"""WITH {EVENT_LOGS} SELECT raw_line, level, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time_text, template_id || ' took ' || value || ' ms k=' || CAST(CAST(kd AS BIGINT) AS VARCHAR) AS tail FROM lg""",
)
def stream_ingest(spark, folder):
    """Files arrive in two instalments; the second run of the same stream takes up where the first ended."""
    home = scratch_path(spark, "arrivals")
    lines = event_lines(spark, folder)
    for part in ("ts < timestamp'2024-01-20'", "ts >= timestamp'2024-01-20'"):
        lines.filter(part).select("line").write.mode("append").text(f"{home}/in")
        stream = ingest.parsed_stream(spark, f"{home}/in", "*.txt", 4)
        ingest.append_stream(stream, f"{home}/out", f"{home}/check").awaitTermination()
    return spark.read.parquet(f"{home}/out").select(
        "raw_line", "level", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_text"),
        F.regexp_replace("message", r"^svc_\d+ ", "").alias("tail"),
    )
