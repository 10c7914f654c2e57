"""Log views derived from the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import table
from logloom.functions.scalars import http_flags
from logloom.operators.parse import with_row_ids

# Times of the dense view: 500 times faster and cut to whole seconds, so instants have ties.
DENSE = 500


def timed_events(spark, folder, deal=True):
    return table(spark, folder, "events", deal).withColumn("ts", F.col("ts").cast("timestamp"))


def _level():
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")


def event_lines(spark, folder, deal=True):
    """events as log lines: (source_file, line_number, line) plus the event's own columns."""
    k = F.get_json_object("props", "$.k")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), _level(), F.lit(" svc_"), F.col("user_id"),
        F.lit(" "), F.col("event_type"), F.lit(" took "), F.col("value"), F.lit(" ms k="), k,
    )
    return (
        timed_events(spark, folder, deal)
        .withColumn("source_file", F.lit("events"))
        .withColumn("line_number", F.col("event_id") + 1)
        .withColumn("k", k)
        .withColumn("line", line)
    )


EVENT_LINES = """
ev AS (
  SELECT *, 'events' AS source_file, event_id + 1 AS line_number, json_extract_string(props, '$.k') AS k,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level
  FROM events),
el AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || level || ' svc_' || user_id || ' ' || event_type
         || ' took ' || value || ' ms k=' || k AS line FROM ev)
"""


def event_logs(spark, folder, dense: bool = True, deal: bool = False):
    """events as rows of the log table; the template is the event type, the service the user."""
    us = F.unix_micros("ts")
    start = F.lit(1_704_067_200_000_000)  # 2024-01-01
    moment = (
        F.timestamp_seconds(F.floor((us - start) / F.lit(DENSE * 1_000_000)) + F.lit(1_704_067_200)) if dense else F.col("ts")
    )
    status = (F.lit(100) + F.lit(100) * F.pmod(F.col("k").cast("int"), F.lit(5)) + 4).cast("int")
    rows = event_lines(spark, folder, deal).select(
        "source_file", "line_number", F.col("line").alias("raw_line"), moment.alias("timestamp"), _level().alias("level"),
        F.concat(F.lit("svc_"), "user_id").alias("service"), F.col("event_type").alias("template_id"),
        F.concat(F.lit("svc <*> "), "event_type", F.lit(" took <DURATION> k <*>")).alias("template_str"),
        F.array(F.col("value").cast("string"), F.concat(F.lit("host-"), "k")).alias("dynamic_params"),
        status.alias("http_status"), F.col("value").alias("value"), "event_id",
    )
    return with_row_ids(rows).withColumns(http_flags(F.col("http_status")))


EVENT_LOGS = EVENT_LINES + """,
lg AS (
  SELECT substr(sha1('events:' || line_number), 1, 16) AS log_id, source_file, line_number, line AS raw_line,
         1704067200 + CAST(floor((epoch_us(ts) - 1704067200000000) / 500000000) AS BIGINT) AS sec,
         level, 'svc_' || user_id AS service, event_type AS template_id,
         'svc <*> ' || event_type || ' took <DURATION> k <*>' AS template_str,
         104 + 100 * (CAST(k AS INT) % 5) AS http_status, value, CAST(k AS DOUBLE) AS kd, event_id, ts
  FROM el)
"""

# Window features over the dense view; numbers per row are the value and minus k ("host-7" reads -7).
BURST_SQL = """
bu AS (
  SELECT event_id,
         count(*) OVER (PARTITION BY template_id ORDER BY sec RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY template_id, sec)
         + row_number() OVER (PARTITION BY template_id, sec ORDER BY line_number) AS burstiness
  FROM lg)
"""
DELTA_SQL = """
de AS (
  SELECT event_id, coalesce(round(least(greatest(CAST(sec - lag(sec) OVER (PARTITION BY service ORDER BY sec, line_number) AS DOUBLE), 0), 86400), 4), 0) AS time_delta
  FROM lg)
"""
VOLATILITY_SQL = """
nums AS (SELECT event_id, template_id, sec, line_number, 1 AS pos, value AS x FROM lg
         UNION ALL SELECT event_id, template_id, sec, line_number, 2, -kd FROM lg),
run AS (SELECT event_id, pos,
          stddev_pop(x) OVER w AS sd, count(x) OVER w AS n
        FROM nums WINDOW w AS (PARTITION BY template_id ORDER BY sec, line_number, pos ROWS UNBOUNDED PRECEDING)),
vo AS (SELECT event_id, CASE WHEN n < 2 THEN 0 ELSE round(sd, 6) END AS volatility FROM run WHERE pos = 2)
"""


def entropy_sql(source: str, key: str, text: str, name: str = "en") -> str:
    return f"""
{name}_c AS (SELECT {key}, ch, count(*) AS c FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {source}) GROUP BY ALL),
{name}_t AS (SELECT {key}, sum(c) AS n, sum(c * log2(c)) AS s FROM {name}_c GROUP BY {key}),
{name} AS (SELECT {key}, CASE WHEN n <= 1 THEN 0.0 ELSE round(greatest(least((log2(n) - s / n) / log2(n), 1.0), 0.0), 6) END AS entropy FROM {name}_t)
"""


def access_view(spark, folder):
    """pages as access-log lines and as the 11 columns of an access-log table."""
    pages = table(spark, folder, "pages")
    stamp = F.timestamp_seconds(F.lit(1_721_277_000) + F.col("page_id") * 7)
    local = F.date_format(stamp, "dd/MMM/yyyy:HH:mm:ss")
    status = (F.lit(100) * (1 + F.col("page_id") % 5) + F.col("page_id") % 7).cast("string")
    rows = pages.select(
        "page_id",
        F.concat(F.lit("10.0."), (F.col("page_id") / 256).cast("int") % 256, F.lit("."), F.col("page_id") % 256).alias("ip"),
        F.lit("-").alias("ident"), F.concat(F.lit("user"), F.col("page_id") % 17).alias("user"),
        F.concat(F.lit("["), local).alias("ts_part"), F.lit("+0530]").alias("zone"),
        F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1")).alias("request"), status.alias("status"),
        F.length("html").cast("string").alias("bytes"), F.lit("-").alias("referrer"), F.lit("Mozilla/5.0 x").alias("user_agent"),
        (F.col("page_id") % 900).cast("string").alias("rt_ms"),
    )
    line = F.format_string(
        '%s %s %s %s %s "%s" %s %s "%s" "%s"', "ip", "ident", "user", "ts_part", "zone", "request", "status", "bytes",
        "referrer", "user_agent",
    )
    return rows.withColumn("line", line).withColumn("source_file", F.lit("pages")).withColumn("line_number", F.col("page_id") + 1)


ACCESS = """
ac AS (
  SELECT page_id, page_id + 1 AS line_number,
    '10.0.' || ((page_id // 256) % 256) || '.' || (page_id % 256) AS ip, 'user' || (page_id % 17) AS usr,
    make_timestamp((1721277000 + page_id * 7) * 1000000) AS stamp, 'GET ' || url || ' HTTP/1.1' AS request, url,
    100 * (1 + page_id % 5) + page_id % 7 AS status, length(html) AS bytes, page_id % 900 AS rt
  FROM pages),
al AS (
  SELECT *, ip || ' - ' || usr || ' [' || strftime(stamp, '%d/%b/%Y:%H:%M:%S') || ' +0530] "' || request || '" ' || status
    || ' ' || bytes || ' "-" "Mozilla/5.0 x"' AS line FROM ac)
"""


def telemetry_view(spark, folder):
    """events as labelled telemetry; views carry no label."""
    severities = F.array(*[F.lit(s) for s in ("Low", "Medium", "High", "Critical", "odd")])
    return event_lines(spark, folder).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("event_id").cast("string").alias("Anomaly_ID"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("Anomaly_Type"),
        F.get(severities, F.pmod(F.col("k").cast("int"), F.lit(5))).alias("Severity"), F.lit("Open").alias("Status"),
        F.concat(F.lit("svc_"), "user_id").alias("Source"), F.lit("10.1.1.1").alias("Host_IP"),
        F.col("value").cast("string").alias("Response_Time_ms"), F.col("k").alias("Error_Code"),
        (F.col("user_id") % 100).cast("string").alias("CPU_Usage_Percent"), F.lit("512").alias("Memory_Usage_MB"),
        F.lit(" 7 ").alias("Disk_Usage_Percent"), F.lit("web").alias("Service_Type"),
    )


TELEMETRY = EVENT_LINES + """,
te AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, event_type AS kind, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS label,
    (['Low', 'Medium', 'High', 'Critical', 'odd'])[1 + CAST(k AS INT) % 5] AS severity, 'svc_' || user_id AS src,
    CAST(value AS VARCHAR) AS resp, k AS err, CAST(user_id % 100 AS VARCHAR) AS cpu, value, CAST(k AS DOUBLE) AS kd
  FROM el)
"""


# --- text vectors and searches as SQL -------------------------------------------------------

def vectors_sql(source: str, key: str, text: str, name: str, dim: int = 384) -> str:
    """{name}_v(key, slot, x): the default text embedding, as non-zero positions scaled to length 1."""
    return f"""
{name}_w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS word FROM {source}),
{name}_d AS (SELECT word, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % {dim} AS slot,
             CASE WHEN CAST(('0x' || substr(md5(word), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sgn
             FROM (SELECT DISTINCT word FROM {name}_w)),
{name}_s AS (SELECT id, slot, CAST(sum(sgn) AS DOUBLE) AS x FROM {name}_w JOIN {name}_d USING (word) GROUP BY ALL HAVING sum(sgn) <> 0),
{name}_n AS (SELECT id, sqrt(sum(x * x)) AS size FROM {name}_s GROUP BY id),
{name}_f AS (SELECT id, slot, CAST(CAST(x / size AS FLOAT) AS DOUBLE) AS x FROM {name}_s JOIN {name}_n USING (id)),
{name}_m AS (SELECT id, sqrt(sum(x * x)) AS size FROM {name}_f GROUP BY id),
{name}_v AS (SELECT id, slot, x / size AS x FROM {name}_f JOIN {name}_m USING (id))
"""


def near_sql(q: str, d: str, queries: str, q_id: str, docs: str, d_id: str, k: int, name: str = "near") -> str:
    """{name}(query_id, item_id, similarity, rank) from two vector relations."""
    return f"""
{name}_p AS (SELECT a.id AS query_id, b.id AS item_id, sum(a.x * b.x) AS s FROM {q}_v a JOIN {d}_v b USING (slot) GROUP BY ALL),
{name}_a AS (SELECT {queries}.{q_id} AS query_id, {docs}.{d_id} AS item_id FROM {queries}, {docs}),
{name}_r AS (SELECT query_id, item_id, round(coalesce(s, 0), 6) AS similarity FROM {name}_a LEFT JOIN {name}_p USING (query_id, item_id)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM {name}_r
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= {k})
"""


def bm25_sql(queries: str, q_id: str, q_text: str, docs: str, d_id: str, d_text: str, k: int, name: str = "bm") -> str:
    """{name}(query_id, doc_id, score, rank)."""
    return f"""
{name}_t AS (SELECT {d_id} AS doc_id, regexp_extract_all(lower({d_text}), '[a-z0-9]+') AS ws FROM {docs}),
{name}_o AS (SELECT count(*) AS n, greatest(avg(len(ws)), 1) AS al FROM {name}_t),
{name}_p AS (SELECT doc_id, w, count(*) AS tf, dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM {name}_t) GROUP BY ALL),
{name}_i AS (SELECT w, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM {name}_p, {name}_o GROUP BY w, n),
{name}_q AS (SELECT {q_id} AS query_id, unnest(regexp_extract_all(lower({q_text}), '[a-z0-9]+')) AS w FROM {queries}),
{name}_g AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS s
             FROM {name}_q JOIN {name}_i USING (w) JOIN {name}_p USING (w), {name}_o GROUP BY ALL),
{name}_a AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM {name}_q), (SELECT doc_id FROM {name}_t)),
{name}_r AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS score FROM {name}_a LEFT JOIN {name}_g USING (query_id, doc_id)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_r
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})
"""


def hybrid_sql(near: str, words: str, k: int, name: str = "hy") -> str:
    """{name}(query_id, item_id, hybrid_score, rank)."""
    return f"""
{name}_b AS (SELECT query_id, doc_id AS item_id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY query_id) END AS ks FROM {words}),
{name}_r AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id,
             round(0.7 * coalesce(similarity, 0) + 0.3 * coalesce(ks, 0), 4) AS hybrid_score
             FROM {near} a FULL JOIN {name}_b b ON a.query_id = b.query_id AND a.item_id = b.item_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, item_id) AS rank FROM {name}_r
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, item_id) <= {k})
"""
