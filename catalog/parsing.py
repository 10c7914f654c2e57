"""Queries over sources, parsing and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from catalog.views import (
    ACCESS, EVENT_LINES, EVENT_LOGS, TELEMETRY, access_view, entropy_sql, event_lines, event_logs, telemetry_view,
)
from logloom.functions import scalars, text
from logloom.operators import templates
from logloom.operators.parse import parse_lines, with_row_ids
from logloom.session import cut, scratch_path, stored
from logloom.sources import log_table, tabular, text_lines

PARSED = [
    "log_id", "line_number", "level", "service", "http_status", "message", "http_1xx", "http_2xx", "http_3xx",
    "http_4xx", "http_5xx",
]


def _shown(parsed):
    return parsed.select(*PARSED, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_text"))


FLAGS = ", ".join(
    f"coalesce(http_status BETWEEN {k}00 AND {k}99, false) AS http_{k}xx" for k in range(1, 6)
)


@query(
    "log_parse_generic",
    f"""WITH {EVENT_LINES},
g AS (SELECT line_number, regexp_extract(line, '(\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}[\\.,]?\\d*(?:Z|[+-]\\d{{2}}:?\\d{{2}})?)\\s*(DEBUG|INFO|WARNING|WARN|ERROR|FATAL|CRITICAL|TRACE)?\\s*(.+)', ['t', 'l', 'm']) AS g FROM el),
p AS (SELECT substr(sha1('events:' || line_number), 1, 16) AS log_id, line_number, nullif(g.l, '') AS level, 'unknown' AS service,
      CAST(NULL AS INT) AS http_status, g.m AS message, strftime(TRY_CAST(g.t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS time_text FROM g)
SELECT *, {FLAGS} FROM p""",
)
def log_parse_generic(spark, folder):
    return _shown(with_row_ids(parse_lines(event_lines(spark, folder))))


@query(
    "log_parse_access",
    f"""WITH {ACCESS},
g AS (SELECT line_number, line, regexp_extract(line, '(\\S+) \\S+ \\S+ \\[([^\\]]+)\\] "(\\S+)? (\\S+)? \\S+?" (\\d{{3}}) (\\S+)', ['ip', 't', 'me', 'pa', 's', 'b']) AS g FROM al),
p AS (SELECT substr(sha1('pages:' || line_number), 1, 16) AS log_id, line_number, 'UNKNOWN' AS level, 'unknown' AS service,
      CAST(g.s AS INT) AS http_status, line AS message,
      strftime(strptime(substr(g.t, 1, 20), '%d/%b/%Y:%H:%M:%S') - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS time_text FROM g)
SELECT *, {FLAGS} FROM p""",
)
def log_parse_access(spark, folder):
    return _shown(with_row_ids(parse_lines(access_view(spark, folder))))


@query(
    "log_parse_syslog",
    f"""WITH {EVENT_LINES},
p AS (SELECT substr(sha1('events:' || line_number), 1, 16) AS log_id, line_number, 'UNKNOWN' AS level, 'app' || (user_id % 7) AS service,
      CAST(NULL AS INT) AS http_status, event_type || ' value=' || value AS message,
      strftime(ts, '1900-%m-%d %H:%M:%S.000000') AS time_text FROM el)
SELECT *, {FLAGS} FROM p""",
)
def log_parse_syslog(spark, folder):
    lines = event_lines(spark, folder).withColumn(
        "line",
        F.concat(
            F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host_"), "user_id", F.lit(" app"), F.col("user_id") % 7,
            F.lit("["), F.col("event_id"), F.lit("]: "), F.col("event_type"), F.lit(" value="), F.col("value"),
        ),
    )
    return _shown(with_row_ids(parse_lines(lines)))


@query(
    "log_parse_log4j",
    f"""WITH {EVENT_LINES},
p AS (SELECT substr(sha1('events:' || line_number), 1, 16) AS log_id, line_number, level, 'com.app.S' || user_id AS service,
      CAST(NULL AS INT) AS http_status, event_type || ' - took ' || value AS message,
      strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS time_text FROM el)
SELECT *, {FLAGS} FROM p""",
)
def log_parse_log4j(spark, folder):
    events = event_lines(spark, folder)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    lines = events.withColumn(
        "line",
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), level, F.lit(" com.app.S"), "user_id",
            F.lit(" - "), "event_type", F.lit(" - took "), "value",
        ),
    )
    return _shown(with_row_ids(parse_lines(lines)))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _part(name: str, value: str) -> str:
    v = _TRIM.format(f"coalesce(CAST({value} AS VARCHAR), '')")
    return f"CASE WHEN {v} NOT IN ('', '-', 'nan', 'None') THEN '{name}=' || {v} END"


@query(
    "log_route_rows",
    f"""SELECT 'orders' AS source, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority || ' unknown ' ||
  concat_ws(' ', {_part('o_orderkey', 'o_orderkey')}, {_part('o_custkey', 'o_custkey')}, {_part('o_orderstatus', 'o_orderstatus')}, {_part('o_totalprice', 'o_totalprice')}) AS line FROM orders
UNION ALL SELECT 'documents', doc_id, ' INFO ' || {_TRIM.format('source')} || ' ' ||
  concat_ws(' ', {_part('doc_id', 'doc_id')}, {_part('text', 'text')}, {_part('lang', 'lang')}, {_part('n_chars', 'n_chars')}) FROM documents""",
)
def log_route_rows(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.col("o_orderpriority").alias("Priority"),
    )
    first = tabular.row_lines(orders).select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), "line")
    second = tabular.row_lines(table(spark, folder, "documents")).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "line"
    )
    return first.unionByName(second)


@query(
    "log_route_sheets",
    """SELECT 'customer' AS sheet, ' INFO excel_customer c_custkey=' || c_custkey || ' c_name=' || c_name || ' c_nationkey=' || c_nationkey || ' c_acctbal=' || c_acctbal || ' c_mktsegment=' || c_mktsegment AS line FROM customer
UNION ALL SELECT 'supplier', ' INFO ' || s_name || ' s_suppkey=' || s_suppkey || ' s_nationkey=' || s_nationkey || ' s_acctbal=' || s_acctbal FROM supplier""",
)
def log_route_sheets(spark, folder):
    supplier = table(spark, folder, "supplier").withColumnRenamed("s_name", " Host ")
    return tabular.sheet_lines({"customer": table(spark, folder, "customer"), "supplier": supplier})


@query(
    "log_route_access",
    f"""WITH {ACCESS}
SELECT page_id, strftime(stamp, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN status < 400 THEN 'INFO' WHEN status < 500 THEN 'WARN' ELSE 'ERROR' END
  || ' ' || usr || ' GET ' || coalesce(nullif(regexp_extract(request, '^\\S+\\s+(\\S+)', 1), ''), '/') || ' status=' || status || ' bytes=' || bytes || ' rt=' || rt || 'ms' AS line,
  CAST(status AS INT) AS http_status, usr AS service FROM ac""",
)
def log_route_access(spark, folder):
    rows = access_view(spark, folder).drop("line")
    return tabular.access_lines(rows).select("page_id", "line", "http_status", "service")


_SEVERITY = "CASE lower(severity) WHEN 'low' THEN 'INFO' WHEN 'medium' THEN 'WARN' WHEN 'high' THEN 'ERROR' WHEN 'critical' THEN 'FATAL' ELSE 'INFO' END"


@query(
    "log_route_telemetry",
    f"""WITH {TELEMETRY}
SELECT event_id, t || ' ' || {_SEVERITY} || ' ' || src || ' anomaly_type=' || label || ' status=Open host=10.1.1.1 error_code=' || err
  || ' rt=' || resp || 'ms cpu=' || cpu || '% mem=512MB disk=7% svc=web id=' || event_id AS line FROM te""",
)
def log_route_telemetry(spark, folder):
    return tabular.telemetry_lines(telemetry_view(spark, folder)).select("event_id", "line")


@query(
    "log_route_pages",
    f"""WITH s AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM s),
b AS (SELECT doc_id, i, {_TRIM.format('t')} AS t FROM u)
SELECT doc_id, 'source' AS kind, CAST(i AS INT) AS place, 'pdf_page=' || doc_id || ' INFO pdf_source ' || t AS line FROM b WHERE t <> ''
UNION ALL SELECT c_custkey, 'table', 0, 'pdf_page=' || c_custkey || ' INFO pdf_table ' || c_name || ' | ' || c_mktsegment FROM customer""",
)
def log_route_pages(spark, folder):
    documents = table(spark, folder, "documents").withColumn("page", F.col("doc_id"))
    lines = tabular.page_lines(documents).select("doc_id", F.lit("source").alias("kind"), F.col("line_in_page").alias("place"), "line")
    cells = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("page"),
        F.array(F.lit(None).cast("string"), F.col("c_name"), F.lit("  "), F.col("c_mktsegment")).alias("cells"),
    )
    rows = tabular.cell_lines(cells).select("doc_id", F.lit("table").alias("kind"), F.lit(0).alias("place"), "line")
    return lines.unionByName(rows)


@query(
    "log_resume",
    """WITH s AS (SELECT event_type AS source_file, event_id + 1 AS line_number, ts FROM events),
m AS (SELECT source_file, max(line_number) AS seen FROM s WHERE ts < TIMESTAMP '2024-01-15' AND source_file <> 'signup' GROUP BY source_file)
SELECT source_file, line_number FROM s LEFT JOIN m USING (source_file) WHERE line_number > coalesce(seen, 0)""",
)
def log_resume(spark, folder):
    lines = event_lines(spark, folder).withColumn("source_file", F.col("event_type"))
    stored = lines.filter("ts < timestamp'2024-01-15' and source_file <> 'signup'")  # what the table already holds
    return log_table.unseen_lines(lines, stored).select("source_file", "line_number")


@query(
    "log_insert_ignore",
    """SELECT substr(sha1('events:' || (event_id + 1)), 1, 16) AS log_id, event_id + 1 AS line_number FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def log_insert_ignore(spark, folder):
    logs = event_logs(spark, folder, dense=False)
    stored = logs.filter("timestamp < timestamp'2024-01-15'")
    batch = logs.unionByName(logs)  # every row twice
    return log_table.new_rows(batch, stored).select("log_id", "line_number")


@query(
    "log_lines",
    f"""WITH {EVENT_LINES} SELECT event_id, line, 'log' AS kind, true AS number_right FROM el""",
)
def log_lines(spark, folder):
    """events written as text with a blank line after each, read back with line numbers."""
    path = scratch_path(spark, "lines")
    lines = event_lines(spark, folder)
    lines.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(
        F.concat("line", F.lit("\t#"), "event_id", F.lit("\n"))
    ).write.text(path)
    read = text_lines.read_lines(spark, path)
    parts = F.split("line", "\t#")
    rows = cut(read.select("source_file", "line_number", parts[0].alias("line"), parts[1].cast("long").alias("event_id")))
    firsts = rows.groupBy("source_file").agg(F.min("event_id").alias("first"))
    return rows.join(firsts, "source_file").select(
        "event_id", "line", text_lines.detect_format(F.col("source_file")).alias("kind"),
        (F.col("line_number") == 2 * (F.col("event_id") - F.col("first")) + 1).alias("number_right"),
    )


@query(
    "log_dir_roundtrip",
    f"""WITH {EVENT_LINES}, {ACCESS},
r AS (
  SELECT 'text' AS origin, line, CAST(NULL AS INT) AS http_status, NULL AS service FROM el
  UNION ALL SELECT 'generic', strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || level || ' unknown event_id=' || event_id || ' event_type=' || event_type, NULL, 'unknown' FROM el
  UNION ALL SELECT 'access', strftime(stamp, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN status < 400 THEN 'INFO' WHEN status < 500 THEN 'WARN' ELSE 'ERROR' END
  || ' ' || usr || ' GET ' || coalesce(nullif(regexp_extract(request, '^\\S+\\s+(\\S+)', 1), ''), '/') || ' status=' || status || ' bytes=' || bytes || ' rt=' || rt || 'ms', CAST(status AS INT), usr FROM ac)
SELECT * FROM r""",
)
def log_dir_roundtrip(spark, folder):
    """events and pages written as text, generic CSV and access CSV, routed back from their folders."""
    home = scratch_path(spark, "inputs")
    lines = event_lines(spark, folder)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    lines.select("line").write.text(f"{home}/text")
    lines.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), level.alias("Level"), "event_id", "event_type",
    ).write.csv(f"{home}/generic", header=True)
    access_view(spark, folder).select(
        "ip", "ident", "user", "ts_part", "zone", "request", "status", "bytes", "referrer", "user_agent", "rt_ms"
    ).write.csv(f"{home}/access", header=False)
    out = None
    for name in ("text", "generic", "access"):
        part = tabular.route_folder(spark, f"{home}/{name}").select(F.lit(name).alias("origin"), "line", "http_status", "service")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "log_time_scan",
    f"""WITH {EVENT_LOGS}
SELECT log_id, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') AS time_text, level, service, template_id, template_str, raw_line, http_status
FROM lg WHERE http_status >= 200""",
)
def log_time_scan(spark, folder):
    logs = event_logs(spark, folder)
    return log_table.feature_scan(log_table.of_source(logs, "events"), "http_status >= 200").select(
        "log_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time_text"), "level", "service", "template_id",
        "template_str", "raw_line", "http_status",
    )


def _mask_sql(column: str) -> str:
    out = column
    for name, pattern in text.MASKS:
        plain = pattern.replace("++@", "+@").replace("'", "''")
        swap = "\\1" + name if name == "<PARAM>" else name
        out = f"regexp_replace({out}, '{plain}', '{swap}', 'g')"
    return out


@query(
    "mask_messages",
    f"""SELECT 'documents' AS origin, doc_id AS id, {_mask_sql('text')} AS masked FROM documents
UNION ALL SELECT 'pages', page_id, {_mask_sql('html')} FROM pages""",
)
def mask_messages(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), text.mask_text(F.col("text")).alias("masked")
    )
    pages = table(spark, folder, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), text.mask_text(F.col("html")).alias("masked")
    )
    return documents.unionByName(pages)


@query(
    "dynamic_params",
    f"""WITH {EVENT_LINES} SELECT event_id, 'svc' || user_id || '|' || value || '|' || k || '|tail|' || event_id AS params FROM el""",
)
def dynamic_params(spark, folder):
    lines = event_lines(spark, folder).withColumn(
        "message", F.concat(F.lit("node svc"), "user_id", F.lit(" did "), "event_type", F.lit(" took="), "value",
                            F.lit(";"), "k", F.lit(" tail "), "event_id"),
    ).withColumn("template", F.concat(F.lit("node <*> did "), "event_type", F.lit(" took <*> <*>")))
    params = text.dynamic_params(F.col("message"), F.col("template"))
    return lines.select("event_id", F.array_join(params, "|").alias("params"))


@query(
    "numeric_params",
    f"""WITH {EVENT_LINES} SELECT event_id, CAST(4 AS INT) AS n, value AS a, -CAST(k AS DOUBLE) AS b, CAST(event_id AS DOUBLE) AS c, CAST(1500 AS DOUBLE) AS d FROM el""",
)
def numeric_params(spark, folder):
    raw = F.to_json(F.array(F.col("value").cast("string"), F.concat(F.lit("host-"), "k"), F.lit("none"), F.concat(F.lit("#"), "event_id"), F.lit("1.5e3ms")))
    numbers = text.numeric_params(text.params_from_json(raw))
    rows = event_lines(spark, folder).select("event_id", numbers.alias("x"))
    return rows.select("event_id", F.size("x").alias("n"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abcd")])


@query(
    "entropy",
    f"""WITH {entropy_sql('documents', 'doc_id', 'text')} SELECT doc_id, entropy FROM en""",
)
def entropy(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.entropy(F.col("text")).alias("entropy"))


@query(
    "level_http_features",
    f"""WITH {ACCESS}
SELECT page_id, CAST(CASE WHEN status < 400 THEN 2.0 WHEN status < 500 THEN 2.5 ELSE 4.0 END AS DOUBLE) AS level_ordinal, CAST(2 AS DOUBLE) AS unknown_ordinal,
  concat_ws(',', CAST(status // 100 = 1 AS INT), CAST(status // 100 = 2 AS INT), CAST(status // 100 = 3 AS INT), CAST(status // 100 = 4 AS INT), CAST(status // 100 = 5 AS INT)) AS http_vec,
  CAST(epoch_us(stamp) AS DOUBLE) / 1e6 AS unix, usr AS service FROM ac""",
)
def level_http_features(spark, folder):
    status = F.col("status").cast("int")
    flags = scalars.http_flags(status)
    rows = access_view(spark, folder)
    stamp = F.concat(F.regexp_replace(F.col("ts_part"), r"^\[", ""), F.lit(" +0000"))
    return rows.select(
        "page_id", scalars.level_ordinal(F.lower(scalars.status_level(status))).alias("level_ordinal"),
        scalars.level_ordinal(F.lit(None).cast("string")).alias("unknown_ordinal"),
        F.array_join(F.transform(scalars.http_vector(list(flags.values())), lambda x: x.cast("int").cast("string")), ",").alias("http_vec"),
        scalars.to_unix(stamp, "string").alias("unix"), scalars.or_default(F.col("user"), "unknown").alias("service"),
    )


@query("mine_templates")
def mine_templates(spark, folder):
    """Templates of all event lines and all document lines, with how many lines each covers."""
    events = with_row_ids(parse_lines(event_lines(spark, folder))).select("source_file", "line_number", "message")
    pages = tabular.page_lines(table(spark, folder, "documents").withColumn("page", F.col("doc_id")))
    lines = pages.select(
        F.concat(F.lit("doc_"), "doc_id").alias("source_file"), F.col("line_in_page").cast("long").alias("line_number"),
        F.regexp_extract("line", r"(?s)pdf_source (.*)", 1).alias("message"),
    )
    logs = templates.masked_logs(events.unionByName(lines))
    distinct = stored(templates.distinct_messages(logs), "distinct")
    found, members = templates.mine(distinct)
    assigned = templates.assign(logs, distinct, found, members)
    return assigned.groupBy("template_id", "template_str").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.size("dynamic_params")).alias("most_params")
    )


@query(
    "template_resume",
    """SELECT 'E' || row_number() OVER (ORDER BY min(event_id)) AS template_id, event_type || ' of svc <*> took <DURATION> k <*>' AS template_str,
  count(*) AS n, min(event_id) + 1 AS first_line FROM events GROUP BY event_type""",
)
def template_resume(spark, folder):
    """Templates of the events, mined in three instalments: later ones go on from the saved templates."""
    words = F.concat("event_type", F.lit(" of svc_"), "user_id", F.lit(" took "), "value", F.lit(" ms k="), "k")
    logs = event_lines(spark, folder).select("source_file", "line_number", words.alias("message"))
    last = logs.agg(F.max("line_number")).first()[0] or 0
    found = members = None
    for k in range(3):
        part = logs.filter((F.col("line_number") * 3 > k * last) & (F.col("line_number") * 3 <= (k + 1) * last))
        distinct = stored(templates.distinct_messages(part), "distinct")
        found, members = templates.mine(distinct) if found is None else templates.resume(distinct, found, members)
    return found.select("template_id", "template_str", "n", F.col("l").alias("first_line"))
