"""Queries over features, statistics and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from catalog.views import (
    BURST_SQL, DELTA_SQL, EVENT_LOGS, TELEMETRY, VOLATILITY_SQL, entropy_sql, event_logs, telemetry_view, vectors_sql,
)
from logloom.functions import text, vectors
from logloom.operators import features, scaling, stats, windows
from logloom.session import cut
from logloom.sources import tabular


@query("burstiness", f"WITH {EVENT_LOGS}, {BURST_SQL} SELECT event_id, burstiness FROM bu")
def burstiness(spark, folder):
    return windows.burstiness(event_logs(spark, folder)).select("event_id", "burstiness")


@query("time_delta", f"WITH {EVENT_LOGS}, {DELTA_SQL} SELECT event_id, time_delta FROM de")
def time_delta(spark, folder):
    return windows.time_delta(event_logs(spark, folder)).select("event_id", "time_delta")


@query("volatility", f"WITH {EVENT_LOGS}, {VOLATILITY_SQL} SELECT event_id, volatility FROM vo")
def volatility(spark, folder):
    logs = event_logs(spark, folder).withColumn("numeric_params", text.numeric_params(F.col("dynamic_params")))
    return windows.volatility(logs).select("event_id", "volatility")


_ROWS = f"""{EVENT_LOGS}, {BURST_SQL}, {DELTA_SQL}, {VOLATILITY_SQL}, {entropy_sql('lg', 'event_id', 'template_str')},
fr AS (SELECT *, CAST(CASE level WHEN 'ERROR' THEN 4.0 WHEN 'WARN' THEN 2.5 ELSE 2.0 END AS DOUBLE) AS level_ordinal FROM lg
       JOIN bu USING (event_id) JOIN de USING (event_id) JOIN vo USING (event_id) JOIN en USING (event_id))"""


@query(
    "feature_rows",
    f"""WITH {_ROWS}
SELECT event_id, entropy, burstiness, volatility, time_delta, level_ordinal, CAST(394 AS INT) AS width,
  CAST(http_status // 100 = 5 AS INT) AS last_flag, CAST(1 AS DOUBLE) AS vector_length FROM fr""",
)
def feature_rows(spark, folder):
    rows = features.feature_rows(cut(event_logs(spark, folder, deal=True)))
    return rows.select(
        "event_id", *features.SCALARS, F.size("features").alias("width"),
        F.element_at("features", -1).cast("int").alias("last_flag"),
        F.round(vectors.norm(F.slice("features", 1, vectors.EMBEDDING_DIM)), 6).alias("vector_length"),
    )


@query(
    "template_stats",
    f"""WITH {EVENT_LOGS}
SELECT template_id, template_str, count(*) AS n_logs, count(DISTINCT service) AS n_services,
  CAST(count_if(http_status BETWEEN 500 AND 599) AS BIGINT) AS n_5xx, CAST(count_if(http_status BETWEEN 400 AND 499) AS BIGINT) AS n_4xx
FROM lg GROUP BY ALL""",
)
def template_stats(spark, folder):
    return stats.template_statistics(event_logs(spark, folder))


@query(
    "log_summary",
    f"""WITH {EVENT_LOGS}
SELECT count(*) AS n_logs, count(DISTINCT template_id) AS n_templates, count(DISTINCT service) AS n_services,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_time FROM lg""",
)
def log_summary(spark, folder):
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return (
        stats.summary(event_logs(spark, folder, dense=False))
        .withColumn("first_time", F.date_format("first_time", form)).withColumn("last_time", F.date_format("last_time", form))
    )


@query(
    "template_baseline",
    f"""WITH {_ROWS}
SELECT template_id, min_by(template_str, line_number) AS template_str, count(*) AS frequency, round(avg(entropy), 6) AS avg_entropy,
  round(avg(burstiness), 6) AS avg_burstiness, round(avg(volatility), 6) AS avg_volatility, round(avg(time_delta), 6) AS avg_time_delta,
  round(avg(CAST(level IN ('ERROR', 'FATAL', 'CRITICAL') AS INT)), 6) AS error_rate,
  avg(CAST(level IN ('ERROR', 'FATAL', 'CRITICAL') AS INT)) < 0.01 AS is_golden
FROM fr GROUP BY template_id""",
)
def template_baseline(spark, folder):
    base = stats.template_baseline(features.scalar_features(cut(event_logs(spark, folder, deal=True))))
    means = ["avg_entropy", "avg_burstiness", "avg_volatility", "avg_time_delta", "error_rate"]
    return base.withColumns({c: F.round(c, 6) for c in means})


@query(
    "label_distribution",
    "SELECT 'q' || quality || '_t' || toxic AS label, count(*) AS n FROM labels GROUP BY ALL",
)
def label_distribution(spark, folder):
    labels = table(spark, folder, "labels").withColumn("label", F.concat(F.lit("q"), "quality", F.lit("_t"), "toxic"))
    return stats.label_distribution(labels)


@query(
    "ingest_stats",
    f"""WITH {EVENT_LOGS}
SELECT template_id || '.log' AS source_file, count(*) AS n_rows, CAST(ceil(count(*) / 5000) AS BIGINT) AS n_chunks,
  count(DISTINCT service) AS n_templates, max(line_number) AS last_line FROM lg GROUP BY ALL""",
)
def ingest_stats(spark, folder):
    logs = event_logs(spark, folder).withColumn("source_file", F.concat("template_id", F.lit(".log"))).withColumn("template_id", F.col("service"))
    return stats.ingest_stats(logs)


@query(
    "kb_stats",
    """SELECT 'templates' AS collection, count(*) AS n, CAST(count_if(label IS NOT NULL AND label > 2) AS BIGINT) AS n_labelled FROM embeddings
UNION ALL SELECT 'anomalies', count(*), CAST(count_if(event_type <> 'view') AS BIGINT) FROM events
UNION ALL SELECT 'baselines', count(*), 0 FROM documents""",
)
def kb_stats(spark, folder):
    templates = table(spark, folder, "embeddings").withColumn(
        "label", F.when(F.col("label") > 2, F.concat(F.lit("c"), "label")).when(F.col("label") == 0, "").when(F.col("label") == 1, "unlabelled")
    )
    anomalies = table(spark, folder, "events").withColumn("label", F.when(F.col("event_type") != "view", F.col("event_type")))
    return stats.kb_statistics(templates=templates, anomalies=anomalies, baselines=table(spark, folder, "documents"))


@query(
    "mean_embedding",
    """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label)
SELECT label, CAST(pos AS INT) AS pos, round(x / greatest(size, 1e-9), 6) AS x FROM m JOIN n USING (label)""",
)
def mean_embedding(spark, folder):
    means = stats.mean_vectors(table(spark, folder, "embeddings"), "label")
    return means.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "scaler_fit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS scale FROM lineitem"
        for c in COLUMNS
    ),
)
def scaler_fit(spark, folder):
    fitted = scaling.fit_columns(table(spark, folder, "lineitem", deal=False), COLUMNS)
    return fitted.select("name", *[F.round(c, 6).alias(c) for c in ("mean", "std", "scale")])


@query(
    "scaler_apply",
    "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLUMNS) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in COLUMNS) + " FROM lineitem, s",
)
def scaler_apply(spark, folder):
    rows = table(spark, folder, "lineitem", deal=False)
    scaled = scaling.apply_columns(rows, scaling.fit_columns(rows, COLUMNS), COLUMNS)
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in COLUMNS])


@query(
    "scaler_vectors",
    """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM u GROUP BY pos)
SELECT vec_id, CAST(pos AS INT) AS pos, round(CASE WHEN pos > 32 THEN CAST((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END AS FLOAT)::DOUBLE ELSE x END, 4) AS x FROM u JOIN s USING (pos)""",
)
def scaler_vectors(spark, folder):
    """Vector scaler over the second half of every embedding; the first half stays as it is."""
    rows = table(spark, folder, "embeddings")
    mean, scale = scaling.fit_vector(rows, "embedding")
    scaled = scaling.apply_vector(rows, mean, scale, "embedding", only=slice(32, 64))
    return scaled.select("vec_id", F.posexplode("scaled").alias("pos", "x")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), F.round(F.col("x").cast("double"), 4).alias("x")
    )


@query(
    "threshold_score",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS error FROM lineitem),
t AS (SELECT quantile_cont(error, 0.95) AS thr FROM e)
SELECT l_orderkey, l_linenumber, error > thr AS is_anomaly, round(greatest(least(error / (thr + 1e-9) / 2, 1.0), 0.0), 6) AS anomaly_score, round(thr, 6) AS threshold FROM e, t""",
)
def threshold_score(spark, folder):
    rows = table(spark, folder, "lineitem", deal=False).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("error"))
    threshold = scaling.exact_percentile(rows, "error", 0.95)
    return scaling.decide(rows, "error", threshold).select(
        "l_orderkey", "l_linenumber", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), F.round(F.lit(threshold), 6).alias("threshold")
    )


@query(
    "labelled_records",
    f"""WITH {TELEMETRY}
SELECT 'ANOMALY_' || event_id AS template_id, label || ' anomaly on ' || src || ' service. Severity=' || lower(severity) || '. ErrorCode=' || err
  || '. ResponseTime=' || resp || 'ms. CPU=' || cpu || '% Memory=512MB Disk=7% ServiceType=web' AS template_str, CAST(1 AS BIGINT) AS frequency,
  value AS avg_volatility, CASE WHEN lower(severity) IN ('high', 'critical') AND kd > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS error_rate, false AS is_golden, label
FROM te WHERE label <> ''""",
)
def labelled_records(spark, folder):
    return tabular.labelled_records(telemetry_view(spark, folder)).drop("avg_entropy", "avg_burstiness", "avg_time_delta")


@query(
    "hash_embedding",
    f"""WITH {vectors_sql('documents', 'doc_id', 'text', 'dv')} SELECT id AS doc_id, CAST(slot AS INT) AS slot, round(x, 5) AS x FROM dv_f""",
)
def hash_embedding(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(vectors.hash_embedding(F.col("text"))).alias("slot", "x"))
    return rows.filter("x <> 0").select("doc_id", "slot", F.round(F.col("x").cast("double"), 5).alias("x"))
