"""Queries over the knowledge base, searches, propagation and incident texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from catalog.views import EVENT_LOGS, bm25_sql, event_logs, hybrid_sql, near_sql, vectors_sql
from logloom.functions.vectors import hash_embedding
from logloom.operators import bm25, incident, kb, keyword_index, knn, scaling
from logloom.operators.hybrid import hybrid_search as search_both, with_payload
from logloom.session import scratch_path
from logloom.sources.log_table import state_key


_INDEXES: dict[tuple, str] = {}


def _document_index(spark, folder):
    """The folder of the documents' keyword index, built when their files are new to the session."""
    docs = table(spark, folder, "documents")
    home = _INDEXES.setdefault((spark.sparkContext.applicationId, state_key(docs)), scratch_path(spark, "index"))
    return keyword_index.built(docs, home, "doc_id", "text")


def _vectors(df, text):
    return df.withColumn("embedding", hash_embedding(F.col(text)))


@query(
    "bm25_index",
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
o AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM t), p AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM t)
SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf, n AS n_docs, round(al, 6) AS avg_dl
FROM p, o GROUP BY term, n, al""",
)
def bm25_index(spark, folder):
    docs = table(spark, folder, "documents")
    size = bm25.index_stats(docs, "text").first()
    return bm25.index_terms(docs, "text", size["n_docs"]).select(
        "term", "df", F.round("idf", 6).alias("idf"), F.lit(size["n_docs"]).cast("long").alias("n_docs"), F.round(F.lit(size["avg_dl"]), 6).alias("avg_dl")
    )


@query(
    "bm25_search",
    f"""WITH {bm25_sql('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', 5)}
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm""",
)
def bm25_search(spark, folder):
    """From the stored index of the documents, which later searches of the session use again."""
    return keyword_index.search(table(spark, folder, "benchmark"), _document_index(spark, folder), 5, "item_id")


@query(
    "bm25_appended",
    f"""WITH {bm25_sql('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', 12)}
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm""",
)
def bm25_appended(spark, folder):
    """The index grows in three appends of small blocks; scores are those of all documents."""
    docs, home = table(spark, folder, "documents"), scratch_path(spark, "index")
    for k in range(3):
        keyword_index.append(docs.filter(F.col("doc_id") % 3 == k), home, "doc_id", "text", batch=k, block=100)
    return keyword_index.search(table(spark, folder, "benchmark"), home, 12, "item_id")


@query(
    "bm25_scan",
    f"""WITH {bm25_sql('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', 5)}
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm""",
)
def bm25_scan(spark, folder):
    """The way without an index: queries go to the documents."""
    return bm25.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"), 5, "item_id", "doc_id")


_UNIT = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
"""


@query(
    "vector_topk",
    f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM u a, u b WHERE a.vec_id <> b.vec_id)
SELECT query_id, item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INT) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= 5""",
)
def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    return knn.nearest(rows, rows, 5, "vec_id", "vec_id", skip_same=True)


@query(
    "vector_topk_cells",
    f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM u a, u b)
SELECT query_id, item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INT) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= 3""",
)
def vector_topk_cells(spark, folder):
    """The way taken when neither side may be broadcast."""
    rows = table(spark, folder, "embeddings")
    return knn.nearest(rows, rows, 3, "vec_id", "vec_id", broadcast_floats=0)


_HYBRID = f"""{vectors_sql('benchmark', 'item_id', 'text', 'qv')}, {vectors_sql('documents', 'doc_id', 'text', 'dv')},
{near_sql('qv', 'dv', 'benchmark', 'item_id', 'documents', 'doc_id', 10)},
{bm25_sql('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', 10)}, {hybrid_sql('near', 'bm', 5)}"""


@query(
    "hybrid_search",
    f"""WITH {_HYBRID} SELECT query_id, item_id, hybrid_score, CAST(hy.rank AS INT) AS rank, lang, source FROM hy JOIN documents ON item_id = doc_id""",
)
def hybrid_search(spark, folder):
    docs = _vectors(table(spark, folder, "documents"), "text")
    found = search_both(_vectors(table(spark, folder, "benchmark"), "text"), docs, 5, "item_id", "doc_id", item_text="text", index=_document_index(spark, folder))
    return with_payload(found, docs.select("doc_id", "lang", "source"), "doc_id")


@query(
    "label_propagation",
    f"""WITH ld AS (SELECT d.doc_id, text, 'q' || quality || '_t' || toxic AS label FROM documents d JOIN labels USING (doc_id)),
ud AS (SELECT d.doc_id, text FROM documents d ANTI JOIN labels USING (doc_id)),
{vectors_sql('documents', 'doc_id', 'text', 'dv')},
{near_sql('dv', 'dv', 'ud', 'doc_id', 'ld', 'doc_id', 5)},
v AS (SELECT query_id, label, count(*) / 5.0 AS confidence FROM near JOIN ld ON item_id = doc_id GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, label) = 1)
SELECT query_id AS doc_id, label, CAST(confidence AS DOUBLE) AS confidence FROM w WHERE confidence >= 0.6""",
)
def label_propagation(spark, folder):
    """Documents without a label take their neighbours' label."""
    named = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("_t"), "toxic").alias("label"))
    docs = _vectors(table(spark, folder, "documents").join(named, "doc_id", "left"), "text")  # so that either side embeds its own rows
    return kb.propagate(docs, 5, 0.6, key="doc_id")


def _templates(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.concat(F.lit("T"), "vec_id").alias("template_id"), F.concat(F.lit("text "), "vec_id").alias("template_str"), "embedding",
        F.when(F.col("label") > 4, F.concat(F.lit("c"), "label")).alias("label"), F.col("vec_id").alias("frequency"),
        F.lit(0.5).alias("avg_entropy"), F.lit(1.0).alias("avg_burstiness"), (F.col("label") / 4).alias("avg_volatility"),
        F.lit(None).cast("double").alias("avg_time_delta"), F.lit(0.25).alias("error_rate"), (F.col("label") == 3).alias("is_golden"),
        "vec_id",
    )
    return rows


@query(
    "label_update",
    """WITH t AS (SELECT 'T' || vec_id AS template_id, CASE WHEN label > 4 THEN 'c' || label ELSE 'unlabelled' END AS label FROM embeddings),
u AS (SELECT 'T' || doc_id AS template_id, max('q' || quality) AS l FROM labels GROUP BY ALL),
m AS (SELECT t.template_id, coalesce(l, label) AS label FROM t LEFT JOIN u USING (template_id)),
v AS (SELECT 'T' || doc_id AS template_id, 'lang_' || lang AS l, n_chars / 100000.0 AS c FROM documents)
SELECT m.template_id, CASE WHEN m.label = 'unlabelled' AND l IS NOT NULL THEN 'propagated:' || l ELSE m.label END AS label,
  CASE WHEN m.label = 'unlabelled' THEN round(c, 6) END AS propagation_confidence FROM m LEFT JOIN v USING (template_id)""",
)
def label_update(spark, folder):
    """Labels given by hand, then propagated ones written back to the rows still without a label."""
    base = kb.template_rows(_templates(spark, folder))
    given = table(spark, folder, "labels").select(F.concat(F.lit("T"), "doc_id").alias("template_id"), F.concat(F.lit("q"), "quality").alias("label"))
    labelled = kb.assign_labels(base, given)
    votes = table(spark, folder, "documents").select(
        F.concat(F.lit("T"), "doc_id").alias("template_id"), F.concat(F.lit("lang_"), "lang").alias("label"), (F.col("n_chars") / 100000).alias("confidence")
    )
    open_rows = labelled.filter(F.col("label") == "unlabelled").select("template_id")
    stored = kb.store_propagated(labelled, votes.join(open_rows, "template_id", "left_semi"))
    return stored.select("template_id", "label", F.round("propagation_confidence", 6).alias("propagation_confidence"))


@query(
    "kb_upsert",
    """WITH o AS (SELECT 'T' || vec_id AS template_id, 'text ' || vec_id AS document, CASE WHEN label > 4 THEN 'c' || label END AS l, vec_id AS frequency, label, embedding FROM embeddings),
b AS (SELECT 'T' || (vec_id + 250) AS template_id, 'newer ' || vec_id AS document, CASE WHEN label IN (1, 7) THEN 'n' || label END AS l, vec_id + 7 AS frequency, label, embedding FROM embeddings),
m AS (SELECT template_id, coalesce(b.document, o.document) AS document, coalesce(b.l, o.l, 'unlabelled') AS label,
      coalesce(b.frequency, o.frequency) AS frequency, coalesce(b.label, o.label) AS c, coalesce(b.embedding, o.embedding) AS e FROM o FULL JOIN b USING (template_id))
SELECT template_id, document, label, frequency, round(CAST(e[1] AS DOUBLE), 6) AS first_x,
  '{"frequency":' || frequency || ',"avg_entropy":0.5,"avg_burstiness":1.0,"avg_volatility":' || CAST(c / 4 AS DOUBLE) || ',"avg_time_delta":0.0,"error_rate":0.25,"is_golden":' || (c = 3) || '}' AS metrics_json FROM m""",
)
def kb_upsert(spark, folder):
    """Half of a batch of templates is new, half replaces older rows; each of its rows comes twice."""
    rows = _templates(spark, folder)
    newer = rows.withColumns(
        {
            "template_id": F.concat(F.lit("T"), F.col("vec_id") + 250), "template_str": F.concat(F.lit("newer "), "vec_id"),
            "frequency": F.col("vec_id") + 7,
        }
    ).join(table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("c")), "vec_id").withColumn(
        "label", F.when(F.col("c").isin(1, 7), F.concat(F.lit("n"), "c"))
    )
    older = newer.withColumn("template_str", F.lit("stale")).withColumn("label", F.lit(None).cast("string"))
    batch = kb.template_rows(older).withColumn("seq", F.lit(1)).unionByName(kb.template_rows(newer).withColumn("seq", F.lit(2)))
    merged = kb.upsert(kb.template_rows(rows), batch, "template_id", "seq")
    return merged.select(
        "template_id", "document", "label", "frequency", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_x"), "metrics_json"
    )


@query(
    "kb_anomalies",
    f"""WITH {EVENT_LOGS}, t AS (SELECT quantile_cont(value, 0.95) AS thr FROM events)
SELECT log_id, template_id, raw_line AS document, round(value, 6) AS ae2_error, round(greatest(least(value / (thr + 1e-9) / 2, 1), 0), 6) AS anomaly_score,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'unlabelled' AS label, service FROM lg, t WHERE value > thr""",
)
def kb_anomalies(spark, folder):
    """Scored events put into an empty anomaly collection twice: the second time changes nothing."""
    rows = kb.anomaly_rows(_scored(spark, folder).filter("is_anomaly").withColumn("timestamp", F.date_trunc("second", "real_time")))
    stored = kb.upsert(rows.limit(0), rows.withColumn("seq", F.lit(0)), "log_id", "seq")
    again = kb.upsert(stored, rows.withColumn("seq", F.lit(0)), "log_id", "seq")
    return again.drop("embedding").withColumns({c: F.round(c, 6) for c in ("ae2_error", "anomaly_score")})


def _scored(spark, folder):
    """Event logs scored by their value: the largest twentieth are anomalies."""
    logs = event_logs(spark, folder).join(
        event_logs(spark, folder, dense=False).select("event_id", F.col("timestamp").alias("real_time")), "event_id"
    )
    threshold = scaling.exact_percentile(table(spark, folder, "events"), "value", 0.95)
    scored = scaling.decide(logs.withColumn("ae2_error", F.col("value")), "ae2_error", threshold)
    return _vectors(scored.withColumn("label", F.lit(None).cast("string")), "raw_line")


def _knowledge(spark, folder):
    """A knowledge base of all documents: their language is the label."""
    docs = table(spark, folder, "documents")
    return _vectors(docs, "text").select(
        F.concat(F.lit("D"), "doc_id").alias("template_id"), F.col("text").alias("document"), F.col("lang").alias("label"), "embedding",
        (F.col("n_chars") / 1000).alias("avg_entropy"), F.lit(1.0).alias("avg_burstiness"), F.lit(0.0).alias("error_rate"),
        (F.col("lang") == "en").alias("is_golden"),
    )


_KB = "kd AS (SELECT 'D' || doc_id AS template_id, text AS document, lang AS label, n_chars, lang = 'en' AS is_golden FROM documents)"
_CASE = f"""{EVENT_LOGS}, t AS (SELECT quantile_cont(value, 0.95) AS thr FROM events),
an AS (SELECT *, least(value / (thr + 1e-9) / 2, 1) AS score, row_number() OVER (ORDER BY sec, line_number) AS number FROM lg, t WHERE value > thr
       QUALIFY row_number() OVER (ORDER BY sec, line_number) <= 20), {_KB},
{vectors_sql('an', 'number', 'raw_line', 'qv')}, {vectors_sql('kd', 'template_id', 'document', 'dv')},
{near_sql('qv', 'dv', 'an', 'number', 'kd', 'template_id', 10)},
{bm25_sql('an', 'number', 'raw_line', 'kd', 'template_id', 'document', 10)}, {hybrid_sql('near', 'bm', 5)},
fs AS (SELECT * FROM hy QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY query_id, rank) = 1),
b1 AS (SELECT string_agg(printf(E'\\n[Anomaly %d]\\n  Template   : %s\\n  Service    : %s\\n  Timestamp  : %s\\n  AE2 Error  : %.4f\\n  Score      : %.3f\\n  Label      : unlabelled\\n  Log Sample : %s',
  number, template_id, service, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S'), value, score, raw_line), E'\\n' ORDER BY number) AS body FROM an),
b2 AS (SELECT string_agg(printf(E'\\n[Baseline: %s]\\n  Template    : %s\\n  Label       : %s\\n  Avg Entropy : %.3f\\n  Avg Burst   : 1.0\\n  Error Rate  : 0.000\\n  Is Golden   : %s\\n  Hybrid Score: %s',
  item_id, document, label, n_chars / 1000.0, CASE WHEN is_golden THEN 'True' ELSE 'False' END, CAST(hybrid_score AS VARCHAR)), E'\\n' ORDER BY query_id, rank) AS body FROM fs JOIN kd ON item_id = template_id),
cx AS (SELECT E'=== DETECTED ANOMALIES ===\\n' || b1.body || E'\\n\\n=== RETRIEVED NORMAL BASELINES (for comparison) ===\\n' || b2.body AS context FROM b1, b2)"""


@query("rag_context", f"WITH {_CASE} SELECT context FROM cx")
def rag_context(spark, folder):
    knowledge = _knowledge(spark, folder)
    anomalies = incident.first_anomalies(_scored(spark, folder))
    queries = anomalies.select(F.col("number").cast("long").alias("query_id"), F.col("raw_line").alias("text"), "embedding")
    found = search_both(queries, knowledge, 5, item_id="template_id")
    return incident.context_text(anomalies, with_payload(found, knowledge, "template_id"))


@query(
    "incident_report",
    f"""WITH {_CASE}, c AS (SELECT count(*) AS n, max(least(value / (thr + 1e-9) / 2, 1)) AS m FROM lg, t WHERE value > thr),
s AS (SELECT (SELECT list_sort(list_distinct(list(service))) FROM lg, t WHERE value > thr) AS services, list(log_id ORDER BY number) AS ids FROM an)
SELECT 'Analyse the following production log anomalies and provide a complete incident report.' || E'\\n\\n' || context || E'\\n\\n---\\n\\nADDITIONAL QUERY: Why?\\n\\nDetected at: 2024-02-01 00:00:00 UTC\\nTotal anomalies in this batch: '
  || n || E'\\nHighest anomaly score: ' || printf('%.3f', m) || E'\\nAffected services: ' || array_to_string(services, ', ') || E'\\n\\nProvide a structured root cause analysis and remediation plan using these sections:\\n## Incident Summary\\n## Root Cause Analysis\\n## Business Impact Assessment\\n## Corrective Actions\\n## Correlated Patterns\\n## Confidence Level (High/Medium/Low)\\n' AS report_prompt,
  E'Write a 3-sentence executive summary (non-technical, action-oriented):\\n\\nAnomaly count: ' || n || E'\\nAffected services: ' || array_to_string(services, ', ') || E'\\nHighest severity score: ' || printf('%.3f', m) || E'\\nRoot causes detected: Under investigation\\n' AS summary_prompt,
  n AS n_anomalies, array_to_string(services, ',') AS affected_services, round(m, 6) AS max_anomaly_score, '' AS root_causes, array_to_string(ids, ',') AS anomaly_ids
FROM cx, c, s""",
)
def incident_report(spark, folder):
    record = incident.incident_record(
        _scored(spark, folder), _knowledge(spark, folder), 5, "Why?", F.lit("2024-02-01 00:00:00").cast("timestamp")
    )
    lists = {c: F.array_join(c, ",") for c in ("affected_services", "root_causes", "anomaly_ids")}
    return record.withColumns(lists).withColumn("max_anomaly_score", F.round("max_anomaly_score", 6))


@query(
    "incident_none",
    "SELECT 'No anomalies detected in this batch.' AS report_prompt, count(*) - count(*) AS n_anomalies FROM events",
)
def incident_none(spark, folder):
    scored = _scored(spark, folder).withColumn("is_anomaly", F.col("value") < 0)
    return incident.incident_record(scored, _knowledge(spark, folder)).select("report_prompt", "n_anomalies")


@query(
    "single_log_context",
    f"""WITH {_KB}, {vectors_sql('benchmark', 'item_id', 'text', 'qv')}, {vectors_sql('kd', 'template_id', 'document', 'dv')},
{near_sql('qv', 'dv', 'benchmark', 'item_id', 'kd', 'template_id', 6)},
{bm25_sql('benchmark', 'item_id', 'text', 'kd', 'template_id', 'document', 6)}, {hybrid_sql('near', 'bm', 3)},
l AS (SELECT query_id, string_agg(printf(E'  [%s] %s\\n    Label: %s, Score: %.3f\\n', item_id, document, label, hybrid_score), '' ORDER BY hy.rank) AS body FROM hy JOIN kd ON item_id = template_id GROUP BY query_id)
SELECT query_id, E'SUSPICIOUS LOG:\\n' || text || E'\\n\\nAE2 Error: 0.2500\\n\\nSIMILAR PATTERNS:\\n' || body || E'\\n\\nIn 2-3 sentences: What is the likely cause and what immediate action should be taken?' AS prompt
FROM l JOIN benchmark ON query_id = item_id""",
)
def single_log_context(spark, folder):
    lines = _vectors(table(spark, folder, "benchmark"), "text").withColumn("ae2_error", F.lit(0.25))
    return incident.single_log_context(lines.withColumnRenamed("item_id", "query_id"), _knowledge(spark, folder), 3)
