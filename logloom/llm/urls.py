"""URL rules by a sorted sweep over canonical keys.

A rule is a host and a path start; it holds for the host and all its subdomains. The canonical key
of a host is its labels reversed. A url is probed once under each of its ancestor hosts, so a rule
becomes an interval of paths under one host key. Rules and probes are sorted together per key; the
rule met last stands on top of a stack of the rules that enclose it, and popping what the probe has
left behind gives the longest rule that fits. The stack of a rule is known from the rules alone.
A key that many urls share is cut into slices, each with its own copy of the key's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.registry import query, table

SLICE_ROWS = 2_000  # a key with more probes is cut into slices of about this size
HOT_SHARE = 100_000  # ... or of this part of all probes, if that is more; so at most this many keys per label are cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_urls(pages: DataFrame, url: str) -> DataFrame:
    """Adds host and path."""
    marked = pages.withColumn("_at", F.instr(F.col(url), "://"))
    rest = F.when(F.col("_at") > 0, F.substring(F.col(url), F.col("_at") + 3, F.length(url))).otherwise("")
    tail = F.regexp_replace(F.col("_rest"), "^[^/?#]*", "")
    return (
        marked.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract(tail, "^[^?#]*", 0))
        .drop("_at", "_rest")
    )


def _key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def stacked(rules: DataFrame) -> DataFrame:
    """Per key and path: `stack`, the rules of the same key whose paths start this path, itself included.

    Of rules with equal host and path, `block` stands. Rules with a null are dropped.
    """
    own = (
        rules.select(_key(F.translate("host", UPPER, LOWER)).alias("key"), "host", "path", "action")
        .dropna().groupBy("key", "path").agg(F.max("action").alias("action"), F.min(F.translate("host", UPPER, LOWER)).alias("host"))
    )
    item = F.struct(F.length("path").alias("size"), "path", F.concat("host", "path").alias("rule"), "action")
    starts = own.select(
        "key", F.col("path").alias("full"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"),
    )
    return (
        starts.join(own.withColumn("item", item).drop("host", "action"), ["key", "path"])
        .groupBy("key", F.col("full").alias("path")).agg(F.sort_array(F.collect_list("item")).alias("stack"))
    )


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict.

    The longest fitting rule wins: of hosts and path starts together, then the longer host. Null
    urls and urls without `://` have empty host and path and get the default, as all others that no
    rule fits. Repeated rows stay repeated, other columns are ignored, empty tables are fine.
    """
    rows = split_urls(pages.select(F.col(id).alias("id"), F.col(url).alias("url")), "url").select(
        F.monotonically_increasing_id().alias("row"), "id", "host", "path"
    )
    # A rule's host has as many labels as one of the url's ancestors: one probe for each.
    labels = F.reverse(F.split("host", "\\."))
    probes = rows.withColumn("labels", labels).select(
        "row", "id", "host", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", 1, n), "."))).alias("key"),
    )
    rules = stacked(rules)
    held = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = held.agg(F.sum("n")).first()[0] or 0
    size = max(slice_rows, total // HOT_SHARE)
    # More than `size` probes: at most HOT_SHARE keys per label of a url, a bounded list.
    hot = held.filter(F.col("n") > size).select("key", F.ceil(F.col("n") / size).cast("int").alias("slices"))
    cut = probes.join(F.broadcast(hot), "key", "left").withColumn(
        "slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("slices"))).cast("int")
    )
    copies = rules.join(F.broadcast(hot), "key", "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    )
    none = F.lit(None)
    swept = copies.select("key", "slice", "path", F.lit(0).alias("kind"), "stack", *(none.cast(t).alias(c) for c, t in (("row", "bigint"), ("id", dict(rows.dtypes)["id"]), ("host", "string")))).unionByName(
        cut.select("key", "slice", "path", F.lit(1).alias("kind"), none.cast(dict(rules.dtypes)["stack"]).alias("stack"), "row", "id", "host")
    )
    order = Window.partitionBy("key", "slice").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    topped = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = topped.withColumn("hit", F.element_at(F.when(F.size(fits) > 0, fits), -1))
    found = best.groupBy("row").agg(
        F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("hit.rule").alias("size"), F.length("key").alias("width"), "hit.rule", "hit.action"))).alias("hit"),
    )
    return found.select(
        F.col("id").alias(id), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict")
    )


_CASES = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{a}' AS a" for h, p, a in RULES)


@query("op4_url_rules", f"""
WITH rules AS ({_CASES}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
f AS (SELECT r, h || p AS rule, a, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM v JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM v LEFT JOIN f ON f.r = v.r AND k = 1
""")
def op4_url_rules(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, folder, "pages"), rules)
