"""Filter interaction audit: what every filter removes alone, after the others, and in every order.

Files are processed as available-now micro-batches. The text's own filters give a mask of failed ones per
document; whether a smaller id holds the same text is known only at the end, so it is kept as keyed state: a text
has the smallest id so far and the documents that have it. When a smaller id arrives, the masks of the earlier
ones are retracted from the counters of their parts and counted again with the duplicate's bit. Counters are sums
of such changes by (part, mask, labels), written by micro-batch; a repeated batch overwrites its own changes.
Every order of the filters is then a sum over at most 32 masks a part.

Texts are known by their 128-bit hash; a state key holds the texts of one of many small buckets, as many
as the number of documents asks for. Rows of a text that are not the smallest id within their task's rows are
counted before the shuffle, so a text that a third of all rows share sends one row a task to its state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.llm.registry import query, table
from logloom.llm.words import WHITE
from logloom.session import scratch_path, stored
from logloom.sources.tabular import is_folder

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of E
MIN_WORDS, DISTINCT, UPPER, SYMBOLS = 50, 65, 5, "#$%&*|"
BATCHES = 4  # micro-batches of a run over the files that are there
ORDERS = ["".join(p) for p in permutations(FILTERS)]
# State on disk, of which a batch uploads its changes; files are not preallocated, as state partitions may be many and small.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
TEXTS = 256  # of one state key, on average
CHANGES = "part string, mask int, good int, toxic int, n bigint"
SEEN = f"bucket bigint, hash binary, id bigint, {CHANGES}"
KEPT = "hash array<binary>, id array<bigint>, part array<string>, mask array<int>, good array<int>, toxic array<int>, n array<bigint>"


def masks(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; bit k is filter k."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")

    def bits(s: Column) -> Column:
        n = F.size(s["words"])
        upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        held = F.translate(text, SYMBOLS, "") != text
        tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct(s["words"])) < DISTINCT * n, 100 * upper > UPPER * F.length(text), held]
        return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return F.transform(F.array(F.struct(words.alias("words"))), bits)[0].cast("int")


class _Texts:
    """Of each text the smallest id so far, and the documents that have it: (part, mask, good, toxic) and how many.
    `changes` is what this makes the counters of other documents and of earlier ones change by."""

    def __init__(self) -> None:
        self.least, self.held, self.changes = {}, {}, Counter()

    def add(self, text: bytes, id: int, what: tuple, n: int) -> None:
        first = self.least.get(text)
        if first is not None and id > first:
            self.changes[(what[0], what[1] | DUPLICATE, *what[2:])] += n
            return
        if first is None or id < first:
            for (part, mask, *labels), k in self.held.get(text, {}).items():
                self.changes[(part, mask | DUPLICATE, *labels)] += k
            self.least[text], self.held[text] = id, {}
        held = self.held[text]
        held[what] = held.get(what, 0) + n

    def rows(self) -> list[tuple]:
        return [(text, self.least[text], *what, n) for text, held in self.held.items() for what, n in held.items()]


def _what(frame: pd.DataFrame):
    return zip(frame["part"], frame["mask"].tolist(), frame["good"].tolist(), frame["toxic"].tolist())


def _seen(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Of each text the rows with the smallest id, under the text's bucket; the others, and rows without an
    id, as counted changes under negative buckets."""
    def flush(texts: _Texts) -> pd.DataFrame:
        rows = [(int.from_bytes(row[0][:7], "big") % buckets, *row) for row in texts.rows()]
        rows += [(-1 - k % 64, None, 0, *what, n) for k, (what, n) in enumerate(texts.changes.items())]
        return pd.DataFrame(rows, columns=["bucket", "hash", "id", "part", "mask", "good", "toxic", "n"])

    texts = _Texts()
    for batch in batches:
        for text, id, has, what in zip(batch["hash"], batch["id"].tolist(), batch["has"], _what(batch)):
            if has:
                texts.add(text, id, what, 1)
            else:
                texts.changes[what] += 1
        if len(texts.least) + len(texts.changes) > 100_000:  # a task holds no more; later rows meet the earlier ones in the state
            yield flush(texts)
            texts = _Texts()
    yield flush(texts)


def _changes(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes that new rows of a bucket's texts make; the texts' smallest ids and their documents are its state."""
    texts, out = _Texts(), Counter()
    if state.exists:
        for text, id, *what, n in zip(*state.get):
            texts.add(text, id, tuple(what), n)
            out[tuple(what)] -= n  # counted before
    for frame in frames:
        for text, id, n, what in zip(frame["hash"], frame["id"].tolist(), frame["n"].tolist(), _what(frame)):
            if key[0] < 0:
                out[what] += n
            else:
                texts.add(text, id, what, n)
    rows = texts.rows()
    for _, _, *what, n in rows:
        out[tuple(what)] += n
    out.update(texts.changes)
    if rows:
        state.update(tuple(list(column) for column in zip(*rows)))
    yield pd.DataFrame([(*what, n) for what, n in out.items() if n], columns=["part", "mask", "good", "toxic", "n"])


def _marked(docs: DataFrame, labels: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """(hash, id, has, part, mask, good, toxic) of every row."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(plain)).alias("hash"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), masks(plain).alias("mask"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(known, "id", "left").select("hash", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("has"), "part", "mask", zero("good"), zero("toxic"))


def counters(spark: SparkSession, path: str, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source", batches: int = BATCHES) -> DataFrame:
    """(part, mask, good, toxic, n): documents of every part by failed filters and labels.

    `path`: Parquet files; `batches` micro-batches take them in turn. The state lies in the shared folder and goes on from there
    when executors are lost.
    """
    docs = spark.read.parquet(path)
    files = max(1, -(-len(docs.inputFiles()) // batches))
    before = {name: spark.conf.get(name, None) for name in STORE}
    home = scratch_path(spark, "audit")
    reader = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    buckets = max(1, docs.count() // TEXTS)
    rows = _marked(source, labels, id, text, part).mapInPandas(lambda batches: _seen(batches, buckets), SEEN)
    changes = rows.groupBy("bucket").applyInPandasWithState(_changes, CHANGES, KEPT, "append", GroupStateTimeout.NoTimeout)

    def store_batch(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        changes.writeStream.foreachBatch(store_batch).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    if docs.isEmpty():
        return spark.createDataFrame([], CHANGES)
    told = spark.read.schema(CHANGES).parquet(f"{home}/changes/batch=*")
    return told.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from `counters`; zeros included."""
    # A step's counts depend on its filter and on which filters came before it: 80 cases for 600 steps.
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(order, at + 1, bits[f], sum(bits[g] for g in order[:at])) for order in ORDERS for at, f in enumerate(order)]
    cases = sorted({(bit, before) for *_, bit, before in steps})
    weigh = lambda c: F.sum(F.col(c) * F.col("n")).alias(c)
    by_mask = counts.groupBy("part", "mask").agg(weigh("good"), weigh("toxic"), F.sum("n").alias("n"))
    case = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in cases)))
    told = by_mask.withColumn("c", case).select("part", "mask", "n", "good", "toxic", "c.bit", "c.before")
    mask, bit = F.col("mask"), F.col("bit")
    fails, early = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda test, c="n": F.sum(F.when(test, F.col(c)).otherwise(0))
    told = told.groupBy("part", "bit", "before").agg(
        total(~fails & ~early).alias("kept"), total(fails & ~early).alias("removed"), total(fails & early).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(fails & ~early, "good").alias("good_lost"), total(fails & ~early, "toxic").alias("toxic_lost"),
        # Each of a document's failing filters is the first of them in the same share of all orders.
        F.sum(F.when(fails, F.col("n") * F.expr(f"{len(ORDERS)} div bit_count(mask)")).otherwise(0)).alias("shapley"),
    )
    places = F.broadcast(counts.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int"))  # 600 rows
    return told.join(places, ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """(part, filter_order, step, counts) of the documents in the Parquet files at `path`.

    Null texts are empty, null parts the empty string. Only a smaller id makes a text a duplicate: rows with
    equal ids are none of each other, and a row without an id neither is one nor makes one. Several labels of an
    id count as one that has what any of them has. Other columns are ignored, and no rows give none.
    """
    return interactions(stored(counters(spark, path, labels, **options), "counters"))


def _sql() -> str:
    tests = ["n < 50", "100 * d < 65 * n", "100 * u > 5 * length(text)", "regexp_matches(text, '[#$%&*|]')", "coalesce(doc_id > first_id, false)"]
    fails = ", ".join(f"({t})::INT AS f{k}" for k, t in enumerate(tests))
    mask = " + ".join(f"f{k} * {1 << k}" for k in range(5))
    word = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
t AS (
  SELECT d.doc_id, part, text, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len({word}) AS n, len(list_distinct({word})) AS d,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS u, min(d.doc_id) OVER (PARTITION BY text) AS first_id
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, good, toxic, {mask} AS mask FROM (SELECT *, {fails} FROM t)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(range(5)) AS k),
o AS (
  SELECT a.k AS a, b.k AS b, c.k AS c, e.k AS e, g.k AS g FROM x a, x b, x c, x e, x g
  WHERE len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5),
s AS (
  SELECT list_aggregate([substr('{FILTERS}', (k + 1)::INT, 1) FOR k IN ks], 'string_agg', '') AS filter_order, step::INT AS step, 1 << ks[step]::INT AS bit,
    coalesce(list_sum([1 << k::INT FOR k IN ks[1:step - 1]]), 0)::INT AS before
  FROM (SELECT [a, b, c, e, g] AS ks FROM o), (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask::INT), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM h, s GROUP BY part, filter_order, step
"""


@query("op12_filter_audit", _sql())
def op12_filter_audit(spark, folder):
    return audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))
