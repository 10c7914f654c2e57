"""Stages of the corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

A stage takes documents (doc_id, text, lang, source, and any other columns) and returns, but for the last one,
rows with the same columns. What a stage decides is kept under hashes of rows or texts in narrow tables, and joined to the
documents it was given; all it wrote on the way there is removed. Rows that agree in doc_id and text are
repeated rows. In every stage a null text counts as an empty one, a null doc_id is an id of its own that comes last, and an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm import benchmarks, copies, lines, mixing, quality, simhash
from logloom.llm.graph import components
from logloom.llm.registry import ARROW_ROWS, query
from logloom.session import hint_small, settled, ship, stored, unused


def _ready(spark) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _same_text() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _same_row() -> Column:
    return F.unhex(F.md5(F.concat_ws("\u0001", F.hex(_same_text()), F.col("doc_id").cast("string"))))


def _joined(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` with (`left_semi`) or without (`left_anti`) a key in `keys`, a table of one column."""
    name = unused(docs, "_key")
    return docs.withColumn(name, key).join(hint_small(keys.toDF(name)), name, how).drop(name)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Documents of one text share its verdict; those of fewer than 50 words,
    so null and empty ones, go."""
    _ready(spark)
    rows = docs.select(_same_text().alias("key"), "text", "lang")
    rejected = settled(lambda: quality.judge(rows, id="key").filter("not kept").select("key").distinct(), "rejected")
    return _joined(docs, _same_text(), rejected, "left_anti")


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a column n_chars follows the text. Documents without a word go.

    Copies and near copies of whole documents are the near-dedup stage's work: a group of them counts a
    line once and loses or keeps it as a whole. Of equal lines the one in the smallest doc_id stays, of equal ids the one
    with the smaller hash of its text.
    """
    _ready(spark)
    named = docs.filter("text is not null").select(lines.known_by(F.col("text")).alias("doc"), "text")
    groups = settled(lambda: copies.classes(named, "doc").distinct().withColumnRenamed("component_id", "grp"), "groups")
    out = lines.dedup(docs, groups=groups)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.filter(F.col("text").rlike("[^ \\t-\\r]"))


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of equal ids any one. Documents are linked
    by SimHash fingerprints (`simhash`) and by sets of five-word shingles of similarity 0.8 (`copies`), which hold edited copies
    whose fingerprints differ in more bits. Repeated rows are copies of each other, and so are texts without words."""
    _ready(spark)

    def decided() -> DataFrame:
        named = docs.select(_same_row().alias("key"), "text")
        prints = stored(simhash.near_duplicates(named, "key").select("key", "component_id"), "prints-of-rows")
        edited = stored(copies.classes(named, "key"), "edited-copies")
        joined = components(prints.union(edited).select(F.col("key").alias("a"), F.col("component_id").alias("b")))
        found = prints.select("key").distinct().join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("component_id"))
        rows = docs.select(_same_row().alias("key"), "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("doc_id"))
        members = stored(rows.join(found, "key"), "members")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("kept"))
        return members.join(first.select("kept.key", F.lit(True).alias("kept")), "key", "left").select("key", "n", F.coalesce("kept", F.lit(False)).alias("kept"))

    marks = settled(decided, "copies")
    kept = _joined(docs, _same_row(), marks.filter("not kept").select("key"), "left_anti")
    again = marks.filter("kept and n > 1").select("key")
    name = unused(docs, "_row")
    once = _joined(kept, _same_row(), again, "left_semi").withColumn(name, _same_row()).dropDuplicates([name]).drop(name)
    return _joined(kept, _same_row(), again, "left_anti").unionByName(once)


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, exact or edited, of a benchmark item. Documents of one text share its fate."""
    _ready(spark)
    return benchmarks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what the mix takes of each: size, source_size, target (of its source) and taken, in words.

    Rows are numbered for this and written once, as ids may be null or repeated. Documents of size 0 are taken 0 times.
    """
    _ready(spark)
    row = unused(docs, "_row")
    # Written once: another read of the same files may be split, and so numbered, otherwise.
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col(row).alias("row"), "text", "source")
    taken = settled(lambda: mixing.mix(plain, id="row").select(F.col("row").alias(row), "size", "source_size", "target", "taken"), "taken")
    return numbered.join(taken, row).select(*(numbered[f"`{c}`"] for c in docs.columns if c not in taken.columns[1:]), *taken.columns[1:])


STAGES: list[tuple[str, Callable]] = [
    ("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_copies), ("benchmark", drop_leaks), ("mix", mix_sources),
]
ORACLE_SQL = None  # Similarities, alignments and the hashed order of the mix have no SQL form; see tests/llm


@query("pipeline")
def run(spark, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
