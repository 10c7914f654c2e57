"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are looked for in every document. A bit table of fixed size, filled from
the items' n-grams, goes to the executors and lets nearly nothing else through; what passes is joined
with the items' n-grams exactly. Every n-gram of an item is a seed, however frequent, so no copy loses its
only one; a copy with every fourth word changed still has seeds of three words. Where a document holds
seeds of an item, the stretch around them is aligned with the item word by word, unless it has too few of
the item's words for any alignment to reach the threshold; the share of the item's words that the best
local alignment wins decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logloom.llm.registry import query, table
from logloom.llm.words import WORD, Sequence, byte_array, lower, mix, word_bounds, word_codes
from logloom.session import hint_small, settled, stored, unused

N = 3  # words of a seed
TABLE_BITS = 23  # the bit table has 2^23 bits, 1 MB
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5  # score of the best alignment, as a share of the item's own
MIN_ITEM = 8  # items of fewer words must occur whole


def lowered_words(text: str | None) -> np.ndarray:
    """64-bit codes of the words, A-Z lower-cased."""
    data = lower(byte_array(text))
    return word_codes(data, *word_bounds(data))


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences with linear gaps, as a share of the item's own score."""
    best, above = 0, np.zeros(len(passage) + 1, dtype=np.int64)
    steps = np.arange(len(passage) + 1) * -GAP
    for word in item:
        row = np.zeros(len(passage) + 1, dtype=np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the passage
        best = max(best, int(row.max()))
        above = row
    return best / (MATCH * len(item))


def _grams(rows: DataFrame, name: str, schema: str, sizes: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """(name, gram, at) of every n-gram of one of the sizes, or of those whose bit is set. Without bits a text has n-grams of
    the largest size, or is one itself if it is shorter."""
    sent = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, text in zip(batch[name], batch["text"]):
                codes = lowered_words(text)
                if not len(codes):
                    continue
                sequence = Sequence(codes)
                for n in [min(max(sizes), len(codes))] if sent is None else [n for n in sizes if n <= len(codes)]:
                    grams = mix(sequence.grams(n))
                    at = np.arange(len(grams))
                    if sent is not None:
                        slot = grams >> np.uint64(64 - TABLE_BITS)
                        at = np.flatnonzero(sent.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        yield pd.DataFrame({name: [x] * len(at), "gram": grams[at].view(np.int64), "at": at})

    return rows.mapInPandas(find, f"{name} {schema}, gram bigint, at bigint")


def bit_table(grams: DataFrame) -> np.ndarray:
    """Bits of all n-grams of the items; what reaches the driver is bounded by the table's 2^20 bytes."""
    slot = F.shiftrightunsigned("gram", 64 - TABLE_BITS)
    cells = grams.select(slot.alias("slot")).distinct().groupBy(F.expr("slot div 8").alias("byte")).agg(
        F.sum(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits")
    )
    found = cells.toPandas()
    bits = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    bits[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return bits


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          n: int = N, threshold: float = THRESHOLD, min_item: int = MIN_ITEM) -> DataFrame:
    """(key, item, score): per text (its hash) and item at or above the threshold, the best score.

    Items with fewer than `min_item` words are held only where all their words stand in a row; items without words, or
    with a null id, are held nowhere. Null and empty texts hold nothing. Equal texts are judged once.
    """
    tests = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    tests = stored(tests.dropDuplicates(["item", "text"]), "items")
    wanted = stored(_grams(tests, "item", "string", [n]), "item-grams")
    size = F.regexp_count("text", F.lit(WORD))
    sizes = [n, *(r["size"] for r in tests.select(size.alias("size")).filter((size > 0) & (size < n)).distinct().collect())]  # at most n
    key = F.unhex(F.md5(F.col(text)))
    rows = docs.select(key.alias("key"), F.col(text).alias("text")).filter("text is not null")
    hits = stored(_grams(rows, "key", "binary", sizes, bit_table(wanted)).dropDuplicates(), "gram-hits")
    # Per text and item, the places of seeds: at most a text's words times the items that share a seed.
    per_gram = hits.groupBy("key", "gram").agg(F.collect_set("at").alias("places"))
    met = per_gram.join(wanted.select("item", "gram").distinct(), "gram").groupBy("key", "item").agg(F.flatten(F.collect_list("places")).alias("at"))
    per_text = stored(met.groupBy("key").agg(F.collect_list(F.struct("item", F.sort_array("at").alias("at"))).alias("met")), "met")
    texts = rows.join(hint_small(per_text.select("key")), "key", "left_semi").dropDuplicates(["key"])
    held = per_text.join(texts, "key").select("key", "text", F.explode("met").alias("m"))

    # An alignment scores at most what the item's words that the stretch has at all would score.
    def worth(wanted_words: np.ndarray, stretch: np.ndarray, least: float) -> float:
        if np.isin(wanted_words, stretch).sum() < least * len(wanted_words):
            return 0.0
        return align(wanted_words, stretch)

    # The words around the seeds, apart where seeds lie more than two items' lengths from each other.
    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body, test, other, places in zip(batch["key"], batch["text"], batch["item"], batch["item_text"], batch["at"]):
                words, wanted_words = lowered_words(body), lowered_words(other)
                least = threshold if len(wanted_words) >= min_item else 1.0
                at, reach = np.asarray(places, dtype=np.int64), 2 * len(wanted_words)
                cuts = np.flatnonzero(np.diff(at) > reach)
                first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
                score = max(worth(wanted_words, words[max(0, a - reach):b + reach + n], least) for a, b in zip(first, last))
                if score >= least:
                    yield pd.DataFrame({"key": [name], "item": [test], "score": [score]})

    asked = held.select("key", "text", "m.item", "m.at").join(tests.select("item", F.col("text").alias("item_text")), "item")
    return asked.mapInPandas(passages, "key binary, item string, score double").groupBy("key", "item").agg(F.max("score").alias("score"))


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """(id, item, score): one row per input row and test item that it holds a copy or an edited copy of.

    Repeated rows are reported each; other columns are ignored; empty tables give no rows.
    """
    found = leaks(docs, items, id, text, item, **options)
    kind = dict(items.dtypes)[item]
    rows = docs.select(F.col(id).alias("id"), F.unhex(F.md5(F.col(text))).alias("key"))
    return rows.join(found, "key").select(F.col("id").alias(id), F.col("item").cast(kind).alias(item), "score")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The input rows, all columns, without those that hold a test item. Null and empty texts hold none; rows of
    one text share its fate; empty tables are fine."""
    name = unused(docs, "_key")
    found = settled(lambda: leaks(docs, items, text=text, **options).select(F.col("key").alias(name)).distinct(), "leaks")
    marked = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    return marked.join(hint_small(found), name, "left_anti").drop(name)


@query("op8_decontaminate")
def op8_decontaminate(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
