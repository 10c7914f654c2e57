"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most `bits` bits
share at least 8 - bits of them, the guaranteed minimum. The index lists fingerprints under
groups of positional bytes, chosen so that each such pair meets in one list; per pair of a list
the shared positional bytes are tallied, pairs reaching the minimum are verified by their
differing bits. Copies fall together beforehand, as the index holds distinct fingerprints. A
list longer than `list_limit` is not paired: each member instead names the values up to one
flipped bit away, and members naming a common value are within two bits of each other, and the
other way round. A value is named by at most 65 members, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logloom.llm.graph import components
from logloom.llm.registry import query, table
from logloom.llm.words import byte_array, lower, word_bounds
from logloom.session import stored

BITS = 2  # linked fingerprints differ in at most so many bits
LIST_LIMIT = 64  # longer lists go the way of flipped bits
SHINGLE = 3


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash over shingles of lower-cased words, repeats counted; 0 without words."""
    data = lower(byte_array(text))
    start, end = word_bounds(data)
    if not len(start):
        return 0
    # words joined by one space: every word and the byte after it
    sizes = end - start
    begins = np.cumsum(sizes + 1) - sizes - 1
    take = np.arange(int(begins[-1] + sizes[-1])) + np.repeat(start - begins, np.append(sizes[:-1] + 1, sizes[-1]))
    joined = data[np.minimum(take, len(data) - 1)]
    joined[(begins + sizes)[:-1]] = 0x20
    joined = joined.tobytes()
    n = max(1, len(start) - words + 1)
    tops = (begins + sizes)[min(words, len(start)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins[:n].tolist(), tops)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    return _fingerprints(docs[text])


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def links(prints: DataFrame, bits: int = BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """`prints`: distinct (fp). Returns (a, b) whose connected components are those of all pairs
    within `bits` differing bits (at most 2); every pair of a list that is not too long is there.
    """
    if not 1 <= bits <= 2:
        raise ValueError("bits must be 1 or 2")
    # Two differing bits touch at most two of four pairs of bytes, so two pairs of bytes stay equal.
    lists = list(combinations(range(4), 2))
    entry = lambda k, pair: F.struct(
        F.lit(k).alias("list"),
        sum((F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(65_535)) * (1 << (16 * at)) for at, p in enumerate(pair)), F.lit(0)).alias("bytes"),
    )
    index = stored(
        prints.select("fp", F.explode(F.array(*(entry(k, pair) for k, pair in enumerate(lists)))).alias("e")).select("fp", "e.*"), "index"
    )
    sizes = index.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = stored(index.join(sizes, ["list", "bytes"]), "lists")
    left = held.filter(F.col("n") <= list_limit).select("list", "bytes", F.col("fp").alias("a"))
    right = held.filter(F.col("n") <= list_limit).select("list", "bytes", F.col("fp").alias("b"))
    shared = sum((F.when(_byte(F.col("a"), p) == _byte(F.col("b"), p), 1).otherwise(0) for p in range(8)), F.lit(0))
    near = (
        left.join(right, ["list", "bytes"]).filter("a < b").withColumn("shared", shared)
        .filter(F.col("shared") >= 8 - bits).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    )
    # Long lists: a common value one flip away, or the fingerprint itself.
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    far = held.filter(F.col("n") > list_limit).select("fp").distinct().select("fp", F.explode(flips).alias("value"))
    named = far.groupBy("value").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    if bits == 1:  # only values that are members themselves are one bit away from the others
        named = named.filter(F.array_contains("members", F.col("value")))
    centre = F.col("value") if bits == 1 else F.array_min("members")
    stars = named.select(centre.alias("a"), F.explode("members").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per input row: id, fp (the fingerprint as a long), component_id.

    component_id is the smallest id among documents reachable over links (nulls aside; null where
    all are null). Null and empty texts have fingerprint zero and link like any other. Repeated
    rows stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    prints = stored(docs.select(F.col(id).alias("id"), fingerprints(docs, text).alias("fp")), "prints")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    joined = components(links(firsts.select("fp"), bits, list_limit))
    rooted = stored(firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id), "fp", "component_id")


@query("op9_simhash")
def op9_simhash(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
