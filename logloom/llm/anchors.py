"""Anchors of repeated windows: what operators on long repeats share.

A window is `window` units in a row (bytes or words). Of every window the smallest hash among its
stretches of `k` units is its anchor, so two equal windows hold an equal anchor at an equal place. An
anchor's context is what its windows span together. Where a whole context occurs twice, all its windows
do. Contexts that meet others
under the same anchor without being equal are the borders of repeats, and only those are looked at
unit by unit. A text is known by its hash; copies give equal contexts and need no care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.words import CODES, Sequence, byte_array, mix, winnow, word_bounds, word_codes
from logloom.session import hint_small, stored

PACKED = 1 << 32  # a span is start * PACKED + end
SMALL = 1 << 16  # contexts have fewer units: windows must be under half of it


def byte_units(text: str | None) -> np.ndarray:
    return CODES[byte_array(text)]


def word_units(text: str | None) -> np.ndarray:
    data = byte_array(text)
    return word_codes(data, *word_bounds(data))


def key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def half(window: int, k: int) -> int:
    """A window has at least so many units on one side of its anchor."""
    return (window - k + 1) // 2


def _anchors(codes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, place, and hashes of the anchor with its left and right half, of every anchor. A place
    packs the context's start, the units in it before the anchor, and its size; halves are two times 32 bits, 0 for none."""
    if len(codes) < window:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, np.zeros(0, dtype=np.int64), none
    sequence = Sequence(codes)
    grams = sequence.grams(k)
    at, first, last = winnow(grams, window - k + 1)
    shape = (at - first) * SMALL + last - first + window
    with np.errstate(over="ignore"):
        context = mix(mix(sequence.stretches(first, last + window)) + shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    reach, wide = half(window, k), np.uint64(32)
    left, right = np.flatnonzero(at - first >= reach), np.flatnonzero(last + window - at - k >= reach)
    halves = np.zeros(len(at), dtype=np.uint64)
    halves[left] = (mix(sequence.stretches(at[left] - reach, at[left] + k)) >> wide | np.uint64(1)) << wide
    halves[right] |= mix(sequence.stretches(at[right], at[right] + k + reach)) >> wide | np.uint64(1)
    return grams[at], context, first * PACKED + shape, halves


def unpacked(places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of the context, units before the anchor, end of the context."""
    places = np.asarray(places, dtype=np.int64)
    start, shape = places // PACKED, places % PACKED
    return start, shape // SMALL, start + shape % SMALL


def shared(docs: DataFrame, text: str, units: Callable, window: int, k: int) -> DataFrame:
    """(a, c, key, at, halves): every anchor that occurs more than once, with its context's hash and its place."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_anchors(units(t), window, k) for t in batch["text"]]
            yield pd.DataFrame({
                "key": batch["key"], "a": [f[0].view(np.int64) for f in found], "c": [f[1].view(np.int64) for f in found],
                "at": [f[2] for f in found], "halves": [f[3].view(np.int64) for f in found],
            })

    long = docs.select(key(F.col(text)).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= window)
    rows = stored(long.mapInPandas(find, "key binary, a array<bigint>, c array<bigint>, at array<bigint>, halves array<bigint>").filter(F.size("a") > 0), "anchors")
    twice = rows.select(F.explode("a").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    # A table of its own, so that the join below may be split where one anchor holds very many places.
    twice = stored(twice, "repeated")
    each = rows.select("key", F.explode(F.arrays_zip("a", "c", "at", "halves")).alias("x")).select("x.a", "x.c", "key", "x.at", "x.halves")
    return stored(each.join(twice, "a"), "shared")


def split(found: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """What `shared` says by itself, (key, span), and the border contexts (key, at, a, n, others).

    A border context is given once, at its first place, with the number of its occurrences and of the different
    contexts of its anchor. A window that two contexts share holds at least half of what it has besides the anchor on one
    side, so a context that agrees with no other one in either half is none, and one that agrees in one half only
    ends where the other half would.
    """
    contexts = stored(found.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at", "halves")).alias("first")), "contexts")
    whole = found.join(contexts.filter("n > 1").select("a", "c"), ["a", "c"])
    start = F.shiftright("at", 32)
    spans = whole.select("key", (start * PACKED + start + F.col("at") % SMALL).alias("span"))
    several = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("others")).filter("others > 1").select("a")
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.shiftright("first.halves", 32).alias("half")),
        F.struct(F.lit(False).alias("left"), F.col("first.halves").bitwiseAND((1 << 32) - 1).alias("half")),
    )).alias("side")
    each = contexts.join(several, "a").select("a", "first.key", "first.at", "n", sides).select("a", "key", "at", "n", "side.left", "side.half").filter("half <> 0")
    each = stored(each, "halves")
    met = each.groupBy("a", "left", "half").agg(F.count(F.lit(1)).alias("same")).filter("same > 1").drop("same")
    kept = each.join(met, ["a", "left", "half"]).groupBy("a", "key", "at", "n").agg(F.max("left").alias("left"), F.max(~F.col("left")).alias("right"))
    reach = half(window, k)
    before, size = F.expr(f"at % {PACKED} div {SMALL}"), F.col("at") % SMALL
    size = F.when(F.col("right"), size).otherwise(F.least(size, before + (k + reach)))
    skip = F.when(F.col("left"), 0).otherwise(F.greatest(before - reach, F.lit(0)))
    place = (start + skip) * PACKED + (before - skip) * SMALL + size - skip
    borders = stored(kept.select("key", place.alias("at"), "a", "n"), "halved")
    return spans, stored(borders.join(borders.groupBy("a").agg(F.count(F.lit(1)).alias("others")), "a"), "borders")


def texts_of(docs: DataFrame, text: str, borders: DataFrame) -> DataFrame:
    """(key, text, at, a, n): one row per text with border contexts, as arrays."""
    held = borders.groupBy("key").agg(F.collect_list(F.struct("at", "a", "n")).alias("x"))
    held = stored(held.select("key", F.col("x.at").alias("at"), F.col("x.a").alias("a"), F.col("x.n").alias("n")), "held")
    long = docs.select(key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return long.join(hint_small(held.select("key")), "key").dropDuplicates(["key"]).join(held, "key")


def extended(texts: DataFrame, units: Callable, window: int) -> DataFrame:
    """(key, span): windows of border contexts that occur elsewhere.

    Every border context is extended both ways, for each of its windows by the units before the anchor and
    the rest after it. Extensions meet under (anchor, units before, hash), so they are counted, not paired.
    """

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text, at, a, n in zip(batch["key"], batch["text"], batch["at"], batch["a"], batch["n"]):
                hashes = mix(Sequence(units(text)).grams(window)).view(np.int64)
                first, before, end = unpacked(at)
                a, n = (np.asarray(x, dtype=np.int64) for x in (a, n))
                for some in (slice(x, x + 512) for x in range(0, len(first), 512)):
                    count = end[some] - first[some] - window + 1
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    start = np.repeat(first[some], count) + step
                    yield pd.DataFrame({
                        "key": [name] * len(start), "start": start, "a": np.repeat(a[some], count),
                        "before": (np.repeat(before[some], count) - step).astype(np.int32), "hash": hashes[start], "n": np.repeat(n[some], count),
                    })

    rows = stored(texts.mapInPandas(reach, "key binary, start bigint, a bigint, before int, hash bigint, n bigint"), "extensions")
    met = rows.groupBy("a", "before", "hash").agg(F.sum("n").alias("all")).filter("all > 1").drop("all")
    return rows.filter("n = 1").join(met, ["a", "before", "hash"]).select("key", (F.col("start") * PACKED + F.col("start") + window).alias("span"))


def covered(spans: list | np.ndarray | None, n: int) -> np.ndarray:
    """Which of `n` units lie in one of the packed spans."""
    if spans is None or len(spans) == 0:
        return np.zeros(n, dtype=bool)
    spans = np.asarray(spans, dtype=np.int64)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.minimum(spans // PACKED, n), 1)
    np.add.at(edges, np.minimum(spans % PACKED, n), -1)
    return np.cumsum(edges[:n]) > 0


def with_spans(docs: DataFrame, id: str, text: str, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of every input row."""
    per_text = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), key(F.col(text)).alias("key")).join(per_text, "key", "left").drop("key")
