"""Repeated byte strings, by suffix arrays of shards.

The border contexts of repeats (see `anchors`) are dealt to shards by their anchor, so that two equal
windows always share a shard. A shard's contexts, each ended by a byte below all others, form one
sequence; its suffix array comes from induced sorting: suffixes are classified, the leftmost-smaller
substrings are sorted and named, recursively where names repeat, and the array is induced from them in
linear time. Common prefixes are computed in text order (permuted), by hashes of doubling steps, up to
what the window needs. Neighbours with a common prefix of a whole window form a run; a run that holds two
places marks its windows. An anchor with too many contexts for a shard is counted by extension instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logloom.llm.anchors import PACKED, byte_units, covered, extended, shared, split, texts_of, unpacked, with_spans
from logloom.llm.registry import query, table
from logloom.llm.words import CODES, Sequence, byte_array
from logloom.session import stored

WINDOW, SEED = 200, 32  # bytes
SHARD = 4096  # contexts of a shard; an anchor in it has at most twice as many
WIDE = 1024  # alphabets above this are induced one suffix at a time


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last symbol is the least of all."""
    ends = np.flatnonzero(t[1:] != t[:-1])  # of runs of one symbol, whose suffixes are all alike
    small = np.ones(len(t), dtype=bool)
    small[:-1] = np.repeat(t[ends] < t[ends + 1], np.diff(ends, prepend=-1))
    return small


def _put(sa: np.ndarray, edge: np.ndarray, where: np.ndarray, symbol: np.ndarray, step: int) -> None:
    """Append suffixes to their symbols' buckets, in order, from the edge on in direction `step`."""
    if len(where) == 0:
        return
    order = np.argsort(symbol.astype(np.uint16), kind="stable")  # a radix sort; symbols are below WIDE
    symbol, where = symbol[order], where[order]
    first = np.flatnonzero(np.diff(symbol, prepend=-1))
    count = np.diff(first, append=len(symbol))
    sa[edge[symbol] + step * (np.arange(len(symbol)) - np.repeat(first, count))] = where
    edge[symbol[first]] += step * count


def _induce_by_bucket(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, top: int) -> np.ndarray:
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=top))
    heads = ends - np.bincount(t, minlength=top)
    sa = np.full(n, -1)
    by_symbol = np.split(seeds, np.cumsum(np.bincount(t[seeds], minlength=top))[:-1])
    used = np.flatnonzero(ends > heads)
    edge = heads.copy()
    for c in used.tolist():
        done = heads[c]
        while done < edge[c]:
            now = sa[done:edge[c]]
            done = edge[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            _put(sa, edge, before, t[before], 1)
        before = by_symbol[c][by_symbol[c] > 0] - 1
        _put(sa, edge, before[~small[before]], t[before[~small[before]]], 1)
    larger_ends = edge.copy()  # each bucket's larger suffixes end here
    edge = ends - 1
    for c in used[::-1].tolist():
        done = ends[c] - 1
        while done > edge[c]:
            now = sa[edge[c] + 1:done + 1][::-1]
            done = edge[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            _put(sa, edge, before, t[before], -1)
        now = sa[heads[c]:larger_ends[c]][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        _put(sa, edge, before, t[before], -1)
    sa[0] = n - 1  # the end mark has no successor to induce it
    return sa


def _induce_one_by_one(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, top: int) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t, minlength=top)
    ends = np.cumsum(counts)
    sa = np.full(n, -1)
    last = np.cumsum(np.bincount(t[seeds], minlength=top))
    sa[ends[t[seeds]] - last[t[seeds]] + np.arange(len(seeds))] = seeds
    sa = sa.tolist()
    # The symbol before each suffix where that suffix is to be induced, else -1, as also for empty places (-1).
    before = np.full(n + 1, -1)
    before[1:n] = t[:-1]
    is_small = np.zeros(n + 1, dtype=bool)
    is_small[1:n] = small[:-1]
    edge = (ends - counts).tolist()
    symbol = np.where(is_small, -1, before).tolist()
    for i in sa:
        c = symbol[i]
        if c >= 0:
            sa[edge[c]] = i - 1
            edge[c] += 1
    edge = (ends - 1).tolist()
    symbol = np.where(is_small, before, -1).tolist()
    for i in reversed(sa):
        c = symbol[i]
        if c >= 0:
            sa[edge[c]] = i - 1
            edge[c] -= 1
    sa[0] = n - 1
    return np.array(sa)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers of which the last is less than all others."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    top = int(t.max()) + 1
    small = _smaller(t)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_by_bucket if top <= WIDE else _induce_one_by_one
    # The substrings from one seed to the next are sorted and named.
    named = _names_by_inducing(t, small, seeds, top) if top <= WIDE else _names_by_symbols(t, small, seeds)
    times = np.bincount(named)
    ordered = np.argsort(named) if times.max() == 1 else _by_names(named, times == 1)
    return induce(t, small, seeds[ordered], top)


def _names_by_inducing(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, top: int) -> np.ndarray:
    """Ranks of the seeds' substrings: seeds sorted by first symbols induce the order of whole substrings."""
    n = len(t)
    rough = _induce_by_bucket(t, small, seeds[np.argsort(t[seeds], kind="stable")], top)
    is_seed = np.zeros(n, dtype=bool)
    is_seed[seeds] = True
    ordered = rough[is_seed[rough]]
    end = np.full(n, n)
    end[seeds[:-1]] = seeds[1:] + 1
    sequence = Sequence((t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    hashes = sequence.stretches(ordered, np.minimum(end[ordered], n))
    length = end[ordered] - ordered
    place = np.empty(n, dtype=np.int64)
    place[ordered] = np.cumsum(np.append(False, (hashes[1:] != hashes[:-1]) | (length[1:] != length[:-1])))
    return place[seeds]


def _names_by_symbols(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same for wide alphabets, whose substrings are short: symbol by symbol, as long as some agree. At equal
    symbols a larger suffix comes first, so no substring is a prefix of another."""
    key = 2 * t + small
    last = np.append(seeds[1:], len(t) - 1) - seeds
    rank = np.zeros(len(seeds), dtype=np.int64)
    open_, at = np.arange(len(seeds)), 0
    while len(open_):
        order = open_[np.lexsort((key[seeds[open_] + at], rank[open_]))]
        group, symbol = rank[order], key[seeds[order] + at]
        fresh = np.append(True, group[1:] != group[:-1])
        first = np.flatnonzero(fresh | np.append(True, symbol[1:] != symbol[:-1]))
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        count = np.diff(first, append=len(order))
        rank[order] = group + np.repeat(first - base[first], count)
        open_ = order[np.repeat(count > 1, count) & (last[order] > at)]
        at += 1
    return np.unique(rank, return_inverse=True)[1]


def _by_names(named: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of names. A comparison ends at a name that occurs once, so the
    recursion leaves out such names where one comes before them already."""
    alone = once[named]
    kept = np.append(True, ~alone[:-1]) | ~alone
    kept[-1] = True  # the end mark
    where = np.flatnonzero(kept)
    rank = np.zeros(len(named), dtype=np.int64)
    rank[where[suffix_array(named[where])]] = np.arange(len(where))
    return np.argsort(named * len(named) + rank)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, where: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each position, what its suffix shares with the one sorted before it,
    as far as the next power of two above `most` shows; only for the positions `where`, if given."""
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    here = np.arange(n) if where is None else where
    there, found = before[here], np.zeros(len(here), dtype=np.int64)
    sequence = Sequence(CODES[t] if t.max() < len(CODES) else t.astype(np.uint64) + np.uint64(1))
    step = 1 << (most.bit_length() - 1)
    while step:
        fits = np.flatnonzero(np.maximum(here, there) + found + step <= n)
        a, b = here[fits] + found[fits], there[fits] + found[fits]
        found[fits[sequence.stretches(a, a + step) == sequence.stretches(b, b + step)]] += step
        step >>= 1
    shared_ = np.zeros(n, dtype=np.int64)
    shared_[here] = found
    return shared_


def repeated_windows(parts: list[bytes], place: np.ndarray, copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part the offsets at which a repeated window starts. `place`: rows of numbers that tell a
    part's first byte among all texts, (text, offset); `copies`: how often the part occurs."""
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    start = np.cumsum(size + 1) - size - 1
    # Bytes are ranked from 2 on; 1 ends a part, 0 ends the shard.
    t = np.zeros(len(data) + 1, dtype=np.int64)
    t[:-1] = data
    t[:-1] += 2
    t[start + size] = 1
    sa = suffix_array(t)
    part = np.repeat(np.arange(len(parts)), size + 1)  # of each position but the last
    offset = np.arange(len(data)) - start[part]
    whole = np.append(offset + window <= size[part], False)
    # A whole window shares less than itself with a suffix whose part ends earlier, so others need no prefix.
    shared_ = common_prefixes(t, sa, window, np.flatnonzero(whole))
    run = np.cumsum(shared_[sa] < window)
    run, sa = run[whole[sa]], sa[whole[sa]]
    part, offset = part[sa], offset[sa]
    if not len(sa):
        return [sa] * len(parts)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    text, at = place[part, 0], place[part, 1] + offset
    where = text * PACKED + at
    many = (np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)) | (np.maximum.reduceat(copies[part], first) > 1)
    hit = np.repeat(many, np.diff(first, append=len(run)))
    order = np.lexsort((offset[hit], part[hit]))
    return np.split(offset[hit][order], np.cumsum(np.bincount(part[hit], minlength=len(parts)))[:-1])


def _contexts(texts: DataFrame) -> DataFrame:
    """(key, low, a, n, part): the bytes around every border anchor, from byte `low` of the text on."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text, at, a, n in zip(batch["key"], batch["text"], batch["at"], batch["a"], batch["n"]):
                raw = text.encode()
                low, _, high = unpacked(at)
                for some in range(0, len(low), 10_000):
                    lows, highs = low[some:some + 10_000].tolist(), high[some:some + 10_000].tolist()
                    yield pd.DataFrame({
                        "key": [name] * len(lows), "low": lows, "a": a[some:some + 10_000], "n": n[some:some + 10_000],
                        "part": [raw[x:y] for x, y in zip(lows, highs)],
                    })

    return texts.mapInPandas(take, "key binary, low bigint, a bigint, n bigint, part binary")


def _in_shards(contexts: DataFrame, window: int) -> DataFrame:
    """(key, span) of the repeated windows of contexts that occur once."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        numbers = {}
        text = np.array([numbers.setdefault(k, len(numbers)) for k in shard["key"]], dtype=np.int64)
        low, copies = shard["low"].to_numpy(), shard["n"].to_numpy()
        found = repeated_windows(list(shard["part"]), np.stack([text, low], axis=1), copies, window)
        out = []
        for name, base, n, offset in zip(shard["key"], low.tolist(), copies.tolist(), found):
            if n == 1 and len(offset):
                cuts = np.flatnonzero(np.diff(offset) > window)
                first, last = offset[np.append(0, cuts + 1)], offset[np.append(cuts, len(offset) - 1)]
                out += [(name, (base + a) * PACKED + base + b + window) for a, b in zip(first.tolist(), last.tolist())]
        return pd.DataFrame(out, columns=["key", "span"])

    return contexts.groupBy("shard").applyInPandas(search, "key binary, span bigint")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    Removes each byte covered by a string of `window` bytes that also starts anywhere else, in the same
    document or another; judged on the input as UTF-8. What is left may not be UTF-8, so it is binary.
    Null and empty texts have no bytes, texts shorter than a window lose none; repeated rows are copies
    of each other; other columns are ignored; no rows give none.
    """
    found = shared(docs, text, byte_units, window, seed)
    spans, borders = split(found, window, seed)
    few = borders.filter(F.col("others") <= 2 * shard)
    parts = stored(_contexts(texts_of(docs, text, few)), "parts")
    shards = max(1, -(-parts.count() // shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).repartition(shards, "shard")
    spans = spans.unionByName(_in_shards(dealt, window)).unionByName(
        extended(texts_of(docs, text, borders.filter(F.col("others") > 2 * shard)), byte_units, window)
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, body, held in zip(batch["id"], batch["text"], batch["spans"]):
                data = byte_array(body)
                gone = covered(held, len(data))
                out.append((name, len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), data[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(docs.dtypes)[id]
    rows = with_spans(docs, id, text, spans).withColumn("id", F.col("id").cast("string"))  # nulls of numbers do not survive pandas
    return rows.mapInPandas(cut, "id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").selectExpr(
        f"cast(id as {kind}) as `{id}`", "n_bytes", "n_removed", "n_spans", "kept"
    )


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, folder):
    found = without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
