"""Source divergence audit over the matrix of groups (a source within a language) and terms.

Tasks count terms of their own documents before anything is shuffled. A language's kept terms are dealt by hash to
blocks of about `COLUMNS` columns, its sources to blocks of `ROWS` rows; the cells of a row and a column block
are one quadrant of the matrix, and a quadrant without cells is no row anywhere. Inside a quadrant the quadtree
goes on: its levels say which quarters hold a cell. For pairs of groups the trees of both rows are
walked together; where both are all zero the walk ends, as the price of such cells depends on the two groups alone
and is added once, for all of a pair's terms. Only cells that one of the two has are computed, as what
they differ by from that price.

All arithmetic is on integers: shares in units of 10^-9, rounded down.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.registry import query, table
from logloom.session import hint_small, stored

LEAST_DOCS = 3  # documents of a language that make a term kept
TOP = 200  # terms reported per group
ROWS, COLUMNS = 64, 1024  # of a quadrant that one task walks
HELD = 500_000  # terms that a task counts before it hands them on
STEPS = 3  # shares are multiplied by 1000 so many times

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of every term by language and source, of a task's documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():  # a group's row without a term says that the group occurs
        for (lang, source), (n, docs) in held.items():
            yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *(t.decode() for t in n)], "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)]})

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = Counter(_TERM.findall(text.encode().translate(_LOWER)))
            size -= len(n)
            n.update(terms)
            docs.update(terms.keys())
            size += len(n)
            if size > most:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * count / whole) for count <= whole; each step stays within 64 bits up to 9 * 10^15."""
    out, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(STEPS):
        out, rest = out * 1000 + _div(rest * 1000, whole), rest * 1000 % whole
    return out + 1


def _shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(STEPS):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def _levels(held: np.ndarray) -> list[np.ndarray]:
    """The quadtree of a matrix with power-of-two sides: from the root down, which quarters hold a cell."""
    out = [held]
    while out[-1].size > 1:
        now = out[-1]
        if now.shape[0] > 1:
            now = now[::2] | now[1::2]
        if now.shape[1] > 1:
            now = now[:, ::2] | now[:, 1::2]
        out.append(now)
    return out[::-1]


def _walk(one: list[np.ndarray], two: list[np.ndarray], n_one: int, n_two: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `one`, rows of `two` and columns of all cells that either row of a pair has."""
    a = b = c = np.zeros(1, dtype=np.int64)
    for depth, (x, y) in enumerate(zip(one, two)):
        if depth:
            tall, wide = x.shape[0] > one[depth - 1].shape[0], x.shape[1] > one[depth - 1].shape[1]
            for along, grows in enumerate((tall, tall, wide)):
                if grows:
                    a, b, c = (np.concatenate([2 * v, 2 * v + 1]) if k == along else np.concatenate([v, v]) for k, v in enumerate((a, b, c)))
        height = one[-1].shape[0] // x.shape[0]
        on = (x[a, c] | y[b, c]) & (a * height < n_one) & (b * height < n_two)
        a, b, c = a[on], b[on], c[on]
    return a, b, c


def _priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _quadrant(rows, columns, counts, wholes, high: int, wide: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Shares of every cell, the quadtree, and the share of cells without a count, of one quadrant."""
    cells = np.zeros((high, wide), dtype=np.int64)
    cells[rows, columns] = counts
    whole = np.ones(high, dtype=np.int64)
    whole[:len(wholes)] = wholes
    return _shares(cells + 1, whole[:, None]), _levels(cells > 0), _shares(np.ones(high, dtype=np.int64), whole)


def _between(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """What the cells of pairs of quadrants add to the prices of their pairs of groups."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def rows():
        for (lang, low, high), total in sums.items():
            a, b = np.nonzero(total)
            yield pd.DataFrame({"lang": lang, "a": low * size + a, "b": high * size + b, "value": total[a, b]})

    for batch in batches:
        for r in batch.itertuples(index=False):
            wide = 1 << int(max(r.c1.max(initial=0), r.c2.max(initial=0))).bit_length()
            p, tree, p0 = _quadrant(r.r1, r.c1, r.n1, r.w1, size, wide)
            q, other, q0 = _quadrant(r.r2, r.c2, r.n2, r.w2, size, wide)
            a, b, c = _walk(tree, other, len(r.w1), len(r.w2))
            for low, high, x, y, i, j, x0, y0 in ((r.low, r.high, p, q, a, b, p0, q0), (r.high, r.low, q, p, b, a, q0, p0)):
                total = sums.setdefault((r.lang, low, high), np.zeros((size, size), dtype=np.int64))
                np.add.at(total, (i, j), _priced(x[i, c], y[j, c]) - _priced(x0[i], y0[j]))
                if r.low == r.high:
                    break
        if len(sums) > 1000:
            yield from rows()
            sums = {}
    yield from rows()


def _pairs(cells: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """(lang, a, b, value): for numbered groups a and b of a language the sum over the terms that either has."""
    quadrants = stored(
        cells.groupBy("lang", "block", F.expr(f"row div {size}").alias("high"))
        .agg(F.collect_list(F.struct((F.col("row") % size).cast("int").alias("r"), "column", "n")).alias("x"))
        .select("lang", "block", "high", F.col("x.r").alias("r"), F.col("x.column").alias("c"), F.col("x.n").alias("n")), "quadrants",
    )
    facts = groups.groupBy("lang", F.expr(f"row div {size}").alias("high")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "whole"))), lambda x: x["whole"]).alias("w"))
    facts = stored(facts, "group-blocks")
    named = lambda df, k, **to: df.select("lang", *(c for c in df.columns if c not in ("lang", "high", "r", "c", "n", "w")), *(F.col(c).alias(to.get(c, f"{c}{k}")) for c in df.columns if c in ("high", "r", "c", "n", "w")))
    blocks = facts.select("lang", F.col("high").alias("other"))
    met = quadrants.select("lang", "block", "high").join(blocks, "lang").select(
        "lang", "block", F.least("high", "other").alias("low"), F.greatest("high", "other").alias("high")
    ).distinct()
    sides = met.join(named(quadrants, 1, high="low"), ["lang", "block", "low"], "left").join(named(quadrants, 2, high="high"), ["lang", "block", "high"], "left")
    sides = sides.join(hint_small(named(facts, 1, high="low")), ["lang", "low"]).join(hint_small(named(facts, 2, high="high")), ["lang", "high"])
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    tasks = sides.select("lang", "low", "high", *(none(f"{c}{k}", kind) for c, kind in (("r", "int"), ("c", "int"), ("n", "bigint")) for k in (1, 2)), "w1", "w2")
    found = tasks.mapInPandas(lambda batches: _between(batches, size), "lang string, a bigint, b bigint, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
          rows: int = ROWS, columns: int = COLUMNS, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, the divergence of each group from every other source of
    its language; part `term`, the `top` terms that the group has more of than its language.

    Null texts, languages and sources are empty strings. Every group that occurs is reported, one without kept terms too;
    a language without kept terms has pairs of value 0. Repeated rows are documents of their own; ties of values go
    by item; other columns are ignored; no rows give none. `rows` (a power of two), `columns` and `held` say how the
    work is cut and change no result.
    """
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = stored(plain.mapInPandas(lambda batches: _counted(batches, held), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "all"), "kept")
    langs = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("words")), "langs")
    blocks = F.ceil(F.col("terms") / columns).cast("long")
    placed = kept.join(hint_small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    placed = placed.withColumn("column", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    cells = stored(counted.filter("term is not null").join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "all", "terms", "words", "block", "column"), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counted.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(hint_small(langs), "lang", "left")
    row = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    terms = F.coalesce("terms", F.lit(0))
    groups = stored(groups.select("lang", "source", row.alias("row"), terms.alias("terms"), F.greatest(F.coalesce("size", F.lit(0)) + terms, F.lit(1)).alias("whole")), "groups")
    cells = cells.join(hint_small(groups.select("lang", "source", "row", "whole")), ["lang", "source"])

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    price = lambda p, q: _div((p - q) * (p - q), q)
    p, q = F.col("p"), F.col("q")
    shares = cells.select("lang", "source", F.col("term").alias("item"), share(F.col("n") + 1, F.col("whole")).alias("p"), share(F.col("all") + 1, F.col("words") + F.col("terms")).alias("q"))
    by_term = ranked(shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", price(p, q).alias("value"))).filter(F.col("rank") <= top)

    zero = groups.withColumn("p", share(F.lit(1), F.col("whole")))
    one = zero.select("lang", "source", F.col("row").alias("a"), "terms", "p")
    two = zero.select("lang", F.col("source").alias("item"), F.col("row").alias("b"), F.col("p").alias("q"))
    pairs = one.join(two, "lang").filter("a <> b").join(_pairs(cells, groups, rows), ["lang", "a", "b"], "left")
    value = F.col("terms") * price(p, q) + F.coalesce("value", F.lit(0))
    by_pair = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))
    return by_pair.unionByName(by_term)


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (
  SELECT x.lang, x.source, coalesce(s.n, 0) + coalesce(v.v, 0) AS whole FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source LEFT JOIN v ON v.lang = x.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // g.whole AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY x.lang, x.source, y.source),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT
  FROM p JOIN (SELECT k.lang, k.term, 1 + 1000000000 * (k.n + 1)::HUGEINT // (v.n + v.v) AS q FROM k JOIN v ON v.lang = k.lang) q ON q.lang = p.lang AND q.term = p.term
  WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op11_source_divergence", _sql())
def op11_source_divergence(spark, folder):
    return audit(table(spark, folder, "documents"))
