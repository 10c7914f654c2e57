"""Token counts by an exact length histogram.

Documents are encoded once and counted by encoded length. Every question about a context limit is
then a sum over the histogram: documents and tokens at or above a length are suffix sums, and the
total under a limit is what shorter documents hold plus the limit for each of the others.
"""

from __future__ import annotations

import base64
import pathlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.mixing import _running
from logloom.llm.registry import query, table
from logloom.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public tokenizer cuts a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CELL = 1024  # lengths that one window sums


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) of every row; null and empty texts have 0. The vocabulary file (1 MB, the same for
    any corpus) is read by the driver alone and sent along, so executors need no copy of it."""
    ranks = docs.sparkSession.sparkContext.broadcast(pathlib.Path(vocabulary).read_bytes())

    @F.pandas_udf(T.LongType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks.value)
        for texts in batches:
            yield pd.Series(np.fromiter((len(encoding.encode_ordinary(t)) if t else 0 for t in texts), dtype=np.int64, count=len(texts)))

    return docs.select(encoded(F.col(text)).alias("n_tokens"))


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per length that occurs."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def answers(bins: DataFrame) -> DataFrame:
    """One row per length L of the histogram, read as a context limit.

    n_docs have this length, docs_from and tokens_from are suffix sums (documents of at least L tokens
    and their tokens), quantile is the share of documents with at most L tokens, truncated_tokens the
    total when every document is cut to L tokens. Any other limit lies between two rows: the suffix
    sums of the next longer row hold for it.
    """
    rows = bins.withColumn("all", F.lit(0))
    cell = F.expr(f"n_tokens div {CELL}")
    rows = _running(rows, ["all"], cell, F.col("n_docs"), ["n_tokens"], "docs_under")
    rows = _running(rows, ["all"], cell, F.col("n_docs") * F.col("n_tokens"), ["n_tokens"], "tokens_under")
    whole = bins.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"))
    return rows.crossJoin(F.broadcast(whole)).select(  # one row
        "n_tokens", "n_docs", (F.col("total_docs") - F.col("docs_under")).alias("docs_from"),
        (F.col("total_tokens") - F.col("tokens_under")).alias("tokens_from"),
        ((F.col("docs_under") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        (F.col("tokens_under") + F.col("n_tokens") * (F.col("total_docs") - F.col("docs_under"))).alias("truncated_tokens"),
        "total_docs", "total_tokens",
    )


def under_limits(bins: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total_docs, docs_over, truncated_tokens) for any limits, from the histogram alone."""
    spark = bins.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "context_limit bigint"))
    return bins.join(asked, F.lit(True)).groupBy("context_limit").agg(  # lengths x the limits given
        F.sum("n_docs").alias("total_docs"), F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


@query("op10_token_counts")
def op10_token_counts(spark, folder):
    return answers(stored(histogram(lengths(table(spark, folder, "documents"))), "histogram"))
