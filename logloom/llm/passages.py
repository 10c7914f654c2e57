"""Repeated passages of words, by seed and extend.

Documents are joined on winnowed anchors of words; from each anchor the match is extended both ways,
and what repeats over at least `window` words is removed. Overlapping windows add up to maximal
repeats. See `anchors` for how seeds and extensions meet without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logloom.llm.anchors import covered, extended, shared, split, texts_of, with_spans, word_units
from logloom.llm.registry import query, table
from logloom.llm.words import byte_array, word_bounds

WINDOW, SEED = 35, 10  # words


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the remaining words, joined by one space).

    Removes each word covered by a window of `window` words whose words also start anywhere else, in
    the same document or another. Null and empty texts have no words, texts shorter than a window lose
    none; repeated rows are copies of each other; other columns are ignored; no rows give none.
    """
    found = shared(docs, text, word_units, window, seed)
    spans, borders = split(found, window, seed)
    spans = spans.unionByName(extended(texts_of(docs, text, borders), word_units, window))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, body, held in zip(batch["id"], batch["text"], batch["spans"]):
                data = byte_array(body)
                raw = data.tobytes()
                start, end = word_bounds(data)
                gone = covered(held, len(start))
                kept = b" ".join(raw[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist()))
                out.append((name, len(start), int(gone.sum()), kept.decode()))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    kind = dict(docs.dtypes)[id]
    rows = with_spans(docs, id, text, spans).withColumn("id", F.col("id").cast("string"))  # nulls of numbers do not survive pandas
    return rows.mapInPandas(cut, "id string, n_words bigint, n_removed bigint, kept string").selectExpr(
        f"cast(id as {kind}) as `{id}`", "n_words", "n_removed", "kept"
    )


@query("op3_substring_dedup")
def op3_substring_dedup(spark, folder):
    found = without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
