"""Vector expressions and the default text embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

EMBEDDING_DIM = 384
NORM_FLOOR = 1e-9
CHUNK_CHARS = 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero.

    The outer one-element transform holds the length, which is thus computed once per vector
    and not once per element.
    """
    size = F.array(F.greatest(norm(v), F.lit(NORM_FLOOR)))
    return F.get(F.transform(size, lambda s: F.transform(v, lambda x: x.cast("double") / s)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(NORM_FLOOR))


def _slot(word: str, dim: int) -> tuple[int, float]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % dim, 1.0 if int(digest[8:10], 16) % 2 == 0 else -1.0


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of vectors."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def hash_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Signed hashed bag of keywords over the whole text, scaled to length 1.

    The default text vector; a model of the user's own goes in as another pandas_udf with
    the same signature (see `embedder`).
    """

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        coded = pc.fill_null(texts, "").dictionary_encode()  # a text that a batch holds often is embedded once
        distinct = coded.dictionary.to_pandas()
        # Half a million characters at a time, however long the single texts are.
        part = (distinct.str.len().cumsum() // CHUNK_CHARS).to_numpy()
        out = np.concatenate([np.zeros((0, dim), dtype=np.float32), *(_bags(some, dim) for _, some in distinct.groupby(part))])
        return lists(out[coded.indices.to_numpy()])

    return embed(text)


def _bags(texts: pd.Series, dim: int) -> np.ndarray:
    words = [re.findall(r"[a-z0-9]+", t.lower()) for t in texts]
    sizes = [len(w) for w in words]
    codes, distinct = pd.factorize(np.array([w for row in words for w in row], dtype=object))
    slots = np.array([_slot(w, dim) for w in distinct]).reshape(-1, 2)
    cells = np.repeat(np.arange(len(texts)), sizes) * dim + slots[codes, 0].astype(np.int64)
    sums = np.bincount(cells, weights=slots[codes, 1], minlength=len(texts) * dim).reshape(len(texts), dim)
    lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.maximum(lengths, NORM_FLOOR)).astype(np.float32)


def embedder(encode):
    """Text column -> vector column from a batch encoder `list[str] -> 2-d array`."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float32)
        sizes = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), NORM_FLOOR)
        return pd.Series(list(matrix / sizes))

    return embed
