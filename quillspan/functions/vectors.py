"""Embeddings without a model: a deterministic hashing encoder, and a registry for injected ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSION = 64


def hash_embedding(text: str | None, dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of hashed words, of length 1 (all zeros for a text without words)."""
    v = np.zeros(dimension, np.float32)
    for word in (text or "").lower().split():
        h = xxhash.xxh64_intdigest(word)
        v[h % dimension] += 1 if h >> 63 else -1
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm else v


def embed(text: Column, encoder: Callable[[str | None], np.ndarray] = hash_embedding) -> Column:
    """An embedding column; the encoder is a picklable function from text to vector, called for Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encoder(t).tolist())

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def latex_prompt(latex: Column) -> Column:
    return F.concat(F.lit("Mathematical expression: "), latex)
