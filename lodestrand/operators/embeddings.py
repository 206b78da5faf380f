"""Vectors of texts: deterministic embedders, and a vector table that is filled by and by.

An embedder is a pandas function from a text's terms, or from the text, to a vector, so that a
model can stand in its place. Both kinds here need no model: one hashes terms, so that texts with
common terms lie close together, the other draws a random direction per text.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import terms

SIZE = 64


@lru_cache(maxsize=1 << 17)
def _place(term: str) -> tuple[int, int]:
    """The component that a term adds to, and its sign, from the term's MD5."""
    digest = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:4], 16) % SIZE, 1 if digest[4] < "8" else -1


def _unit(vector: np.ndarray) -> list[float]:
    norm = float(np.sqrt((vector * vector).sum()))
    return (vector / norm if norm else vector).tolist()


def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        out = []
        for words in batch:
            vector = np.zeros(SIZE)
            for j, sign in map(_place, words):
                vector[j] += sign
            out.append(_unit(vector))
        yield pd.Series(out, index=batch.index)


def _seeded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        out = []
        for text in batch:
            rnd = random.Random(zlib.crc32((text or "").encode()))
            out.append(_unit(np.array([rnd.gauss(0, 1) for _ in range(SIZE)])))
        yield pd.Series(out, index=batch.index)


def hashed(*texts: str) -> Column:
    """Unit vectors from the terms of some columns; zero for texts without terms."""
    return F.pandas_udf(_hashed, "array<double>")(F.concat(*[terms(t) for t in texts]))


def seeded(text: Column | str) -> Column:
    """Unit vectors drawn at random, with the CRC-32 of the text as seed; NULL counts as empty."""
    return F.pandas_udf(_seeded, "array<double>")(F.col(text) if isinstance(text, str) else text)


def checked(vectors: DataFrame, size: int, v: str = "v") -> DataFrame:
    """The same rows; a vector of another size than `size` fails the job."""
    wrong = F.raise_error(F.format_string("vector of %d components, not %d", F.size(v), F.lit(size))).cast("array<double>")
    return vectors.withColumn(v, F.when(F.size(v) == size, F.col(v)).otherwise(wrong))
