"""Vectors and hashes as column expressions, and the hashing embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def rrf_score(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (k + rank)


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """Seconds to wait before an attempt: doubled each time up to a cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def metric_value(x: Column) -> Column:
    """A number, or the quotient of "a/b"; null where it has none."""
    a, b = F.split_part(x, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(x, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(x.contains("/"), F.try_divide(a, b)).otherwise(x.try_cast("double"))


def _features(text: str) -> list[str]:
    words = text.lower().split()
    return words + [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]


def _place(feature: str) -> tuple[int, float]:
    h = hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(h[:4], "big"), 1.0 if h[4] & 1 else -1.0


def hash_embeddings(texts, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing of words and word triples, scaled to unit length: a row a text.

    Every distinct feature of the texts is hashed once.
    """
    known: dict[str, int] = {}
    rows, features = [], []
    for k, text in enumerate(texts):
        own = _features(text or "")
        rows.append(np.full(len(own), k))
        features += [known.setdefault(f, len(known)) for f in own]
    out = np.zeros((len(texts), dimensions))
    if features:
        places = np.array([_place(f) for f in known])
        at = places[features]
        np.add.at(out, (np.concatenate(rows), at[:, 0].astype(np.int64) % dimensions), at[:, 1])
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out.astype(np.float32) / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def hash_embedding(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    return hash_embeddings([text], dimensions)[0]


#: Texts whose features are held at once.
EMBED = 500


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashing_embedder(texts: pd.Series) -> pd.Series:
    rows = [row for at in range(0, len(texts), EMBED) for row in hash_embeddings(texts.iloc[at : at + EMBED].tolist())]
    return pd.Series(rows, index=texts.index, dtype=object)
