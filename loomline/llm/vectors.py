"""What the vector operators share: which vectors take part, and random rotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True of vectors without null or non-finite components that aren't zero; false of a null vector."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def rotation(rng: np.random.Generator, n: int) -> np.ndarray:
    """A uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(rng.standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def bits(x: np.ndarray) -> np.ndarray:
    """Signs of the columns, packed in 64-bit words."""
    packed = np.packbits(x > 0, axis=1, bitorder="little")
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view("<u8")
