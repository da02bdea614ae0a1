"""MinHash signatures of token sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 64
#: FNV-1a's offset and prime, and the two multipliers of the finisher.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
FINISH = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
EMPTY = (1 << 32) - 1


def token_hashes(token: str) -> np.ndarray:
    """The 32-bit hash of a token in each slot; all slots at once."""
    with np.errstate(over="ignore"):
        h = np.uint64(OFFSET) ^ (np.arange(SLOTS, dtype=np.uint64) * np.uint64(PRIME))
        for byte in token.encode():
            h = (h ^ np.uint64(byte)) * np.uint64(PRIME)
        for shift, factor in zip((30, 27), FINISH, strict=True):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return (h ^ (h >> np.uint64(31))) & np.uint64(EMPTY)


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature(tokens: pd.Series) -> pd.Series:
    """The least hash of each slot over all tokens; all ones for no tokens."""
    known: dict[str, np.ndarray] = {}

    def least(own) -> np.ndarray:
        rows = []
        for t in own if own is not None else ():
            if t:
                if t not in known:
                    known[t] = token_hashes(t)
                rows.append(known[t])
        return np.min(rows, axis=0).astype(np.int64) if rows else np.full(SLOTS, EMPTY, np.int64)

    return tokens.map(least)


def agreement(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SLOTS))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def is_empty(a: Column) -> Column:
    return F.forall(a, lambda x: x == EMPTY)
