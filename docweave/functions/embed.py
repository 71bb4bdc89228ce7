"""Deterministic embeddings, and similarities that need Python, over Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text as tx


def hash_vector(text: Column, dim: int = 64) -> Column:
    """Bytes of a chain of SHA-256 digests, centred and of norm 1: equal texts agree, others are nearly orthogonal.

    Fixed values: each link digests the chain so far and the text's own digest; a byte b counts b / 255 - 0.5.
    """
    seed = F.unhex(F.sha2(text, 256))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(-(-dim // 32))), F.unhex(F.lit("")), lambda c, _: F.concat(c, F.unhex(F.sha2(F.concat(c, seed), 256))))

    def centred(digits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0) - F.lit(0.5))

    return F.when(text.isNotNull(), tx.bound(tx.bound(F.hex(chain), centred), lambda v: tx.bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))))


def ratio(a: str | None, b: str | None) -> float:
    """Matching-blocks ratio of lower-cased, white-space-collapsed texts: 1 if equal, 0 if one is empty."""
    a, b = (" ".join((x or "").lower().split()) for x in (a, b))
    if a == b:
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(ratio(x, y), 6) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)
