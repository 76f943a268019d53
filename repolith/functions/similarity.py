"""Ratcliff/Obershelp similarity, which no built-in function gives (an edit distance ranks differently)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("double")
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2 * matching characters / all characters, of lower-cased texts; null if either is null."""
    out = []
    for a, b in zip(left, right):
        out.append(None if a is None or b is None else SequenceMatcher(None, b.lower(), a.lower()).ratio())
    return pd.Series(out, dtype="float64")
