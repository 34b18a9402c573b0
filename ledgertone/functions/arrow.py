"""Ratios of how alike two names are."""

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two names, as the standard library defines it."""
    matcher = difflib.SequenceMatcher()
    return pd.Series([_ratio(matcher, x, y) for x, y in zip(a, b)], dtype="float64")


def _ratio(matcher, x, y):
    matcher.set_seqs(x, y)
    return matcher.ratio()


def levenshtein_ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))
