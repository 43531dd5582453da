"""Name functions that Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility composed form; null stays null."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))
