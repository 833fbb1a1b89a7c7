"""Text folding for search."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()

    return texts.map(one)


def fold(text: Column) -> Column:
    """Compatibility decomposition without combining marks, case folded; ASCII texts stay in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_fold(text))
