"""Text label preparation for readers: it needs Unicode decomposition, which has no built-in function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F


def prepare(label: str | None, charset: str, most: int) -> str | None:
    """Without white space, decomposed to ASCII, folded to the charset's case, other characters dropped; null if too long or empty."""
    if label is None:
        return None
    s = unicodedata.normalize("NFKD", "".join(label.split())).encode("ascii", "ignore").decode()
    if len(s) > most:
        return None
    s = s.lower() if charset == charset.lower() else s.upper() if charset == charset.upper() else s
    return "".join(c for c in s if c in charset) or None


def prepared(charset: str, most: int):
    """The same as a vectorised function of a string column; a text that repeats is prepared once a batch."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map({x: prepare(x, charset, most) for x in s.dropna().unique()}).astype(object)

    return f.asNondeterministic()  # a filter on its null would compute it once more
