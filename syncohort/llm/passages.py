"""Removing word ranges from texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.pandas_udf(T.StringType())
def cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their (start, end) word ranges; null where either is null."""
    out = []
    for text, ranges in zip(texts, spans):
        if text is None or ranges is None:
            out.append(None)
            continue
        places = [m.span() for m in _WORD.finditer(text)]
        kept, at = [], 0
        for span in ranges:
            start, end = int(span["start"]), min(int(span["end"]), len(places))
            if start < end:
                kept.append(text[at : places[start][0]])
                at = max(at, places[end][0] if end < len(places) else len(text))
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out, dtype=object)
