"""Hybrid queries as text: HYBRID {...}, a JSON object of what to search, filter and page."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fp
from tessera.operators import search

KEYS = {"similar", "least", "label", "range", "version", "offset", "limit"}


def parsed(text: str) -> dict:
    found = re.fullmatch(r"\s*HYBRID\s*(\{.*\})\s*;?\s*", text, re.DOTALL | re.IGNORECASE)
    if not found:
        raise ValueError("expected HYBRID {...}")
    out = json.loads(found[1])
    if unknown := set(out) - KEYS:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    return out


def run(df: DataFrame, text: str, key: str, words: str, label: str, query_words, width: int = fp.WIDTH) -> DataFrame:
    """Rows by similarity to a row's signature (`similar`: its key; query_words(key) gives the words), at least `least`,
    with a label substring, a range [column, low, high], the version as a stamp, and a page."""
    asked = parsed(text)
    score: Column = F.lit(1.0)
    if "similar" in asked:
        score = fp.similarity(F.col(words), query_words(asked["similar"]), width)
        df = df.where(score >= asked.get("least", 0.0))
    rows = search.hybrid(
        df, score, key, label=label, contains=asked.get("label"), between=tuple(asked["range"]) if "range" in asked else None,
        offset=asked.get("offset", 0), limit=asked.get("limit", 10),
    )
    return rows.withColumn("version", F.lit(asked.get("version", 0)).cast("long"))
