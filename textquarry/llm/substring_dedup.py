"""Substring deduplication: words in runs of at least ``length`` that occur earlier go.  See ``repeats``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import without_repeats

#: Words of the shortest repeat, and of an anchor.
LENGTH, GRAM = 20, 6


def substring_deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return without_repeats(docs, "words", length, gram, None, id_col, text_col)
