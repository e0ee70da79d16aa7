"""Line deduplication: runs of lines that occur earlier go.  See ``repeats``.

A run is ``length`` lines or more, or one line of ``alone`` words or more.  Fingerprints are line hashes: every window
of ``length`` lines selects its smallest one, so any run that long shares a fingerprint with each of its copies, and a
line that may go alone is its own.  Short lines (braces, labels, numbers) go with a neighbour only.  Lines without a
word are neither counted nor removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import without_repeats

#: Lines of the shortest repeated run, and words of a line that is a run by itself.
LENGTH, ALONE = 2, 5


def line_deduplicated(docs: DataFrame, length: int = LENGTH, alone: int | None = ALONE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return without_repeats(docs, "lines", length, 1, alone, id_col, text_col)
