"""YAML files as JSON texts, so that Spark's own JSON functions read them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import yaml
except ImportError:  # without the library YAML files hold nothing that can be read
    yaml = None


def _json(text: str | None) -> str | None:
    try:
        return json.dumps(yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)), default=str)
    except (yaml.YAMLError, RecursionError, ValueError):
        return None


def yaml_as_json(files: DataFrame) -> DataFrame:
    """``path, text`` of ``files(path, text)`` with each text as JSON; a text that is no YAML becomes null."""
    if yaml is None:
        return files.select("path", "text").where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_json(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["path", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, text string")
