"""Configuration files in YAML as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def entries(value, path: str = ""):
    """(dotted path, text) of every leaf; list items have their place as a name."""
    if isinstance(value, dict | list):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from entries(v, f"{path}.{k}" if path else str(k))
    else:
        yield path, None if value is None else str(value)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of all leaves of the YAML files under path, one file a row of Spark's reader. A broken file raises.

    Needs a YAML parser on the workers, which is not among this library's requirements.
    """

    def run(batches):
        import yaml

        for batch in batches:
            rows = [(f, k, v) for f, text in zip(batch["file"], batch["value"]) for k, v in entries(yaml.safe_load(text))]
            yield pd.DataFrame(rows, columns=["file", "key", "value"])

    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name AS file", "value")
    return files.mapInPandas(run, "file string, key string, value string")
