"""A content-addressed store of raw payloads and hashes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256 and n_bytes of the content."""
    return payloads.withColumns({"sha256": F.sha2(F.col(content).cast("binary"), 256), "n_bytes": F.octet_length(content).cast("long")})


def new_contents(retrieved: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of the retrieved payloads (source, sha256, retrieved_at, ...) those that the source's manifest doesn't hold,
    the earliest of each content."""
    first = retrieved.groupBy("source", "sha256").agg(F.min("retrieved_at").alias("retrieved_at"), F.count(F.lit(1)).alias("n_retrievals"))
    return first.join(manifest.select("source", "sha256"), ["source", "sha256"], "left_anti")


class Store:
    """Contents and a log of retrievals under one path; contents are only ever added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.contents, self.log = spark, f"{path}/contents", f"{path}/log"

    def _read(self, path: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._read(self.contents, "source string, sha256 string, content string, retrieved_at timestamp")

    def retrievals(self) -> DataFrame:
        return self._read(self.log, "source string, sha256 string, retrieved_at timestamp")

    def add(self, retrieved: DataFrame) -> None:
        """retrieved: source, content, retrieved_at. New contents are stored, every retrieval is logged."""
        rows = hashed(retrieved)
        fresh = new_contents(rows, self.manifest()).select("source", "sha256")
        one = rows.groupBy("source", "sha256").agg(F.min_by("content", "retrieved_at").alias("content"), F.min("retrieved_at").alias("retrieved_at"))
        one.join(fresh, ["source", "sha256"]).select("source", "sha256", "content", "retrieved_at").write.mode("append").parquet(self.contents)
        rows.select("source", "sha256", "retrieved_at").write.mode("append").parquet(self.log)
