"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def workdir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only in local mode, where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{workdir(spark)}/{what}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def intermediate(spark: SparkSession):
    """Deletes at its end the tables that cut() wrote in it, but for those whose DataFrame is put into the list it gives."""
    made: list[str] = []
    kept: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.remove(made)
    left = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()}
    for path in made:
        if path.rpartition("/")[2] not in left:
            remove(spark, path)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    for made in _SCOPES:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def few_rows(df: DataFrame, most: int) -> DataFrame:
    """The table, to be broadcast if it has at most so many rows; df should be cheap to count, as written tables are."""
    return F.broadcast(df) if df.count() <= most else df


def words_of(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(n: int, each: int) -> int:
    return max(1, math.ceil(n / each))


def bucket_slices(sorted_hashes: np.ndarray, buckets: int) -> dict[int, tuple[int, int]]:
    """bucket -> (start, end) of the sorted 64-bit hashes in it, for the buckets that have some. A hash h is in bucket
    floor(h * buckets / 2^64), with at most 2^31 buckets; the time depends on the hashes alone."""
    n, half = np.uint64(buckets), np.uint64(32)
    of = ((sorted_hashes >> half) * n + ((sorted_hashes & np.uint64(0xFFFFFFFF)) * n >> half)) >> half
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return {b: (i, j) for b, i, j in zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)])}


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
