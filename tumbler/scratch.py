"""Tables written in between: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only in local mode, where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write the table and read it back."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
