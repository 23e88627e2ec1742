"""Chronological exploration/holdout splits, seals, and the firewalled layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tumbler.operators.history import running
from tumbler.operators.merkle import seal


def chronological(draws: DataFrame, by: str, t: str, draw_id: str, fraction: float = 0.2) -> DataFrame:
    """Adds split: the last ceil(fraction * n) of each group by (t, draw_id) are holdout, the rest exploration."""
    n = draws.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    numbered = running(draws, [by], F.date_trunc("day", t), [t, draw_id], {"__r": F.lit(1)}).join(n, by)
    kept = F.col("__n") - F.ceil(F.lit(fraction) * F.col("__n"))
    return numbered.withColumn("split", F.when(F.col("__r") <= kept, "exploration").otherwise("holdout")).drop("__n", "__r")


def summary(split: DataFrame, by: str, t: str) -> DataFrame:
    first = lambda s, f: f(F.when(F.col("split") == s, F.col(t)))
    return split.groupBy(by).agg(F.count_if(F.col("split") == "exploration").alias("n_exploration"), F.count_if(F.col("split") == "holdout").alias("n_holdout"), first("exploration", F.max).alias("last_exploration"), first("holdout", F.min).alias("first_holdout"))


def corrected(frozen: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """A frozen split after some draws lost eligibility: key, split, state (kept or invalidated). No row changes sides."""
    ok = eligible.select(key).distinct().withColumn("__ok", F.lit(True))
    return frozen.join(ok, key, "left").withColumn("state", F.when(F.col("__ok"), "kept").otherwise("invalidated")).drop("__ok")


def manifest(split: DataFrame, by: str, t: str, key: str) -> DataFrame:
    """The summary of a split with a seal of each group's holdout ids: what is written down before anything is looked at."""
    sealed = seal(split.where("split = 'holdout'"), [key], [by]).select(by, F.col("seal").alias("holdout_seal"))
    return summary(split, by, t).join(sealed, by, "left")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids. Running it raises if an id has no row."""
    have = df.withColumn("__there", F.lit(True))
    rows = ids.select(key).distinct().join(have, key, "left")
    missing = F.raise_error(F.concat(F.lit("no row for id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.col("__there"), F.lit(True)).otherwise(missing)).drop("__there").select(*df.columns)


def write_firewalled(df: DataFrame, path: str) -> None:
    """Outcomes in a layout that is partitioned by split, so a reader of one side never opens the other's files."""
    df.write.partitionBy("split").parquet(path)


def read_exploration(spark: SparkSession, path: str) -> DataFrame:
    """The exploration side only: its folder is opened by name, so no plan over it can reach the other side's files.

    A semi join would not do: the optimizer may move later filters, casts of holdout values among them, below it.
    """
    df = spark.read.parquet(f"{path}/split=exploration")
    if any("/split=exploration/" not in f for f in df.inputFiles()):
        raise PermissionError("the plan reads outside the exploration folder")
    return df
