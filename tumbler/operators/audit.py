"""Audit checks: each is a query whose rows are violations; the table of checks says which hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def by_reason(df: DataFrame, codes: str, ok: str) -> DataFrame:
    """(reason, n): rows under each of their codes (an array), and under eligible those for which `ok` holds."""
    own = F.when(F.col(ok), F.array(F.lit("eligible"))).otherwise(F.col(codes))
    return df.select(F.explode(own).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def checks(violations: dict[str, DataFrame]) -> DataFrame:
    """(check, passed, n_violations), one row for each name."""
    parts = [v.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), (F.col("n_violations") == 0).alias("passed"), "n_violations") for name, v in violations.items()]
    return reduce(DataFrame.unionByName, parts)


def compiled(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, passed, n_violations) for conditions that no row of a table may fulfil: all of them are counted in one scan and one
    aggregation. A null outcome is no violation."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, bad in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), (F.col(f"c{i}") == 0).alias("passed"), F.col(f"c{i}").alias("n_violations")) for i, name in enumerate(rules)])
    return counts.select(F.inline(rows))
