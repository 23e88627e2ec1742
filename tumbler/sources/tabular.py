"""Typed CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows in the declared types; a cell that doesn't fit stops the job. Empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", nullValue="", enforceSchema=False)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): bad ones with _file and _raw (the line), and what cells could be read."""
    wide = StructType(list(schema.fields)).add("_raw", "string")
    rows = spark.read.csv(path, header=True, schema=wide, mode="PERMISSIVE", nullValue="", columnNameOfCorruptRecord="_raw").withColumn("_file", F.input_file_name())
    return rows.where("_raw IS NULL").drop("_raw", "_file"), rows.where("_raw IS NOT NULL")


def joined_list(column: str, kind: str = "int") -> Column:
    """';'-joined cells as an array; blanks are dropped."""
    parts = F.filter(F.transform(F.split(column, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return parts.cast(f"array<{kind}>")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row that breaks a rule; a null outcome breaks it too."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """Columns in the given order with a header; arrays are ';'-joined, booleans true/false. Raises on no rows."""
    if df.limit(1).count() == 0:
        raise ValueError("no rows: use write_header for an empty table")
    _flat(df.orderBy(*order) if order else df, columns).write.csv(path, header=True, nullValue="", emptyValue="")


def write_header(df: DataFrame, path: str, columns: list[str]) -> None:
    """A header-only file."""
    _flat(df.limit(0), columns).coalesce(1).write.csv(path, header=True)


#: Columns of the registers that the operators read.
REGISTERS = {
    "sources": "source string, tier int",
    "eras": "era string, game string, lo date, hi date, clear_from date, pool string",
    "resolutions": "key string, field string, resolved_value string, evidence string, status string",
    "exclusions": "key string, reason string, decision_id string, decision string",
}


def read_register(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A register by name, in its declared types."""
    return read_csv(spark, path, REGISTERS[name])


def write_manifest(df: DataFrame, path: str) -> None:
    """A small table, such as counts by reason, as one file of JSON lines."""
    df.coalesce(1).write.json(path)


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])
