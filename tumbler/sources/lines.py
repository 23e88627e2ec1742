"""Lines of text files with their place, however the files are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tumbler.operators.history import running
from tumbler.scratch import cut


#: Rows of a part of a text that is written in order.
PART = 500_000


def write_ordered(rows: DataFrame, key: str, line: Column, path: str, header: str | None = None) -> None:
    """One text in order of a key, a line for each row, as part files in order of their names: tasks hold ranges of the key."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))
    dealt = rows.select(key, line.alias("value"))
    if header is not None:  # before the least key
        first = spark.createDataFrame([(header,)], "value string").select(F.lit(None).cast(dealt.schema[key].dataType).alias(key), "value")
        dealt = dealt.unionByName(first)
    dealt.repartitionByRange(parts, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first()).select("value").write.text(path)


def numbered(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """file (its name), number (from 1), offset (the line's first byte, from 0) and line of files with line feeds: lines and bytes are
    summed inside a split and over the table of splits, so no task holds a file. If joined, the files are one text in order of their names,
    and file is the path."""
    name, start = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    read = spark.read.text(path).select((F.lit(path) if joined else name).alias("file"), F.struct(name.alias("name"), start.alias("start")).alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    size = F.octet_length("line") + 1
    out = running(cut(read, "lines"), ["file"], F.col("block"), ["place"], {"__end": size, "number": F.lit(1)})
    return out.select("file", "number", (F.col("__end") - size).alias("offset"), "line")


def typed_csv(spark: SparkSession, path: str, schema: StructType, joined: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files with a header and one record a line.

    rows has the declared columns; empty cells are null. errors has file, number, column and value for each cell that isn't
    of its type, a line of the wrong number of cells (column null) and a header that isn't the declared one (number 1); a line with
    an error gives no row. Blank lines are skipped. If joined, the files are one text (see numbered()), with one header.
    """
    texts = ", ".join(f"`{name}` string" for name in [*schema.names, "_raw"])
    lines = numbered(spark, path, joined).where("number = 1 OR line <> ''")
    cells = lines.withColumn("c", F.from_csv("line", texts, {"columnNameOfCorruptRecord": "_raw", "mode": "PERMISSIVE"}))
    none = F.lit(None).cast("string")
    problem = lambda column, value: F.struct(column.alias("column"), value.alias("value"))
    filled = lambda f: F.nullif(F.col("c").getField(f.name), F.lit(""))
    wrong = [F.when(filled(f).isNotNull() & filled(f).try_cast(f.dataType).isNull(), problem(F.lit(f.name), filled(f))) for f in schema.fields]
    header = F.when(F.col("line") != ",".join(schema.names), F.array(problem(none, F.col("line"))))
    whole = F.when(F.col("c._raw").isNotNull(), F.array(problem(none, F.col("line")))).otherwise(F.array_compact(F.array(*wrong)))
    judged = cut(cells.withColumn("errors", F.when(F.col("number") == 1, header).otherwise(whole)), "csv")
    good = judged.where("number > 1 AND size(errors) = 0").select(*[filled(f).cast(f.dataType).alias(f.name) for f in schema.fields])
    return good, judged.where("errors IS NOT NULL").select("file", "number", F.inline("errors"))
