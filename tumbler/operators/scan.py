"""Runs, gaps and rolling counts along a segment, in buckets of places.

Windows hold one bucket of a label's hits. What crosses a bucket's bounds is put together over the small table of buckets
(for runs and gaps), or comes from hits that are sent to the neighbouring bucket as well (for rolling counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket.
BUCKET = 1024


def _bucket(at: str, size: int):
    return F.floor((F.col(at) - 1) / size)


def longest_gaps(hits: DataFrame, by: list[str], at: str, length: str) -> DataFrame:
    """by, length and gap: the most places in a row, of 1..length, that a key has no hit at. hits has a row for each key and place."""
    rows = hits.select(*by, at, length, _bucket(at, BUCKET).alias("__b"))
    inner = Window.partitionBy(*by, "__b").orderBy(at)
    rows = rows.withColumn("__gap", F.col(at) - F.lag(at).over(inner) - 1)
    parts = rows.groupBy(*by, length, "__b").agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.max("__gap").alias("__inside"))
    outer = Window.partitionBy(*by).orderBy("__b")
    before = F.col("__first") - F.coalesce(F.lag("__last").over(outer), F.lit(0)) - 1
    after = F.when(F.lead("__b").over(outer).isNull(), F.col(length) - F.col("__last")).otherwise(0)
    gaps = parts.withColumn("__gap", F.greatest(F.coalesce("__inside", F.lit(0)), before, after))
    return gaps.groupBy(*by, length).agg(F.max("__gap").alias("gap"))


def longest_runs(hits: DataFrame, by: list[str], at: str) -> DataFrame:
    """by and run: the most places in a row at which a key has a hit. Runs inside a bucket are whole; those at its bounds, two at
    most, are joined with the neighbours' over the table of buckets."""
    rows = hits.select(*by, at, _bucket(at, BUCKET).alias("__b"))
    inner = Window.partitionBy(*by, "__b").orderBy(at)
    runs = rows.withColumn("__g", F.col(at) - F.row_number().over(inner)).groupBy(*by, "__b", "__g").agg(F.min(at).alias("__from"), F.max(at).alias("__to"))
    touches = (F.col("__from") == F.col("__b") * BUCKET + 1) | (F.col("__to") == (F.col("__b") + 1) * BUCKET)
    edge = F.struct("__from", "__to")
    # One row for each bucket: the longest run inside, and the runs at its bounds.
    parts = runs.groupBy(*by, "__b").agg(F.max(F.when(~touches, F.col("__to") - F.col("__from") + 1)).alias("__inside"), F.min(F.when(touches, edge)).alias("__low"), F.max(F.when(touches, edge)).alias("__high"))
    ends = parts.select(*by, "__inside", F.explode_outer(F.array_distinct(F.array_compact(F.array("__low", "__high")))).alias("__e"))
    outer = Window.partitionBy(*by).orderBy("__e.__from")
    begins = F.when(F.col("__e.__from") == F.lag("__e.__to").over(outer) + 1, 0).otherwise(1)
    chained = ends.withColumn("__n", begins).withColumn("__chain", F.sum("__n").over(outer))
    joined = chained.groupBy(*by, "__chain").agg(F.max("__inside").alias("__inside"), (F.max("__e.__to") - F.min("__e.__from") + 1).alias("__run"))
    return joined.groupBy(*by).agg(F.max(F.greatest("__inside", "__run")).alias("run"))


def with_neighbours(hits: DataFrame, at: str, far: int) -> DataFrame:
    """hits with __bucket and __own: every hit in its own bucket, and once more in a neighbouring one whose bounds are less than
    `far` places away. A window over (key, __bucket) that reaches so far sees all it should at the rows that are __own."""
    size = max(BUCKET, far)
    own = _bucket(at, size)
    back, ahead = F.when((F.col(at) - own * size <= far) & (own > 0), own - 1), F.when((own + 1) * size - F.col(at) < far, own + 1)
    return hits.withColumn("__bucket", F.explode(F.array_compact(F.array(own, back, ahead)))).withColumn("__own", F.col("__bucket") == own)
