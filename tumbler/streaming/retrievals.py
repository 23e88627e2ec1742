"""Streams: first retrievals of contents, counts of labels and features of the past as draws arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tumbler.functions.exact import Matrix


def first_retrievals(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Of (source, content, retrieved_at) each content of a source once, if it comes again within `delay`."""
    hashed = stream.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.withWatermark("retrieved_at", delay).dropDuplicatesWithinWatermark(["source", "sha256"])


def label_counts(stream: DataFrame, window: str = "7 days", delay: str = "1 day") -> DataFrame:
    """pool, start, label, c: drawn labels in event-time windows; late draws count until the watermark passes."""
    rows = stream.withWatermark("t", delay).select("pool", "t", F.explode("numbers").alias("label"))
    return rows.groupBy("pool", F.window("t", window).alias("w"), "label").agg(F.count(F.lit(1)).alias("c")).select("pool", F.col("w.start").alias("start"), "label", "c")


STATE = "n long, c long, last long, decayed double"
FEATURES = "pool string, label long, draw_id long, n long, c long, decayed double, gap long, prev boolean, hit int"


class PastCounts(StatefulProcessor):
    """What earlier draws of a pool say of one label; a draw is added after its row is given out."""

    def __init__(self, half_life: float):
        self.keep = 0.5 ** (1 / half_life)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("past", STATE)

    def handleInputRows(self, key, rows, timerValues):
        n, c, last, decayed = self.state.get() if self.state.exists() else (0, 0, 0, 0.0)
        for row in sorted(rows, key=lambda r: (r["t"], r["draw_id"])):
            yield Row(pool=key[0], label=key[1], draw_id=row["draw_id"], n=n, c=c, decayed=decayed, gap=n - last, prev=n > 0 and last == n, hit=row["hit"])
            n, c, decayed = n + 1, c + row["hit"], decayed * self.keep + row["hit"]
            last = n if row["hit"] else last
        self.state.update((n, c, last, decayed))

    def close(self) -> None:
        pass


def expanding_features(stream: DataFrame, m: Matrix, half_life: float = 50.0) -> DataFrame:
    """The rows of models.features() for every label as draws arrive: pool, label, draw_id, n, c, decayed, gap, prev, hit.

    The state of a (pool, label) is four numbers, in a store that survives lost executors (RocksDB, which the session must name as its
    state store). Draws must arrive in their order (t, draw_id) from one micro-batch to the next; within one they may be mixed.
    A micro-batch's rows of one pool and label are sorted in a task.
    """
    grid = stream.select("pool", "draw_id", "t", "numbers", F.explode(F.sequence(F.lit(m.low), F.lit(m.high))).alias("l"))
    rows = grid.select("pool", F.col("l").cast("long").alias("label"), "draw_id", "t", F.array_contains("numbers", F.col("l").cast("long")).cast("int").alias("hit"))
    return rows.groupBy("pool", "label").transformWithState(statefulProcessor=PastCounts(half_life), outputStructType=FEATURES, outputMode="append", timeMode="none")
