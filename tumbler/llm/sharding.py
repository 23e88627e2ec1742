"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into virtual partitions by a seeded hash of their contents. How many rows each
partition sends to each shard is one draw from the multivariate hypergeometric law, so the
row sums are the partition sizes and the column sums the shard sizes, exactly. Rows are
permuted within their partition, exchanged by that matrix, and permuted within the shard.

The matrix is drawn in two levels, which is the same law: the driver draws it for groups of partitions, and a
task for each group draws the group's part, so the driver holds about the square root of the partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tumbler.llm.common import cut, drop, few_rows, pieces, unused

ROWS_EACH = 20_000
#: Rows of the matrix that are broadcast (8 bytes for each shard).
BROADCAST_ROWS = 20_000


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """How many of n rows drawn without replacement from good + bad are good, by inversion of u in [0, 1).

    Probabilities follow from each other by ratios, from the mode out, for as far as 12 standard deviations (and 60
    rows): what lies beyond is below 1e-30. There is no limit on the population.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n * (good / total) * (bad / total)) if total else 0.0
    reach = int(12 * spread) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    p = np.concatenate([below[::-1], [1.0], above])
    at = int(np.searchsorted(np.cumsum(p), u * p.sum(), "right"))
    return mode - len(below) + min(at, len(p) - 1)


def communication_matrix(sizes: list[int], shares: list[int], seed) -> np.ndarray:
    """counts[p, s]: rows that partition p sends to shard s; sizes are its row sums, shares (of the same total) its column sums.

    A partition's row is drawn shard by shard from what the shards still lack; seed is anything that numpy takes.
    """
    left, rng = [int(x) for x in shares], np.random.default_rng(seed)
    out = np.zeros((len(sizes), len(left)), dtype=np.int64)
    for p, n in enumerate(map(int, sizes)):
        rest = sum(left)
        for s, lacks in enumerate(left):
            rest -= lacks
            out[p, s] = x = hypergeometric(lacks, rest, n, rng.random())
            left[s], n = lacks - x, n - x
    return out


def shard_rows(df: DataFrame, key: list[str], n_shards: int = 16, seed: int = 9) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row of df.

    `key` are the columns that tell rows apart; the outcome depends on them, the row count, the
    seed and n_shards only, not on how rows lie in files or tasks. Nulls are values like others.
    Rows alike in all of `key` may swap places with each other, which changes nothing in the result
    as far as these columns go. An empty table gives an empty result. df should hold narrow rows: it is
    shuffled twice; a very long text is read once, where its size and checksum are taken, and not moved. Columns of df
    named shard or slot, in any letter case, are replaced.
    """
    spark = df.sparkSession
    cols = [F.col(f"`{c}`") for c in key]
    clash = [c for c in df.columns if c.lower() in ("shard", "slot")]
    part, place, start, block, ends = (unused(df, f"sh_{x}") for x in ("part", "place", "start", "block", "ends"))

    def draw(k: int) -> Column:
        return F.xxhash64(F.lit(seed * 1000 + k), *cols)

    n = df.count()
    parts = pieces(n, ROWS_EACH)
    groups = math.isqrt(parts - 1) + 1 if parts > 1 else 1
    dealt = cut(df.withColumn(part, F.pmod(draw(1), F.lit(parts)).cast("long")), "shard-in")
    have = dealt.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.col("part") % groups)
    have = cut(have, "shard-sizes")
    # One row for each group: about the square root of rows / ROWS_EACH of them.
    sums = sorted(tuple(r) for r in have.groupBy("grp").agg(F.sum("n")).collect())
    shares = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([x for _, x in sums], shares, seed)
    lines = spark.createDataFrame([(g, row.tolist()) for (g, _), row in zip(sums, matrix)], "grp long, shares array<long>")

    def own_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        rows = communication_matrix(pdf["n"].tolist(), pdf["shares"].iloc[0], [seed, int(pdf["grp"].iloc[0])])
        return pd.DataFrame({"part": pdf["part"], "ends": [row.cumsum().tolist() for row in rows]})

    whole = have.join(F.broadcast(lines), "grp").groupBy("grp").applyInPandas(own_part, "part long, ends array<long>")
    whole = cut(whole.withColumnsRenamed({"part": part, "ends": ends}), "shard-matrix")
    local = Window.partitionBy(part).orderBy(draw(2), draw(3), *cols)
    sent = dealt.withColumn(place, F.row_number().over(local)).join(few_rows(whole, BROADCAST_ROWS), part).drop(*clash)
    sent = sent.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(place))).cast("int"))
    # The second permutation: a hash orders each shard's rows; blocks of it keep every window small.
    blocks = pieces(n, ROWS_EACH * n_shards)
    out_key = [F.col(f"`{c}`") for c in key if c not in clash]
    again = [F.xxhash64(F.lit(seed * 1000 + k), *out_key) for k in (4, 5, 6)]
    sent = cut(sent.drop(part, place, ends).withColumn(block, F.pmod(again[0], F.lit(blocks)).cast("int")), "shard-out")
    drop(dealt, have, whole)
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", block).count().select("shard", block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy("shard", block).orderBy(again[1], again[2], *out_key)
    # A row for each shard and block: one for every ROWS_EACH rows.
    starts = cut(starts, "shard-starts")
    placed = sent.withColumn(place, F.row_number().over(inner)).join(few_rows(starts, BROADCAST_ROWS), ["shard", block])
    return placed.withColumn("slot", (F.col(start) + F.col(place) - 1).cast("long")).drop(block, start, place)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1) and text_crc32 of each document; a null text counts as empty. Other columns are not read."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op9_shard_matrix(spark, sf_dir: str, n_shards: int = 16) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_rows(digest(docs), ["doc_id", "size", "text_crc32"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
