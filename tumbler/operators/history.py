"""Draw histories: positions in a pool, contiguous segments, and exploded labels.

A history has pool, draw_id, t, numbers (array of labels) and optionally special and eligible.
Order within a pool is (t, draw_id). Numbering is done in two levels, within a day and over days,
so no window holds a whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], bucket: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running totals (including the row itself) in the given order within each `by` group.

    bucket must not decrease along the order. Totals of whole buckets are accumulated over the small table of
    buckets; the windows over rows stay inside one bucket.
    """
    cols = [(name, x.cast("long")) for name, x in sums.items()]
    keyed = df.withColumns({"__b": bucket, **{f"__x{i}": x for i, (_, x) in enumerate(cols)}})
    totals = keyed.groupBy(*by, "__b").agg(*[F.sum(f"__x{i}").alias(f"__t{i}") for i in range(len(cols))])
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__b", *[F.sum(f"__t{i}").over(earlier).alias(f"__s{i}") for i in range(len(cols))])
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(starts, [*by, "__b"])
    out = out.withColumns({name: F.sum(f"__x{i}").over(inner) + F.coalesce(f"__s{i}", F.lit(0)) for i, (name, _) in enumerate(cols)})
    return out.drop("__b", *[f"__{k}{i}" for i in range(len(cols)) for k in "xs"])


def segmented(draws: DataFrame, by: str = "pool", eligible: str = "eligible") -> DataFrame:
    """The eligible draws with rn (place in the pool), seg (rn of the segment's first draw), idx (1.. in the segment)
    and seg_len. A segment is a maximal run of eligible draws; an ineligible one ends it."""
    on = F.coalesce(F.col(eligible), F.lit(False))
    numbered = running(draws, [by], F.date_trunc("day", "t"), ["t", "draw_id"], {"rn": F.lit(1), "__e": on.cast("int")}).where(on)
    island = numbered.withColumn("__g", F.col("rn") - F.col("__e"))
    bounds = island.groupBy(by, "__g").agg(F.min("rn").alias("seg"), F.count(F.lit(1)).alias("seg_len"))
    return island.join(bounds, [by, "__g"]).withColumn("idx", F.col("rn") - F.col("seg") + 1).drop("__g", "__e")


def segments(hist: DataFrame, by: str = "pool") -> DataFrame:
    """One row per segment: pool, seg, seg_len, first_t, last_t."""
    return hist.groupBy(by, "seg").agg(F.count(F.lit(1)).alias("seg_len"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def observation_plan(draws: DataFrame, ordered: str) -> DataFrame:
    """Per pool: n_draws, first_day, last_day, lengths of its segments and of the segments in known order (column `ordered`),
    ';'-joined in time order, and plan_hash over them. Lengths are as many as segments, not draws."""
    h = segmented(draws)

    def lengths(x: DataFrame, name: str) -> DataFrame:
        rows = F.transform(F.array_sort(F.collect_list(F.struct("seg", "seg_len"))), lambda s: s["seg_len"].cast("string"))
        return segments(x).groupBy("pool").agg(F.array_join(rows, ";").alias(name))

    known = segmented(draws.withColumn("__ok", F.col("eligible") & F.col(ordered)), eligible="__ok")
    total = h.groupBy("pool").agg(F.count(F.lit(1)).alias("n_draws"), F.min("t").cast("date").cast("string").alias("first_day"), F.max("t").cast("date").cast("string").alias("last_day"))
    out = total.join(lengths(h, "segments"), "pool").join(lengths(known, "order_segments"), "pool", "left")
    text = F.concat_ws("|", "pool", F.col("n_draws").cast("string"), "segments", F.coalesce("order_segments", F.lit("")))
    return out.withColumn("plan_hash", F.sha2(text, 256))


def applicability(hist: DataFrame, window: int) -> DataFrame:
    """Per pool: whether statistics of the special label, of neighbouring draws and of windows of so many draws apply."""
    return hist.groupBy("pool").agg((F.count("special") > 0).alias("special_statistics"), (F.max("seg_len") > 1).alias("serial_statistics"), (F.max("seg_len") >= window).alias("rolling_statistics"))


def adjudicated(hist: DataFrame) -> DataFrame:
    """Per pool: n, the share of ascending sequences, and the verdict on its order: repeated_draws if neighbours in a segment hold
    the same labels, sorted_suspected if more than half ascend, else kept."""
    ascending = hist.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("numbers") == F.array_sort("numbers")).cast("int")).alias("a"))
    same = lagged(hist, [1], ["numbers"]).groupBy("pool").agg(F.count_if(F.array_sort("numbers") == F.array_sort("prev_numbers")).alias("same"))
    verdict = F.when(F.coalesce("same", F.lit(0)) > 0, "repeated_draws").when(F.col("a") > 0.5, "sorted_suspected").otherwise("kept")
    return ascending.join(same, "pool", "left").select("pool", "n", F.round("a", 6).alias("ascending"), verdict.alias("verdict"))


def at_times(hist: DataFrame, times: DataFrame) -> DataFrame:
    """The draws of each (pool, t) of times: an equi join."""
    return hist.join(times, ["pool", "t"])


def labels(hist: DataFrame, keep: list[str]) -> DataFrame:
    """One row per drawn label with its position (1..K)."""
    return hist.select(*keep, F.posexplode("numbers").alias("pos", "label")).withColumn("pos", F.col("pos") + 1)


def number_rows(draws: DataFrame) -> DataFrame:
    """Normalised rows: main labels by position, and the special label one place after them where there is one."""
    main = draws.select("draw_id", F.posexplode("numbers").alias("p", "number")).select("draw_id", (F.col("p") + 1).cast("int").alias("position"), F.lit("main").alias("kind"), F.col("number").cast("long").alias("number"))
    special = draws.where("special IS NOT NULL").select("draw_id", (F.size("numbers") + 1).cast("int").alias("position"), F.lit("special").alias("kind"), F.col("special").cast("long").alias("number"))
    return main.unionByName(special)


def spine(totals: DataFrame, low: int, high: int, name: str = "label") -> DataFrame:
    """Every label for each row of a small table."""
    return totals.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name))


def lagged(hist: DataFrame, lags: list[int], cols: list[str], by: str = "pool") -> DataFrame:
    """Pairs of draws `lag` apart in one segment: the later draw's columns and, with prefix prev_, the earlier's.

    An equi join on (pool, seg, idx), so each pair is found without a window over the pool.
    """
    later = hist.select(by, "seg", "idx", *cols, F.explode(F.array(*map(F.lit, lags))).alias("lag")).where("idx > lag")
    later = later.withColumn("__at", F.col("idx") - F.col("lag"))
    earlier = hist.select(F.col(by).alias("__by"), F.col("seg").alias("__seg"), F.col("idx").alias("__idx"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return later.join(earlier, (F.col(by) == F.col("__by")) & (F.col("seg") == F.col("__seg")) & (F.col("__at") == F.col("__idx"))).drop("__by", "__seg", "__idx", "__at")
