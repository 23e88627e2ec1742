"""Statistics of a pool's draws as sets. Every function returns one row per pool.

Label counts include labels never drawn. Sequential statistics stay inside segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators.history import labels, lagged
from tumbler.operators.scan import longest_gaps, longest_runs, with_neighbours


def label_counts(hist: DataFrame, m: Matrix, extra: tuple[str, ...] = ()) -> DataFrame:
    """pool (and extra keys), n (draws), label, c: how often each label was drawn, 0 included."""
    by = ["pool", *extra]
    # The draw itself is counted as one more label, so one scan and one aggregation give n and the counts.
    itself = m.low - 1
    seen = hist.select(*by, F.explode(F.concat(F.array(F.lit(itself).cast("long")), F.col("numbers").cast("array<long>"))).alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("c"))
    counts = seen.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("of"))
    label = F.explode(F.sequence(F.lit(m.low), F.lit(m.high))).alias("label")
    rows = counts.select(*by, F.col("of")[F.lit(itself).cast("long")].alias("n"), "of", label)
    return rows.select(*by, "n", "label", F.coalesce(F.col("of")[F.col("label").cast("long")], F.lit(0)).alias("c"))


def frequency(hist: DataFrame, m: Matrix) -> DataFrame:
    """chi2, max_z, max_c, min_c over label counts."""
    p = m.k / m.n
    mu = F.col("n").cast("double") * p
    dev = F.col("c").cast("double") - mu
    return label_counts(hist, m).groupBy("pool").agg(F.sum(dev * dev / mu).alias("chi2"), F.max(F.abs(dev) / F.sqrt(mu * (1 - p))).alias("max_z"), F.max("c").alias("max_c"), F.min("c").alias("min_c"))


def combinations(hist: DataFrame, size: int, m: Matrix) -> DataFrame:
    """pool, labels (sorted array of `size`), c. The combinations of a draw are built in its row: no self join."""
    places = [[i] for i in range(m.k)]
    for _ in range(size - 1):
        places = [[*p, j] for p in places for j in range(p[-1] + 1, m.k)]
    sets = F.array(*[F.array(*[F.col("s")[i] for i in p]) for p in places])
    rows = hist.select("pool", F.array_sort("numbers").alias("s")).select("pool", F.explode(sets).alias("labels"))
    return rows.groupBy("pool", "labels").agg(F.count(F.lit(1)).alias("c"))


def top_combinations(hist: DataFrame, size: int, m: Matrix) -> DataFrame:
    """All combinations that reach their pool's largest count."""
    counts = combinations(hist, size, m)
    best = counts.groupBy("pool").agg(F.max("c").alias("best"))
    return counts.join(best, "pool").where("c = best").drop("best")


def overlap(hist: DataFrame, lags: list[int]) -> DataFrame:
    """pool, lag, n_pairs, total: labels shared by draws `lag` apart in a segment."""
    both = lagged(hist, lags, ["numbers"])
    return both.groupBy("pool", "lag").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.size(F.array_intersect("numbers", "prev_numbers"))).alias("total"))


def absence(hist: DataFrame, m: Matrix) -> DataFrame:
    """pool, seg, seg_len, drought: the longest run of draws of a segment without some label.

    Only drawn labels are rows. A run lies between two hits of a label or at an edge; if some label is missing
    from the segment, the whole segment is one run.
    """
    hits = labels(hist, ["pool", "seg", "seg_len", "idx"])
    gaps = longest_gaps(hits, ["pool", "seg", "label"], "idx", "seg_len")
    out = gaps.groupBy("pool", "seg", "seg_len").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("d"))
    return out.select("pool", "seg", "seg_len", F.when(F.col("d") < m.n, F.col("seg_len")).otherwise(F.col("gap")).alias("drought"))


def drought(hist: DataFrame, m: Matrix) -> DataFrame:
    return absence(hist, m).groupBy("pool").agg(F.max("drought").alias("value"))


def streak(hist: DataFrame) -> DataFrame:
    """The longest run of draws of a segment that all hold some label. hist is read twice, so it should be a written table.

    A run of more than one draw is a run of labels shared with the draw before, one shorter. So the rows are draws, and of their labels
    only the shared ones.
    """
    by = Window.partitionBy("pool", "seg", "__bucket").orderBy("idx")
    draws = with_neighbours(hist.select("pool", "seg", "idx", "numbers"), "idx", 1)
    before = F.when(F.lag("idx").over(by) == F.col("idx") - 1, F.lag("numbers").over(by))
    shared = draws.withColumn("__before", before).where("__own").select("pool", "seg", "idx", F.explode(F.array_intersect("numbers", "__before")).alias("label")).where("label IS NOT NULL")
    runs = longest_runs(shared, ["pool", "seg", "label"], "idx").groupBy("pool").agg(F.max("run").alias("run"))
    pools = hist.where(F.array_max("numbers").isNotNull()).select("pool").distinct()
    return pools.join(runs, pools["pool"].eqNullSafe(runs["pool"]), "left").select(pools["pool"], (F.coalesce("run", F.lit(0)) + 1).alias("value"))


def special_frequency(hist: DataFrame, m: Matrix) -> DataFrame:
    """chi2 and max_z over counts of the special label, 1..specials."""
    seen = hist.groupBy("pool", F.col("special").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    counts = seen.groupBy("pool").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "c")))).alias("of"))
    p = 1 / m.specials
    mu = F.col("n").cast("double") * p
    rows = counts.select("pool", "n", "of", F.explode(F.sequence(F.lit(1), F.lit(m.specials))).alias("label"))
    dev = F.coalesce(F.col("of")[F.col("label").cast("long")], F.lit(0)).cast("double") - mu
    return rows.groupBy("pool").agg(F.sum(dev * dev / mu).alias("chi2"), F.max(F.abs(dev) / F.sqrt(mu * (1 - p))).alias("max_z"))


def special_repeats(hist: DataFrame) -> DataFrame:
    """How often a draw's special label equals that of the draw before it in the segment."""
    both = lagged(hist, [1], ["special"]).groupBy("pool").agg(F.count_if(F.col("special") == F.col("prev_special")).alias("v"))
    return hist.select("pool").distinct().join(both, "pool", "left").select("pool", F.coalesce("v", F.lit(0)).alias("value"))


def structure(hist: DataFrame) -> DataFrame:
    """Each draw's draw_sum, range, adjacent_pairs, min_spacing, max_spacing, odd_count and run_starts."""
    s = hist.withColumn("s", F.array_sort("numbers"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i + 1) - F.element_at("s", i))
    s = s.withColumn("gaps", gaps)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))
    return s.select("pool", "draw_id", total("numbers").alias("draw_sum"), (F.element_at("s", -1) - F.element_at("s", 1)).cast("long").alias("range"), F.size(F.filter("gaps", lambda g: g == 1)).cast("long").alias("adjacent_pairs"), F.array_min("gaps").cast("long").alias("min_spacing"), F.array_max("gaps").cast("long").alias("max_spacing"), F.size(F.filter("numbers", lambda x: x % 2 == 1)).cast("long").alias("odd_count"), (F.size(F.filter("gaps", lambda g: g > 1)) + 1).cast("long").alias("run_starts"))


def dispersion(hist: DataFrame, quantity: str) -> DataFrame:
    """Sample variance over draws of a structural quantity."""
    return structure(hist).groupBy("pool").agg(F.var_samp(quantity).alias("value"))
