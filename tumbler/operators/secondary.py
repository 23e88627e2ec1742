"""Lag scans, terminal droughts, rolling windows and distribution discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix, moments, overlap_pmf
from tumbler.operators.history import labels, spine
from tumbler.operators.primary import label_counts, overlap
from tumbler.operators.scan import with_neighbours


def lag_scan(hist: DataFrame, m: Matrix, lags: list[int]) -> DataFrame:
    """pool, lag, n_pairs, total, z of the shared labels against the exact overlap moments."""
    mean, var = moments(overlap_pmf(m))
    n = F.col("n_pairs").cast("double")
    return overlap(hist, lags).withColumn("z", (F.col("total") - n * mean) / F.sqrt(n * var))


def max_lag(hist: DataFrame, m: Matrix, lags: list[int]) -> DataFrame:
    """Largest absolute z over lags; 0 for a pool without pairs."""
    best = lag_scan(hist, m, lags).groupBy("pool").agg(F.max(F.abs("z")).alias("v"))
    return hist.select("pool").distinct().join(best, "pool", "left").select("pool", F.coalesce("v", F.lit(0.0)).alias("value"))


def terminal_by_label(hist: DataFrame, m: Matrix) -> DataFrame:
    """pool, label, drought: draws since the label was last seen, in the pool's last segment."""
    last = hist.groupBy("pool").agg(F.max_by(F.struct("seg", "seg_len"), "seg").alias("x")).select("pool", "x.seg", F.col("x.seg_len").alias("n_seg"))
    seen = labels(hist, ["pool", "seg", "idx"]).join(last, ["pool", "seg"]).groupBy("pool", "label").agg(F.max("idx").alias("at"))
    return spine(last, m.low, m.high).join(seen, ["pool", "label"], "left").select("pool", "label", (F.col("n_seg") - F.coalesce("at", F.lit(0))).cast("long").alias("drought"))


def terminal(hist: DataFrame, m: Matrix) -> DataFrame:
    return terminal_by_label(hist, m).groupBy("pool").agg(F.max("drought").alias("value"))


def rolling_extremes(hist: DataFrame, cells: int, windows: list[int], cell: list[str]) -> DataFrame:
    """pool, w, most, least: extreme counts of a cell over all windows of w draws that fit in a segment.

    `cell` names the columns of a cell (label, or position and label); a segment has `cells` of them.
    Only hits are rows. The largest count is reached by a window that ends at a hit or is the segment's first; the
    smallest by one that begins after a hit or is the first, or is 0 if some cell has no hit.
    """
    hits = labels(hist, ["pool", "seg", "seg_len", "idx"]).select("pool", "seg", "seg_len", "idx", *cell)
    hits = with_neighbours(hits, "idx", max(windows))
    by, n, fits = Window.partitionBy("pool", "seg", *cell, "__bucket").orderBy("idx"), F.col("seg_len"), lambda w: F.col("seg_len") >= w
    # One window pass and one aggregation serve all lengths; a length that doesn't fit in a segment gives nulls there.
    backs = [F.when(fits(w), F.count(F.lit(1)).over(by.rangeBetween(-(w - 1), 0))).alias(f"back{w}") for w in windows]
    aheads = [F.when(F.col("idx") + w <= n, F.count(F.lit(1)).over(by.rangeBetween(1, w))).alias(f"ahead{w}") for w in windows]
    at = hits.select("pool", "seg", "seg_len", "idx", "__own", *cell, *backs, *aheads).where("__own")
    most = [F.max(f"back{w}").alias(f"most{w}") for w in windows]
    least = [F.when(F.bool_or(fits(w)), F.least(F.coalesce(F.min(f"ahead{w}"), F.lit(w)), F.count_if(F.col("idx") <= w))).alias(f"least{w}") for w in windows]
    segs = at.groupBy("pool", "seg", *cell).agg(*most, *least).groupBy("pool", "seg").agg(F.count(F.lit(1)).alias("d"), *[F.max(f"most{w}").alias(f"most{w}") for w in windows], *[F.min(f"least{w}").alias(f"least{w}") for w in windows])
    lows = [F.min(F.when(F.col(f"least{w}").isNotNull(), F.when(F.col("d") < cells, 0).otherwise(F.col(f"least{w}")))).alias(f"least{w}") for w in windows]
    pools = segs.groupBy("pool").agg(*[F.max(f"most{w}").alias(f"most{w}") for w in windows], *lows)
    rows = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"most{w}").alias("most"), F.col(f"least{w}").alias("least")) for w in windows])
    return pools.select("pool", F.inline(rows)).where("most IS NOT NULL").select("pool", "most", "least", "w")


def max_rolling(hist: DataFrame, windows: list[int], p: float, cells: int, cell: list[str]) -> DataFrame:
    """Largest absolute standardised count over windows, cells and segments; 0 where no window fits."""
    w = F.col("w").cast("double")
    z = lambda c: F.abs(F.col(c) - w * p) / F.sqrt(w * p * (1 - p))
    best = rolling_extremes(hist, cells, windows, cell).groupBy("pool").agg(F.max(F.greatest(z("most"), z("least"))).alias("v"))
    return hist.select("pool").distinct().join(best, "pool", "left").select("pool", F.coalesce("v", F.lit(0.0)).alias("value"))


def discrepancy(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Discrete Cramer-von Mises distance of (pool, quantity, x) values from pmfs (quantity, x, p): sum of p (F - F0)^2.

    Returns pool, quantity, value. The supports are a few hundred points and broadcast; a value counts from the
    first support point at or above it.
    """
    by = Window.partitionBy("quantity").orderBy("x")
    far = 1 << 40
    grid = reference.select("quantity", "x", "p", F.sum("p").over(by).alias("f0"), F.coalesce(F.lag("x").over(by), F.lit(-far)).alias("below"))
    n = values.groupBy("pool", "quantity").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("pool", "quantity", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    points = F.broadcast(grid.select("quantity", "x", "below"))
    placed = counts.join(points, "quantity").where("v <= x AND v > below").groupBy("pool", "quantity", "x").agg(F.sum("c").alias("c"))
    cells = n.join(F.broadcast(grid.drop("below")), "quantity").join(placed, ["pool", "quantity", "x"], "left")
    cum = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("pool", "quantity").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    d = F.col("cum") / F.col("n").cast("double") - F.col("f0")
    return cells.withColumn("cum", cum).groupBy("pool", "quantity").agg(F.sum(F.col("p") * d * d).alias("value"))


def category_chi2(hist: DataFrame, m: Matrix, category: str) -> DataFrame:
    """Sum over categories of the label chi-square within each."""
    e = F.col("n").cast("double") * m.k / m.n
    return label_counts(hist, m, (category,)).groupBy("pool").agg(F.sum((F.col("c") - e) * (F.col("c") - e) / e).alias("value"))


def sufficiency(labelled: DataFrame, category: str, min_categories: int, min_each: int, min_total: int) -> DataFrame:
    """Per pool: categories and draws that reach min_each, and whether they suffice. Null categories don't count."""
    counts = labelled.where(F.col(category).isNotNull()).groupBy("pool", category).agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= min_each
    out = counts.groupBy("pool").agg(F.sum("n").alias("n_populated"), F.count(F.lit(1)).alias("n_categories"), F.count_if(ok).alias("n_eligible"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_included"))
    return out.withColumn("sufficient", (F.col("n_eligible") >= min_categories) & (F.col("n_included") >= min_total))
