"""Statistics of draws as sequences: column j is the j-th label drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators.history import labels, lagged, spine
from tumbler.operators.scan import with_neighbours
from tumbler.operators.secondary import max_rolling


def cell_counts(hist: DataFrame, m: Matrix, extra: tuple[str, ...] = ()) -> DataFrame:
    """pool (and extra keys), n, pos, label, c over every position and label."""
    by = ["pool", *extra]
    seen = labels(hist, by).groupBy(*by, "pos", F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    # Every draw has a first label, so those count the draws; a key's cells are at most k times n.
    counts = seen.groupBy(*by).agg(F.sum(F.when(F.col("pos") == 1, F.col("c"))).alias("n"), F.map_from_entries(F.collect_list(F.struct(F.struct("pos", "label"), "c"))).alias("of"))
    rows = spine(spine(counts, 1, m.k, "pos"), m.low, m.high)
    cell = F.col("of")[F.struct(F.col("pos").alias("pos"), F.col("label").cast("long").alias("label"))]
    return rows.select(*by, "n", "pos", "label", F.coalesce(cell, F.lit(0)).alias("c"))


def omnibus(hist: DataFrame, m: Matrix, extra: tuple[str, ...] = ()) -> DataFrame:
    """chi2 over cells and max_z of a cell."""
    p = 1 / m.n
    e = F.col("n").cast("double") * p
    d = F.col("c") - e
    return cell_counts(hist, m, extra).groupBy("pool").agg(F.sum(d * d / e).alias("chi2"), F.max(F.abs(d) / F.sqrt(e * (1 - p))).alias("max_z"))


def position_discrepancy(hist: DataFrame, m: Matrix) -> DataFrame:
    """Largest Cramer-von Mises distance from uniform over positions."""
    cum = F.sum("c").over(Window.partitionBy("pool", "pos").orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    d = F.col("cum") / F.col("n").cast("double") - (F.col("label") - (m.low - 1)) * (1.0 / m.n)
    by_pos = cell_counts(hist, m).withColumn("cum", cum).groupBy("pool", "pos").agg(F.sum(d * d / m.n).alias("t"))
    return by_pos.groupBy("pool").agg(F.max("t").alias("value"))


def pair_counts(hist: DataFrame, m: Matrix, adjacent: bool) -> DataFrame:
    """pool, j, k, a, b, c: ordered label pairs at ordered position pairs; only pairs that occur."""
    places = [(j, k) for j in range(m.k) for k in range(m.k) if (k == j + 1 if adjacent else k != j)]
    pairs = F.array(*[F.struct(F.lit(j + 1).alias("j"), F.lit(k + 1).alias("k"), F.col("numbers")[j].alias("a"), F.col("numbers")[k].alias("b")) for j, k in places])
    return hist.select("pool", F.explode(pairs).alias("x")).select("pool", "x.*").where("a <> b").groupBy("pool", "j", "k", "a", "b").agg(F.count(F.lit(1)).alias("c"))


def _with_n(hist: DataFrame, counts: DataFrame) -> DataFrame:
    return counts.join(hist.groupBy("pool").agg(F.count(F.lit(1)).alias("n")), "pool")


def transitions(hist: DataFrame, m: Matrix) -> DataFrame:
    """Pearson statistic of adjacent positions. Cells that never occur, the impossible ones on the diagonal among them,
    are not rows: each adds its expectation e, so they come in as a constant."""
    cells, e = (m.k - 1) * m.n * m.n, F.col("n").cast("double") / (m.n * (m.n - 1))
    seen = _with_n(hist, pair_counts(hist, m, True)).groupBy("pool", "n").agg(F.sum((F.col("c") - e) * (F.col("c") - e) / e).alias("s"), F.count(F.lit(1)).alias("k"))
    return seen.select("pool", (F.col("s") + (F.lit(cells) - F.col("k")) * e).alias("value"))


def pair_residual(hist: DataFrame, m: Matrix) -> DataFrame:
    """Largest absolute standardised count over ordered pairs of positions and labels; unseen cells count 0."""
    p = 1 / (m.n * (m.n - 1))
    mu = F.col("n").cast("double") * p
    most = _with_n(hist, pair_counts(hist, m, False)).groupBy("pool", "n").agg(F.max("c").alias("c"), F.min("c").alias("lo"))
    return most.select("pool", (F.greatest(F.abs(F.col("c") - mu), F.abs(F.col("lo") - mu), mu) / F.sqrt(mu * (1 - p))).alias("value"))


def information(hist: DataFrame, m: Matrix) -> DataFrame:
    """Largest mutual information, in bits, of adjacent positions' labels."""
    cells = pair_counts(hist, m, True).withColumn("c", F.col("c").cast("double"))
    over = lambda *c: F.sum("c").over(Window.partitionBy("pool", "j", *c))
    terms = cells.withColumns({"ca": over("a"), "cb": over("b"), "t": over()})
    bits = terms.groupBy("pool", "j").agg(F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") * F.col("t") / (F.col("ca") * F.col("cb")))).alias("bits"))
    return bits.groupBy("pool").agg(F.max("bits").alias("value"))


def serial_hits(hist: DataFrame, m: Matrix, lags: list[int], cross: bool) -> DataFrame:
    """pool, j, k, lag, n_pairs, hits, z: equal labels at position j of a draw and k of the one `lag` later. All positions are
    counted in one aggregation, so a pair of draws stays one row."""
    places = [(j, k) for j in range(m.k) for k in range(m.k) if cross or j == k]
    both = lagged(hist, lags, ["numbers"])
    counts = both.groupBy("pool", "lag").agg(F.count(F.lit(1)).alias("n_pairs"), *[F.count_if(F.col("prev_numbers")[j] == F.col("numbers")[k]).alias(f"h{j}_{k}") for j, k in places])
    p = 1 / m.n
    n = F.col("n_pairs").cast("double")
    cells = F.array(*[F.struct(F.lit(j + 1).alias("j"), F.lit(k + 1).alias("k"), F.col(f"h{j}_{k}").alias("hits")) for j, k in places])
    rows = counts.select("pool", "lag", "n_pairs", F.inline(cells))
    return rows.withColumn("z", (F.col("hits") - n * p) / F.sqrt(n * p * (1 - p)))


def max_serial(hist: DataFrame, m: Matrix, lags: list[int], cross: bool) -> DataFrame:
    best = serial_hits(hist, m, lags, cross).groupBy("pool").agg(F.max(F.abs("z")).alias("v"))
    return hist.select("pool").distinct().join(best, "pool", "left").select("pool", F.coalesce("v", F.lit(0.0)).alias("value"))


def rolling(hist: DataFrame, m: Matrix, windows: list[int]) -> DataFrame:
    return max_rolling(hist, windows, 1 / m.n, m.k * m.n, ["pos", "label"])


def rolling_argmax(hist: DataFrame, m: Matrix, windows: list[int]) -> DataFrame:
    """pool, seg, pos, w, start, label, z: for each segment, position and window length the window (by its first draw in the
    segment) and label with the largest absolute z; of equal ones the earliest window, then the smallest label.

    The earliest window with a label's largest count ends at a hit or is the segment's first, that with its smallest count
    begins after a hit or is the first; of labels that a segment never draws there only the smallest matters. So only hits
    are rows.
    """
    hits, p, out = labels(hist, ["pool", "seg", "seg_len", "idx"]), 1 / m.n, None
    for w in windows:
        fit = hits.where(F.col("seg_len") >= w)
        by = Window.partitionBy("pool", "seg", "pos", "label", "__bucket").orderBy("idx")
        at = with_neighbours(fit, "idx", w).select("pool", "seg", "pos", "label", "idx", "seg_len", "__own", F.count(F.lit(1)).over(by.rangeBetween(-(w - 1), 0)).alias("back"), F.count(F.lit(1)).over(by.rangeBetween(1, w)).alias("ahead")).where("__own")
        ends = at.where(F.col("idx") >= w).select("pool", "seg", "pos", "label", (F.col("idx") - w + 1).alias("start"), F.col("back").alias("c"))
        begins = at.where(F.col("idx") + w <= F.col("seg_len")).select("pool", "seg", "pos", "label", (F.col("idx") + 1).alias("start"), F.col("ahead").alias("c"))
        first = at.groupBy("pool", "seg", "pos", "label").agg(F.count_if(F.col("idx") <= w).alias("c")).select("pool", "seg", "pos", "label", F.lit(1).cast("long").alias("start"), "c")
        missing = F.array_min(F.array_except(F.sequence(F.lit(m.low).cast("long"), F.lit(m.high).cast("long")), F.collect_set(F.col("label").cast("long"))))
        never = fit.groupBy("pool", "seg", "pos").agg(missing.alias("label")).where("label IS NOT NULL").select("pool", "seg", "pos", "label", F.lit(1).cast("long").alias("start"), F.lit(0).cast("long").alias("c"))
        z = F.abs(F.col("c") - w * p) / F.lit((w * p * (1 - p)) ** 0.5)
        best = ends.unionByName(begins).unionByName(first).unionByName(never).groupBy("pool", "seg", "pos").agg(F.max(F.struct(z.alias("z"), (-F.col("start")).alias("s"), (-F.col("label")).alias("l"))).alias("x"))
        part = best.select("pool", "seg", "pos", F.lit(w).alias("w"), (-F.col("x.s")).alias("start"), (-F.col("x.l")).alias("label"), F.col("x.z").alias("z"))
        out = part if out is None else out.unionByName(part)
    return out
