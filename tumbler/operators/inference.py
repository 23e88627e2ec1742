"""Monte-Carlo p-values, multiple testing, convergence and promotion.

Families of tests and null replicates may be large: tests are ranked in two levels, replicates only aggregated.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.operators.history import running
from tumbler.operators.reconcile import few_rows
from tumbler.scratch import cut, drop


def mc_pvalue(nulls: DataFrame, observed: DataFrame, key: list[str], tail: str = "upper") -> DataFrame:
    """key, b, n_null, p = (b + 1) / (n_null + 1) for observed (key, observed) against nulls (key, value).

    With tail "own", observed has a column tail with each key's. A key without null values raises when its row is computed.
    """
    if tail not in ("upper", "lower", "two-sided", "own"):
        raise ValueError(f"unknown tail {tail!r}")
    observed = observed if tail == "own" else observed.withColumn("tail", F.lit(tail))
    # Nulls are counted where they are read; a join that keeps the observed side would hold a key's nulls.
    counts = nulls.join(few_rows(observed.select(*key, "observed")), key).groupBy(*key).agg(F.count("value").alias("n_null"), F.count_if(F.col("value") >= F.col("observed")).alias("up"), F.count_if(F.col("value") <= F.col("observed")).alias("down"))
    joined = observed.groupBy(*key).agg(F.first("tail").alias("tail")).join(counts, key, "left").withColumn("n_null", F.coalesce("n_null", F.lit(0)))
    b = F.when(F.col("tail") == "upper", F.col("up")).when(F.col("tail") == "lower", F.col("down")).when(F.col("tail") == "two-sided", F.least(2 * F.least("up", "down"), F.col("n_null"))).otherwise(F.raise_error(F.lit("unknown tail")).cast("long"))
    p = F.when(F.col("n_null") > 0, (b + 1) / (F.col("n_null") + 1).cast("double")).otherwise(F.raise_error(F.lit("no null values")).cast("double"))
    return joined.select(*key, b.alias("b"), "n_null", p.alias("p"))


def z_scores(nulls: DataFrame, observed: DataFrame, key: list[str], floor: float = 1e-12) -> DataFrame:
    """key, z: observed values in standard deviations of their nulls, which count as at least `floor`."""
    spread = nulls.groupBy(*key).agg(F.avg("value").alias("mean"), F.greatest(F.stddev_samp("value"), F.lit(floor)).alias("sd"))
    return observed.join(spread, key).select(*key, ((F.col("observed") - F.col("mean")) / F.col("sd")).alias("z"))


#: Buckets of p-values for each halving of p.
OCTAVE = 1024


def _extreme(df: DataFrame, f, x: str, name: str, down: bool) -> DataFrame:
    """Adds f (min or max) of x over a family's rows up to this one by p, from the largest p if down; in two levels."""
    way = lambda c: F.col(c).desc() if down else F.col(c)
    before = Window.partitionBy("__f").orderBy(way("__k")).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("__f", "__k").agg(f(x).alias("__t")).select("__f", "__k", f("__t").over(before).alias("__s"))
    inner = Window.partitionBy("__f", "__k").orderBy(way("__p")).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.least if f is F.min else F.greatest
    return df.join(starts, ["__f", "__k"]).withColumn(name, pick(F.col("__s"), f(x).over(inner))).drop("__s")


def adjust(tests: DataFrame, family: list[str], p: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds bh_q, bh_reject, holm_p and holm_reject within each family; ties in p are ordered by `tie`.

    Equal p-values get equal results in either order: BH is decided at the last rank of a tie and Holm at the first. So only
    distinct p-values are ranked, by buckets of log p and inside a bucket; no window holds a family's tests.
    """
    key = tests.withColumns({"__f": F.struct(F.lit(0).alias("one"), *family), "__p": F.struct(F.col(p).alias("p"))})
    bucket = F.coalesce(F.floor(F.log2(F.greatest(F.col("__p.p").cast("double"), F.lit(1e-300))) * OCTAVE), F.lit(-(1 << 40)))
    d = key.groupBy("__f", "__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__k", bucket)
    m = d.groupBy("__f").agg(F.sum("__c").cast("double").alias("__m"))
    d = running(d, ["__f"], F.col("__k"), ["__p"], {"__r": F.col("__c")}).join(m, "__f")
    pv, last, first = F.col("__p.p"), F.col("__r").cast("double"), (F.col("__r") - F.col("__c") + 1).cast("double")
    d = d.withColumns({"__up": pv * F.col("__m") / last, "__down": pv * (F.col("__m") - first + 1)})
    d = d.withColumns({"__ok": F.when(pv <= last * alpha / F.col("__m"), last), "__no": F.when(pv > F.lit(alpha) / (F.col("__m") - first + 1), first), "__first": first})
    ends = d.groupBy("__f").agg(F.coalesce(F.max("__ok"), F.lit(0.0)).alias("__last"), F.coalesce(F.min("__no"), F.lit(float("inf"))).alias("__stop"))
    d = _extreme(_extreme(d, F.min, "__up", "bh_q", True), F.max, "__down", "__holm", False).join(ends, "__f")
    d = d.select("__f", "__p", F.least(F.lit(1.0), F.col("bh_q")).alias("bh_q"), F.least(F.lit(1.0), F.col("__holm")).alias("holm_p"), (F.col("__r") <= F.col("__last")).alias("bh_reject"), (F.col("__first") < F.col("__stop")).alias("holm_reject"))
    return key.join(d, ["__f", "__p"]).drop("__f", "__p")


QUANTILES = {"q90": 0.9, "q95": 0.95, "q99": 0.99}


#: Distinct values of a part that are ranked in one window.
PART = 500_000


def quantiles(df: DataFrame, key: list[str], value: str, probs: dict[str, float], part: int = PART) -> DataFrame:
    """key and exact quantiles (linear between neighbours): values are counted, and the counts ranked in two levels, inside parts
    and over the table of parts. Parts are Spark's ranges of (key, value), cut by a sample of the distinct values, so they hold
    about equally many however skewed values are. Nulls don't count; a key without values has no row."""
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c")), "counts")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // part))
    dealt = cut(counts.repartitionByRange(parts, *key, "__v").withColumn("__part", F.spark_partition_id()), "parts")
    drop(counts)
    total = dealt.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.sum("__c").alias("__n"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # The totals are as many as keys: a shuffled join would send a key's values to one task.
    ranked = running(dealt.join(few_rows(total), same).drop(*[f"__{k}" for k in key]), key, F.col("__part"), ["__v"], {"__r": F.col("__c")})
    at = {q: F.lit(p) * (F.col("__n") - 1) for q, p in probs.items()}
    # The value at a place (from 0) is the smallest whose running count is beyond it.
    sides = [F.min(F.when(F.col("__r") > f(x), F.col("__v"))).alias(f"__{side}_{q}") for q, x in at.items() for side, f in (("a", F.floor), ("b", F.ceil))]
    out = ranked.groupBy(*key, "__n").agg(*sides)
    return out.select(*key, *[(F.col(f"__a_{q}") + (F.col(f"__b_{q}") - F.col(f"__a_{q}")) * (x - F.floor(x))).alias(q) for q, x in at.items()])


def convergence(nulls: DataFrame, key: list[str], sigma: float = 4.0, relative: float = 1e-6) -> DataFrame:
    """key, metric, pooled, passed: whether batches (column batch) of null values agree with all of them together.

    Mean and population variance may differ by sigma * sqrt(3) standard errors; a quantile passes if every batch's
    distribution function at the pooled quantile brackets its probability within as many.
    """
    v, width = F.col("value"), sigma * sqrt(3.0)
    pooled = nulls.groupBy(*key).agg(F.count(v).alias("n"), F.mean(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_samp(v).alias("sd")).join(quantiles(nulls, key, "value", QUANTILES), key)
    pooled = cut(pooled, "pooled")
    both = nulls.join(few_rows(pooled), key)  # a shuffled join would sort all values of a key in one task
    mu4 = both.groupBy(*key).agg(F.mean(F.pow(v - F.col("mean"), 4)).alias("mu4"))
    batch = both.groupBy(*key, "batch").agg(F.mean(v).alias("b_mean"), F.var_pop(v).alias("b_var"), *[x for q in QUANTILES for x in (F.mean((v <= F.col(q)).cast("double")).alias(f"le_{q}"), F.mean((v < F.col(q)).cast("double")).alias(f"lt_{q}"))])
    j = batch.join(pooled, key).join(mu4, key)
    tol = lambda se, x: F.greatest(width * se, relative * F.greatest(F.lit(1.0), F.abs(x)))
    root_n = F.sqrt(F.col("n").cast("double"))
    checks = [
        F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("pooled"), (F.abs(F.col("b_mean") - F.col("mean")) <= tol(F.col("sd") / root_n, F.col("mean"))).alias("ok")),
        F.struct(F.lit("var").alias("metric"), F.col("var").alias("pooled"), (F.abs(F.col("b_var") - F.col("var")) <= tol(F.sqrt(F.greatest(F.col("mu4") - F.col("var") * F.col("var"), F.lit(0.0))) / root_n, F.col("var"))).alias("ok")),
    ]
    for q, p in QUANTILES.items():
        t = width * sqrt(p * (1 - p)) / root_n
        checks.append(F.struct(F.lit(q).alias("metric"), F.col(q).alias("pooled"), ((F.col(f"le_{q}") >= p - t) & (F.col(f"lt_{q}") <= p + t)).alias("ok")))
    return j.select(*key, F.explode(F.array(*checks)).alias("x")).groupBy(*key, "x.metric").agg(F.max("x.pooled").alias("pooled"), F.bool_and("x.ok").alias("passed"))


def promote(tests: DataFrame, flag: str = "bh_reject", z: str = "z", least: float = 2.5, converged: str | None = None) -> DataFrame:
    """Tests that are flagged and large enough (and converged, if a column says so)."""
    ok = F.col(flag) & (F.abs(F.col(z)) >= least)
    return tests.where(ok & F.col(converged) if converged else ok)
