"""All statistics of a family at once: shared scans, and p-values from exact or asymptotic laws in place of simulated nulls.

Tasks count the cells of their draws (labels, pairs, places, categories, structural quantities) by chunks; sums over cells give
the statistics that look at one draw at a time. Statistics of pairs of draws share one join by lag, and runs and
rolling counts the scans by bucket.
"""

from __future__ import annotations

from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tumbler.functions import exact
from tumbler.functions.exact import Matrix
from tumbler.operators import inference
from tumbler.operators.history import lagged
from tumbler.operators.positional import rolling
from tumbler.operators.primary import drought, streak
from tumbler.operators.secondary import max_rolling, terminal
from tumbler.scratch import cut

QUANTITIES = ("draw_sum", "range", "adjacent_pairs", "min_spacing", "max_spacing", "odd_count")
FAMILY = {"fs": "primary", "p3s": "secondary", "p3b": "positional"}


#: Draws that a task counts at a time, and cells that it counts by place in an array.
CHUNK, DENSE = 250_000, 1 << 22
#: Stands for a missing label: it is sorted behind the others.
MISSING = np.iinfo("i8").max


def cells(hist: DataFrame, m: Matrix, category: str) -> DataFrame:
    """pool, kind, sub, key, c: how often each label, pair, triple, label at a place, ordered pair at two places, special, label in a
    category (and at a place there) and value of a structural quantity occurs. One scan, and one shuffle of what tasks have counted."""
    pool = hist.schema["pool"].dataType
    draws = hist.select("pool", F.coalesce(F.col(category).cast("string"), F.lit("-")).alias("cat"), F.col("special").cast("long").alias("special"), F.col("numbers").cast("array<long>").alias("numbers"))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from _counted(pa.Table.from_batches(held), m)
                held, rows = [], 0
        if rows:
            yield from _counted(pa.Table.from_batches(held), m)

    schema = StructType([StructField("pool", pool), *StructType.fromDDL("kind string, sub string, key bigint, c bigint")])
    return draws.mapInArrow(run, schema).groupBy("pool", "kind", "sub", "key").agg(F.sum("c").alias("c"))


def _counted(draws: pa.Table, m: Matrix):
    """The cells of some draws and their counts, as batches."""
    draws = draws.combine_chunks()
    numbers, special = draws.column("numbers").combine_chunks(), draws.column("special")
    size, k, t = m.high + 1, m.k, len(numbers)
    length = np.asarray(numbers.value_lengths().fill_null(k))
    if t and length.min() < k:
        raise ValueError(f"a draw has fewer than {k} labels")
    label = np.full((t, length.max(initial=k)), MISSING)
    row, flat = numbers.value_parent_indices().to_numpy(), numbers.flatten()
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=t))])
    label[row, np.arange(len(row)) - starts[row]] = flat.fill_null(MISSING).to_numpy()
    # A column is values and where they are known.
    column = lambda v: (v, v != MISSING)
    both = lambda v, *of: (v, np.logical_and.reduce([known for _, known in of]))
    x, s = [column(v) for v in label[:, :k].T], [column(v) for v in np.sort(label, 1)[:, :k].T]
    every = np.ones(t, bool)
    with np.errstate(over="ignore"):  # of missing labels
        gaps = [both(s[i + 1][0] - s[i][0], s[i], s[i + 1]) for i in range(k - 1)]
        out: list[tuple[str, str, list, bool]] = [("label", "", x, False), ("special", "", [(special.fill_null(0).to_numpy(), special.is_valid().to_numpy())], False)]
        out.append(("pair", "", [both(s[i][0] * size + s[j][0], s[i], s[j]) for i in range(k) for j in range(i + 1, k)], False))
        out.append(("triple", "", [both((s[h][0] * size + s[i][0]) * size + s[j][0], s[h], s[i], s[j]) for h in range(k) for i in range(h + 1, k) for j in range(i + 1, k)], False))
        out += [("place", str(i + 1), [v], False) for i, v in enumerate(x)]
        out += [("next" if j == i + 1 else "apart", f"{i + 1} {j + 1}", [both(x[i][0] * size + x[j][0], x[i], x[j])], False) for i in range(k) for j in range(k) if i != j]
        out += [("category", "", x, True)] + [("category place", f" {i + 1}", [v], True) for i, v in enumerate(x)]
        adjacent = sum(((g == 1) & known).astype("i8") for g, known in gaps)
        odd = sum(((v % 2 != 0) & known).astype("i8") for v, known in x)
        least = np.minimum.reduce([np.where(known, g, MISSING) for g, known in gaps])
        most = np.maximum.reduce([np.where(known, g, -MISSING) for g, known in gaps])
        some = np.logical_or.reduce([known for _, known in gaps])
        values = (both(sum(v for v, _ in x), *x), both(s[-1][0] - s[0][0], s[0], s[-1]), (adjacent, every), (least, some), (most, some), (odd, every))
        out += [(q, "", [v], False) for q, v in zip(QUANTITIES, values)]
    pools, cats = (draws.column(c).combine_chunks().dictionary_encode("encode") for c in ("pool", "cat"))
    pool, cat = pools.indices.to_numpy(), cats.indices.to_numpy()
    names = cats.dictionary.to_pylist()
    for kind, sub, columns, split in out:
        g, groups = (pool * np.int64(len(names)) + cat, len(pools.dictionary) * len(names)) if split else (pool, len(pools.dictionary))
        group, key, c = _tally(g, groups, columns)
        of = np.array([f"{name}{sub}" for name in names])[group % len(names)] if split else np.full(len(key), sub)
        at = pa.array(group // len(names) if split else group)
        yield pa.RecordBatch.from_arrays([pools.dictionary.take(at), pa.array(np.full(len(key), kind), pa.string()), pa.array(of, pa.string()), pa.array(key), pa.array(c)], names=["pool", "kind", "sub", "key", "c"])


def _tally(g: np.ndarray, groups: int, columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, key and count of the known values of the columns."""
    seen = [v[known] for v, known in columns if known.any()]
    if not seen:
        return (np.empty(0, "i8"),) * 3
    low, high = min(int(v.min()) for v in seen), max(int(v.max()) for v in seen)
    span = high - low + 1
    if groups * span > DENSE:
        found, c = np.unique(np.stack([np.concatenate([g[known] for _, known in columns if known.any()]), np.concatenate(seen)]), axis=1, return_counts=True)
        return found[0].astype("i8"), found[1], c.astype("i8")
    count = np.zeros(groups * span, "i8")
    for v, known in columns:
        count += np.bincount((g * np.int64(span) + (v - low))[known], minlength=len(count))
    found = np.flatnonzero(count)
    return found // span, found % span + low, count[found]


def from_cells(counts: DataFrame, m: Matrix) -> DataFrame:
    """pool, n, categories and a column for each statistic that sums over cells give. counts should be written: it is read thrice."""
    size, k, c = m.n, m.k, F.col("c").cast("double")
    key = F.col("key").cast("double")
    sums = counts.groupBy("pool", "kind", "sub").agg(F.sum(c).alias("s1"), F.sum(c * c).alias("s2"), F.max("c").alias("hi"), F.min("c").alias("lo"), F.count(F.lit(1)).alias("seen"), F.sum(c * key).alias("v1"), F.sum(c * key * key).alias("v2"))
    ordered = size * (size - 1)
    among = F.create_map(*[F.lit(v) for kv in {"label": size, "special": m.specials, "place": size, "next": ordered, "apart": ordered, "category": size, "category place": size}.items() for v in kv])[F.col("kind")].cast("double")
    mu = F.col("s1") / among
    # Over cells with a mean of mu, unseen ones included: sum (c - mu)^2 / mu = sum c^2 / mu - sum c.
    chi2 = F.col("s2") / mu - F.col("s1")
    # Pairs of one label at two places can't occur and still add their expectation.
    chi2 = F.when(F.col("kind").isin("next", "apart"), chi2 + size * mu).otherwise(chi2)
    share = F.when(F.col("kind").isin("label", "category"), F.lit(k / size)).otherwise(1 / among)
    lowest = F.when((F.col("seen") < among) | F.col("kind").isin("next", "apart"), 0).otherwise(F.col("lo"))
    z = F.greatest(F.abs(F.col("hi") - mu), F.abs(lowest - mu)) / F.sqrt(mu * (1 - share))
    s = sums.withColumns({"chi2": chi2, "z": z, "lowest": lowest})
    of = lambda f, kinds, col: f(F.when(F.col("kind").isin(*([kinds] if isinstance(kinds, str) else kinds)), F.col(col)))
    var = lambda q: of(F.max, q, "v2") - of(F.max, q, "v1") * of(F.max, q, "v1") / of(F.max, q, "s1")
    n = of(F.max, QUANTITIES[0], "s1")
    wanted = {
        "fs001": of(F.sum, "label", "chi2"), "fs002": of(F.max, "label", "z"), "fs003": of(F.max, "label", "hi"), "fs004": of(F.min, "label", "lowest"), "fs005": of(F.max, "pair", "hi"),
        "fs009": of(F.sum, "special", "chi2"), "fs010": of(F.max, "special", "z"), "fs012": var("draw_sum") / (n - 1), "fs013": var("odd_count") / (n - 1), "p3s001": of(F.max, "triple", "hi"),
        "p3s011": of(F.max, "place", "z"), "p3s012": of(F.sum, "category", "chi2"), "p3b_s001": of(F.sum, "place", "chi2"), "p3b_s002": of(F.max, "place", "z"), "p3b_s004": of(F.sum, "next", "chi2"),
        "p3b_s005": of(F.max, ("next", "apart"), "z"), "p3b_s010": of(F.sum, "category place", "chi2"),
    }
    one = s.groupBy("pool").agg(n.alias("n"), F.count_if(F.col("kind") == "category").cast("double").alias("categories"), *[v.alias(name) for name, v in wanted.items()])
    # Distances from exact distributions, over the whole support.
    pmfs = {"draw_sum": exact.sum_pmf(m), "range": exact.range_pmf(m), "adjacent_pairs": exact.adjacent_pmf(m), "min_spacing": exact.min_spacing_pmf(m), "max_spacing": exact.max_spacing_pmf(m), "odd_count": exact.odd_pmf(m), "place": uniform(m)}
    points, rows = counts.sparkSession, []
    for kind, pmf in pmfs.items():
        f0 = 0.0
        for x, p in sorted(pmf.items()):
            f0 += p
            rows.append((kind, x, p, f0))
    grid = F.broadcast(points.createDataFrame(rows, "kind string, key long, p double, f0 double"))  # a few hundred points
    cum = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("pool", "kind", "sub").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) / F.col("s1")
    far = sums.select("pool", "kind", "sub", "s1").join(grid, "kind").join(counts, ["pool", "kind", "sub", "key"], "left").withColumn("d", cum - F.col("f0"))
    far = far.groupBy("pool", "kind", "sub").agg(F.sum(F.col("p") * F.col("d") * F.col("d")).alias("t"))
    far = far.groupBy("pool").agg(*[F.max(F.when(F.col("kind") == q, F.col("t"))).alias(name) for q, name in [*zip(QUANTITIES, (f"p3s{i:03d}" for i in range(5, 11))), ("place", "p3b_s003")]])
    joint = counts.where("kind = 'next'").withColumns({"a": F.floor(F.col("key") / (m.high + 1)), "b": F.col("key") % (m.high + 1)}).where("a <> b")
    over = lambda *by: F.sum(c).over(Window.partitionBy("pool", "sub", *by))
    bits = joint.withColumns({"ca": over("a"), "cb": over("b"), "t": over()}).groupBy("pool", "sub").agg(F.sum(c / F.col("t") * F.log2(c * F.col("t") / (F.col("ca") * F.col("cb")))).alias("bits"))
    return one.join(far, "pool").join(bits.groupBy("pool").agg(F.max("bits").alias("p3b_s006")), "pool", "left")


def uniform(m: Matrix) -> dict[int, float]:
    return dict.fromkeys(range(m.low, m.high + 1), 1 / m.n)


def from_lags(hist: DataFrame, m: Matrix, lags: list[int], cross: list[int]) -> DataFrame:
    """pool, neighbours (pairs of draws that follow each other) and the statistics of draws some lags apart; one join."""
    places = [(j, k) for j in range(m.k) for k in range(m.k)]
    both = lagged(hist, lags, ["numbers", "special"])
    hits = [F.count_if(F.col("prev_numbers")[j] == F.col("numbers")[k]).alias(f"h{j}_{k}") for j, k in places]
    at = both.groupBy("pool", "lag").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size(F.array_intersect("numbers", "prev_numbers"))).alias("shared"), F.count_if(F.col("special") == F.col("prev_special")).alias("same"), *hits)
    mean, var = exact.moments(exact.overlap_pmf(m))
    n, p = F.col("pairs").cast("double"), 1 / m.n
    z = lambda j, k: F.abs(F.col(f"h{j}_{k}") - n * p) / F.sqrt(n * p * (1 - p))
    first = F.col("lag") == 1
    return at.groupBy("pool").agg(
        F.sum(F.when(first, n)).alias("neighbours"), F.sum(F.when(first, F.col("shared"))).alias("fs006"), F.sum(F.when(first, F.col("same"))).alias("fs011"),
        F.max(F.abs(F.col("shared") - n * mean) / F.sqrt(n * var)).alias("p3s002"), F.max(F.greatest(*[z(j, j) for j in range(m.k)])).alias("p3b_s007"),
        F.max(F.when(F.col("lag").isin(cross), F.greatest(*[z(j, k) for j, k in places]))).alias("p3b_s008"),
    )


def laws(m: Matrix, lags: list[int], cross: list[int], windows: list[int]) -> dict[str, tuple[str, str, str, list[tuple[str, str, str]]]]:
    """Statistic -> (law, a, b, terms) as SQL over n (draws), neighbours and categories.

    scaled: a chi-square scaled to mean a and deviation b; two: normal, two-sided; run: probability a for each place of the run, in
    any of the term's `ways`. The others are the most extreme of binomial counts, with terms (trials, probability, ways): max and min of
    counts, extreme of their absolute standard scores. Means and deviations are exact or asymptotic under an even law; ways are
    counted as if they didn't depend on each other, which makes p too large for windows that overlap.
    """
    k, size, special, p = m.k, m.n, m.specials, m.k / m.n
    num = lambda x: f"{float(x):.17e}"
    ways = lambda law, *terms: (law, "0", "1", [(str(t), num(q), str(w)) for t, q, w in terms])
    scaled = lambda a, b: ("scaled", a, b, [])
    two = lambda a, b: ("two", a, b, [])
    run = lambda q, w: ("run", num(q), "1", [("1", "0", w)])
    chi2 = lambda df: scaled(df, f"sqrt(2 * {df})")

    def variance(pmf):
        mean, v = exact.moments(pmf)
        m4 = sum((x - mean) ** 4 * q for x, q in pmf.items())
        return two(num(v), f"sqrt(({num(m4)} - {num(v * v)} * (n - 3) / (n - 1)) / n)")

    def distance(pmf):
        """Moments of n times the sum of p (F - F0)^2."""
        f, rows = 0.0, []
        for _, q in sorted(pmf.items()):
            f += q
            rows.append((q, f))
        mean = sum(q * f * (1 - f) for q, f in rows)
        var = 2 * sum(q * r * (min(f, g) - f * g) ** 2 for q, f in rows for r, g in rows)
        return scaled(f"{num(mean)} / n", f"{num(sqrt(var))} / n")

    overlap, overlap_var = exact.moments(exact.overlap_pmf(m))
    pairs, next_df, one = size * (size - 1), (k - 1) * (size * (size - 1) - 1), num(1 / special)
    even = {"p3s005": exact.sum_pmf(m), "p3s006": exact.range_pmf(m), "p3s007": exact.adjacent_pmf(m), "p3s008": exact.min_spacing_pmf(m), "p3s009": exact.max_spacing_pmf(m), "p3s010": exact.odd_pmf(m)}
    return {
        "fs001": scaled(num(size - k), num((size - k) * sqrt(2 / (size - 1)))), "fs002": ways("extreme", ("n", p, size)), "fs003": ways("max", ("n", p, size)), "fs004": ways("min", ("n", p, size)),
        "fs005": ways("max", ("n", exact.inclusion(m, 2), comb(size, 2))), "fs006": two(f"neighbours * {num(overlap)}", f"sqrt(neighbours * {num(overlap_var)})"),
        "fs007": run(1 - p, f"{size} * (n * {num(p)} + 1)"), "fs008": run(p, f"{size} * n * {num(1 - p)}"), "fs009": chi2(num(special - 1)), "fs010": ways("extreme", ("n", 1 / special, special)),
        "fs011": two(f"neighbours * {one}", f"sqrt(neighbours * {one} * (1 - {one}))"), "fs012": variance(exact.sum_pmf(m)), "fs013": variance(exact.odd_pmf(m)),
        "p3s001": ways("max", ("n", exact.inclusion(m, 3), comb(size, 3))), "p3s002": ("normal", "0", "1", [("1", "0", str(len(lags)))]), "p3s003": run(1 - p, str(size)),
        "p3s004": ways("extreme", *[(w, p, f"{size} * n") for w in windows]), **{name: distance(pmf) for name, pmf in even.items()}, "p3s011": ways("extreme", ("n", 1 / size, k * size)),
        "p3s012": scaled(f"categories * {num(size - k)}", f"{num((size - k) * sqrt(2 / (size - 1)))} * sqrt(categories)"),
        "p3b_s001": chi2(num(k * (size - 1))), "p3b_s002": ways("extreme", ("n", 1 / size, k * size)), "p3b_s003": ("most", *distance(uniform(m))[1:3], [("1", "0", str(k))]),
        "p3b_s004": two(f"{num(next_df)} + n * {num((k - 1) / (size - 1))}", f"sqrt({num(2 * next_df)} * (1 - 1 / n))"), "p3b_s005": ways("extreme", ("n", 1 / pairs, k * (k - 1) * pairs)),
        "p3b_s007": ways("extreme", ("neighbours", 1 / size, k * len(lags))), "p3b_s008": ways("extreme", ("neighbours", 1 / size, k * k * len(cross))),
        "p3b_s009": ways("extreme", *[(w, 1 / size, f"{k * size} * n") for w in windows]), "p3b_s010": chi2(f"categories * {num(k * (size - 1))}"),
    }


#: Coefficients of a polynomial for the error function's complement, good to 1.2e-7 of the value.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _erfc(x: str) -> str:
    """exp(-x^2) t P(t), t = 1 / (1 + x / 2), for x >= 0."""
    t, poly = f"(1 / (1 + 5e-1 * {x}))", "0e0"
    for a in reversed(ERFC):
        poly = f"({a:.8e} + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def _upper(u: str) -> str:
    """The normal law's upper tail."""
    return f"CASE WHEN {u} < 0 THEN 1 - 5e-1 * {_erfc(f'(-({u}) / sqrt(2e0))')} ELSE 5e-1 * {_erfc(f'(({u}) / sqrt(2e0))')} END"


def _score(k: str, n: str, q: str) -> str:
    """The normal score of P(X <= k) for binomial X, by Peizer's and Pratt's approximation (good to a thousandth)."""
    g = lambda t: f"(CASE WHEN abs(1 - {t}) < 1e-6 THEN 0e0 ELSE (1 - {t} * {t} + 2 * {t} * ln({t})) / ((1 - {t}) * (1 - {t})) END)"
    d = f"({k} + 2e0 / 3e0 - ({n} + 1e0 / 3e0) * {q} + 2e-2 * ((1 - {q}) / ({k} + 1) - {q} / ({n} - {k}) + (5e-1 - {q}) / ({n} + 1)))"
    a, b = f"(({k} + 5e-1) / ({n} * {q}))", f"(({n} - {k} - 5e-1) / ({n} * (1 - {q})))"
    return f"{d} * sqrt((1 + (1 - {q}) * {g(a)} + {q} * {g(b)}) / (({n} + 1e0 / 6e0) * {q} * (1 - {q})))"


def steps(terms: int) -> dict[str, str]:
    """Columns from law, value, a, b, and n_i, q_i, ways_i of each term, in order; the same text for Spark and for DuckDB.
    expected is how many cells would be as extreme; p the chance that any is."""
    out = {
        "df": "2e0 * a * a / (b * b)",
        "z": "CASE WHEN law IN ('scaled', 'most') THEN (pow(value / a, 1e0 / 3e0) - (1 - 2e0 / (9e0 * df))) / sqrt(2e0 / (9e0 * df)) WHEN law = 'two' THEN (value - a) / b WHEN law IN ('extreme', 'normal') THEN value WHEN law IN ('max', 'min') THEN (value - n_0 * q_0) / sqrt(n_0 * q_0 * (1 - q_0)) END",
        "u": "CASE WHEN law IN ('two', 'normal') THEN abs(z) WHEN law IN ('scaled', 'most') THEN z ELSE 0e0 END",
        "normal": _upper("u"),
    }
    sums = []
    for i in range(terms):
        n, q = f"n_{i}", f"q_{i}"
        sd = f"sqrt({n} * {q} * (1 - {q}))"
        # The least count that is so large, less one, and the greatest that is so small.
        out[f"high_{i}"] = f"CASE WHEN law = 'extreme' THEN ceil({n} * {q} + value * {sd} - 1e-6) - 1 WHEN law = 'max' THEN value - 1 END * 1e0"
        out[f"low_{i}"] = f"CASE WHEN law = 'extreme' THEN floor({n} * {q} - value * {sd} + 1e-6) WHEN law = 'min' THEN value END * 1e0"
        out[f"uh_{i}"] = f"CASE WHEN high_{i} >= 0 AND high_{i} < {n} THEN {_score(f'high_{i}', n, q)} END"
        out[f"ul_{i}"] = f"CASE WHEN low_{i} >= 0 AND low_{i} < {n} THEN -({_score(f'low_{i}', n, q)}) END"
        for side in ("h", "l"):
            out[f"t{side}_{i}"] = f"CASE WHEN u{side}_{i} IS NULL THEN 0e0 ELSE {_upper(f'u{side}_{i}')} END"
        sums.append(f"ways_{i} * (th_{i} + tl_{i})")
    out["expected"] = f"CASE law WHEN 'run' THEN ways_0 * pow(a, value) WHEN 'normal' THEN ways_0 * 2e0 * normal WHEN 'most' THEN ways_0 * normal ELSE {' + '.join(sums)} END"
    out["p"] = "CASE WHEN law = 'scaled' THEN normal WHEN law = 'two' THEN 2e0 * normal WHEN expected < 1e-6 THEN expected ELSE 1 - exp(-expected) END"
    return out


def statistics(hist: DataFrame, counts: DataFrame, m: Matrix, lags: list[int], cross: list[int], windows: list[int]) -> DataFrame:
    """pool, n, neighbours, categories and a column for each statistic. hist and counts (cells of it) should be written tables."""
    out = from_cells(counts, m).join(from_lags(hist, m, lags, cross), "pool", "left").fillna(0, ["neighbours", "fs006", "fs011", "p3s002", "p3b_s007", "p3b_s008"])
    p = m.k / m.n
    for name, part in {"fs007": drought(hist, m), "fs008": streak(hist), "p3s003": terminal(hist, m), "p3s004": max_rolling(hist, windows, p, m.n, ["label"]), "p3b_s009": rolling(hist, m, windows)}.items():
        out = out.join(part.select("pool", F.col("value").alias(name)), "pool")
    return out


def law_columns(names: list[str], known: dict) -> tuple[list[str], dict[str, list[str]]]:
    """Names of the laws' columns (a, b, then n, q and ways of every term), and each statistic's law and their SQL."""
    terms = max(1, *(len(x[3]) for x in known.values()))
    columns = ["a", "b", *(f"{c}_{i}" for i in range(terms) for c in ("n", "q", "ways"))]
    values = {}
    for c in names:
        law, a, b, own = known.get(c, ("none", "0", "1", []))
        values[c] = [law, a, b, *(x for t in [*own, *[("1", "5e-1", "0")] * (terms - len(own))] for x in t)]
    return columns, values


def family_table(stats: DataFrame, m: Matrix, lags: list[int], cross: list[int], windows: list[int], alpha: float = 0.05, least_z: float = 2.5) -> DataFrame:
    """pool, family, statistic, value, z, p, bh_q, bh_reject, holm_p, holm_reject and promoted, for every statistic of every pool.

    Statistics are adjusted within their family. One without a law (mutual information) has its value only, and z is null for runs.
    promoted: rejected by BH, and at least least_z large.
    """
    known = laws(m, lags, cross, windows)
    names = sorted(c for c in stats.columns if c.split("_")[0].rstrip("0123456789") in FAMILY)
    columns, values = law_columns(names, known)
    rows = F.array(*[F.struct(F.lit(FAMILY[c.split("_")[0].rstrip("0123456789")]).alias("family"), F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value"), F.lit(values[c][0]).alias("law"), *[F.expr(f"CAST({x} AS DOUBLE)").alias(name) for x, name in zip(values[c][1:], columns)]) for c in names])
    tests = stats.select("pool", F.inline(rows))
    # One row for each test: written every few columns, as the code of all of them at once is too long to compile.
    for i, (name, text) in enumerate(steps((len(columns) - 2) // 3).items()):
        tests = (cut(tests, "tests") if i % 3 == 0 else tests).withColumn(name, F.expr(text))
    tests = cut(tests.select("pool", "family", "statistic", "value", "law", "z", "p"), "tests")
    keep = ["pool", "family", "statistic", "value", "z", "p"]
    judged = inference.adjust(tests.where("law <> 'none'").select(*keep), ["family"], "p", ["pool", "statistic"], alpha)
    judged = judged.withColumn("promoted", F.col("bh_reject") & F.coalesce(F.abs("z") >= least_z, F.lit(False)))
    rest = tests.where("law = 'none'").select("pool", "family", "statistic", "value")
    return judged.unionByName(rest, allowMissingColumns=True)
