"""Statistics of small random histories against plain Python."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tumbler.functions import exact
from tumbler.functions.exact import Matrix
from tumbler.operators import history, positional, primary, secondary

SMALL = Matrix(3, 1, 10, 4)


def make(seed):
    """pool -> list of segments, each a list of (numbers in drawing order, special); and the table with gaps between."""
    rng, rows, pools, i = random.Random(seed), [], {}, 0
    for pool in ("A", "B", "C"):
        pools[pool], when = [], dt.datetime(2024, 1, 1)
        for _ in range(rng.randint(1, 5)):
            seg = []
            for _ in range(rng.choice([1, 2, 7, 15, 40])):
                n, s = rng.sample(range(1, 11), 3), rng.randint(1, 4)
                seg.append((n, s))
                when += dt.timedelta(hours=rng.choice([0, 1, 30]))
                rows.append((pool, i, when, n, s, True))
                i += 1
            pools[pool].append(seg)
            rows.append((pool, i, when, [1, 2, 3], 1, rng.choice([False, None])))
            i += 1
    rng.shuffle(rows)
    return pools, rows


@pytest.fixture(scope="module", params=[1, 2, 3])
def both(request, spark):
    pools, rows = make(request.param)
    df = spark.createDataFrame(rows, "pool string, draw_id long, t timestamp, numbers array<int>, special int, eligible boolean")
    return pools, history.segmented(df).persist()


def values(df, column="value"):
    return {r["pool"]: r[column] for r in df.collect()}


def runs(seg, hit):
    best = now = 0
    for x in seg:
        now = now + 1 if hit(x) else 0
        best = max(best, now)
    return best


def check(got, pools, f):
    assert {k: pytest.approx(v, abs=1e-9) for k, v in got.items()} == {p: f(segs, [d for s in segs for d in s]) for p, segs in pools.items()}


def test_segments(both):
    pools, h = both
    got = {p: [] for p in pools}
    for r in history.segments(h).orderBy("pool", "seg").collect():
        got[r["pool"]].append(r["seg_len"])
    assert got == {p: [len(s) for s in segs] for p, segs in pools.items()}


def test_frequency(both):
    pools, h = both
    f, p = primary.frequency(h, SMALL).persist(), 0.3
    counts = lambda draws: [sum(x in n for n, _ in draws) for x in range(1, 11)]
    check(values(f, "chi2"), pools, lambda _, d: sum((c - len(d) * p) ** 2 / (len(d) * p) for c in counts(d)))
    check(values(f, "max_z"), pools, lambda _, d: max(abs(c - len(d) * p) for c in counts(d)) / math.sqrt(len(d) * p * (1 - p)))
    check(values(f, "min_c"), pools, lambda _, d: min(counts(d)))
    pair = lambda d, k: max(Counter(c for n, _ in d for c in itertools.combinations(sorted(n), k)).values())
    check(values(primary.combinations(h, 2, SMALL).groupBy("pool").agg(F.max("c").alias("value"))), pools, lambda _, d: pair(d, 2))
    check(values(primary.combinations(h, 3, SMALL).groupBy("pool").agg(F.max("c").alias("value"))), pools, lambda _, d: pair(d, 3))


def test_runs(both):
    pools, h = both
    check(values(primary.drought(h, SMALL)), pools, lambda segs, _: max(runs(s, lambda x: lab not in x[0]) for s in segs for lab in range(1, 11)))
    check(values(primary.streak(h)), pools, lambda segs, _: max(runs(s, lambda x: lab in x[0]) for s in segs for lab in range(1, 11)))
    check(values(secondary.terminal(h, SMALL)), pools, lambda segs, _: max(next((i for i, x in enumerate(reversed(segs[-1])) if lab in x[0]), len(segs[-1])) for lab in range(1, 11)))


def test_serial(both):
    pools, h = both
    check(values(primary.special_repeats(h)), pools, lambda segs, _: sum(a[1] == b[1] for s in segs for a, b in zip(s, s[1:])))
    mean, var = exact.moments(exact.overlap_pmf(SMALL))

    def lag_z(segs, lag):
        pairs = [(a, b) for s in segs for a, b in zip(s, s[lag:])]
        return abs(sum(len(set(a[0]) & set(b[0])) for a, b in pairs) - len(pairs) * mean) / math.sqrt(len(pairs) * var) if pairs else 0.0

    check(values(secondary.max_lag(h, SMALL, [1, 2, 5])), pools, lambda segs, _: max(lag_z(segs, k) for k in (1, 2, 5)))

    def hits(segs, cross):
        out = [0.0]
        for lag in (1, 2):
            pairs = [(a, b) for s in segs for a, b in zip(s, s[lag:])]
            for j, k in itertools.product(range(3), repeat=2):
                if pairs and (cross or j == k):
                    out.append(abs(sum(a[0][j] == b[0][k] for a, b in pairs) - len(pairs) / 10) / math.sqrt(len(pairs) * 0.09))
        return max(out)

    check(values(positional.max_serial(h, SMALL, [1, 2], False)), pools, lambda segs, _: hits(segs, False))
    check(values(positional.max_serial(h, SMALL, [1, 2], True)), pools, lambda segs, _: hits(segs, True))


def test_rolling(both):
    pools, h = both

    def rolled(segs, cells, p):
        out = [0.0]
        for s, w in itertools.product(segs, (2, 5, 12)):
            for i in range(len(s) - w + 1):
                out += [abs(sum(cell(x) for x in s[i : i + w]) - w * p) / math.sqrt(w * p * (1 - p)) for cell in cells]
        return max(out)

    sets = [lambda x, lab=lab: lab in x[0] for lab in range(1, 11)]
    check(values(secondary.max_rolling(h, [2, 5, 12], 0.3, 10, ["label"])), pools, lambda segs, _: rolled(segs, sets, 0.3))
    places = [lambda x, j=j, lab=lab: x[0][j] == lab for j in range(3) for lab in range(1, 11)]
    check(values(positional.rolling(h, SMALL, [2, 5, 12])), pools, lambda segs, _: rolled(segs, places, 0.1))


def test_positional(both):
    pools, h = both
    cells = lambda d: Counter((j, x) for n, _ in d for j, x in enumerate(n))
    check(values(positional.omnibus(h, SMALL), "chi2"), pools, lambda _, d: sum((cells(d)[j, x] - len(d) / 10) ** 2 / (len(d) / 10) for j in range(3) for x in range(1, 11)))

    def moves(_, d):
        e, c = len(d) / 90, Counter((j, n[j], n[j + 1]) for n, _ in d for j in range(2))
        return sum((c[j, a, b] - e) ** 2 / e for j in range(2) for a in range(1, 11) for b in range(1, 11))

    check(values(positional.transitions(h, SMALL)), pools, moves)

    def bits(_, d):
        out = []
        for j in range(2):
            c, n = Counter((x[j], x[j + 1]) for x, _ in d), len(d)
            a, b = Counter(x[j] for x, _ in d), Counter(x[j + 1] for x, _ in d)
            out.append(sum(v / n * math.log2(v * n / (a[x] * b[y])) for (x, y), v in c.items()))
        return max(out)

    check(values(positional.information(h, SMALL)), pools, bits)


def test_exact_enumeration():
    draws = list(itertools.combinations(range(1, 11), 3))
    share = lambda f: {k: pytest.approx(v / len(draws)) for k, v in Counter(map(f, draws)).items()}
    assert exact.sum_pmf(SMALL) == share(sum)
    assert exact.range_pmf(SMALL) == share(lambda d: d[2] - d[0])
    assert exact.odd_pmf(SMALL) == share(lambda d: sum(x % 2 for x in d))
    assert exact.overlap_pmf(SMALL) == share(lambda d: len({1, 2, 3} & set(d)))
    gaps = lambda d: (d[1] - d[0], d[2] - d[1])
    assert exact.adjacent_pmf(SMALL) == share(lambda d: gaps(d).count(1))
    assert exact.min_spacing_pmf(SMALL) == share(lambda d: min(gaps(d)))
    assert exact.max_spacing_pmf(SMALL) == share(lambda d: max(gaps(d)))
    assert exact.no_neighbours(SMALL) == pytest.approx(sum(d[1] - d[0] > 1 and d[2] - d[1] > 1 for d in draws) / len(draws))
    assert exact.inclusion(SMALL, 2) == pytest.approx(sum({1, 2} <= set(d) for d in draws) / len(draws))
    assert exact.inclusion(Matrix(2, 1, 9), 3) == 0.0
    assert sum(exact.match_pmf(SMALL).values()) == pytest.approx(1)
    # Published sizes of the 5/69+26, 5/70+24 and 6/53 games.
    assert [exact.space(m) for m in (Matrix(5, 1, 69, 26), Matrix(5, 1, 70, 24), Matrix(6, 1, 53))] == [292_201_338, 290_472_336, 22_957_480]
    with pytest.raises(ValueError):
        Matrix(3, 5, 5)


def test_walks_by_buckets_match_the_features(spark, monkeypatch):
    """Hits and scores of walked() against features(), over buckets of 7 draws; no plan holds draws times labels."""

    from tumbler.functions.exact import Matrix
    from tumbler.operators import models

    monkeypatch.setattr(models, "BUCKET", 7)
    monkeypatch.setattr(models, "REACH", 40)
    monkeypatch.setattr(models, "WARMUP", 10)
    m, rng = Matrix(3, 1, 25), random.Random(6)
    rows = [("AB"[i % 2], i, rng.sample(range(1, 26), 3)) for i in range(120)]
    h = spark.createDataFrame(rows, "pool string, draw_id long, numbers array<long>").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(draw_id div 20 as int))"))
    f = {}
    for r in models.features(h, m).where("n >= 10").collect():
        f.setdefault((r["pool"], r["draw_id"]), []).append(r)
    for by in ("c", "decayed"):
        w = models.walked(h, m, by=by)
        got = {(r["pool"], r["draw_id"]): r for r in w.collect()}
        assert set(got) == set(f) and len(got) == 100
        for k, cells in f.items():
            ranked = sorted(cells, key=lambda r: (-r[by] if by == "c" else -round(r[by], 9), r["label"]))
            assert [got[k][f"hits{s}"] for s in (10, 15, 20)] == [sum(r["hit"] for r in ranked[:s]) for s in (10, 15, 20)]
            weights = {r["label"]: (r["c"] + 100 * 3 / 25) / (r["n"] + 100) / (3 / 25) for r in cells}
            e = [1.0, 0.0, 0.0, 0.0]
            for x in weights.values():
                e = [e[0], *(e[j] + x * e[j - 1] for j in (1, 2, 3))]
            want = sum(math.log(weights[r["label"]]) for r in cells if r["hit"]) - math.log(e[3]) + math.log(math.comb(25, 3))
            assert abs(got[k]["log_frequency"] - want) < 1e-9
    assert "Generate" not in w._jdf.queryExecution().optimizedPlan().toString()
