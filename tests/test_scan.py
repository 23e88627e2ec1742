"""Bucketed scans against plain loops, with buckets far smaller than segments."""

import random
from itertools import groupby

import pytest

from tumbler.functions.exact import Matrix
from tumbler.operators import positional, primary, scan, secondary
from tumbler.operators.history import segmented

M = Matrix(3, 1, 9)


@pytest.fixture(params=[1, 2, 5, 1024])
def bucket(request, monkeypatch):
    monkeypatch.setattr(scan, "BUCKET", request.param)
    return request.param


def hits_of(seed):
    rng = random.Random(seed)
    rows = {}
    for key in range(30):
        length, density = rng.randint(1, 60), rng.choice([0.05, 0.5, 0.9, 1.0])
        places = [i for i in range(1, length + 1) if rng.random() < density] or [rng.randint(1, length)]
        rows[key] = (length, places)
    return rows


def longest(flags):
    return max((len(list(g)) for f, g in groupby(flags) if f), default=0)


def test_runs_and_gaps(spark, bucket):
    rows = hits_of(bucket)
    df = spark.createDataFrame([(k, n, i) for k, (n, at) in rows.items() for i in at], "key int, length int, at int").repartition(3)
    gaps = {r["key"]: r["gap"] for r in scan.longest_gaps(df, ["key"], "at", "length").collect()}
    runs = {r["key"]: r["run"] for r in scan.longest_runs(df, ["key"], "at").collect()}
    assert gaps == {k: longest([i not in at for i in range(1, n + 1)]) for k, (n, at) in rows.items()}
    assert runs == {k: longest([i in at for i in range(1, n + 1)]) for k, (n, at) in rows.items()}
    assert scan.longest_runs(df.limit(0), ["key"], "at").count() == scan.longest_gaps(df.limit(0), ["key"], "at", "length").count() == 0


def history(spark, seed):
    rng = random.Random(seed)
    rows = [(p, i, [rng.choice([1, 2, 3]), *rng.sample(range(4, 10), 2)], rng.random() > 0.04) for p in "ab" for i in range(90)]
    df = spark.createDataFrame(rows, "pool string, draw_id long, numbers array<long>, eligible boolean")
    return rows, segmented(df.selectExpr("*", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(draw_id div 7 as int)) AS t"))


def segments(rows, pool):
    mine = [r for r in rows if r[0] == pool]
    return [[set(r[2]) for r in g] for ok, g in groupby(mine, key=lambda r: r[3]) if ok]


def test_statistics_of_long_segments(spark, bucket):
    rows, h = history(spark, bucket)
    for name, got in (("drought", primary.drought(h, M)), ("streak", primary.streak(h))):
        want = {p: max(longest([(label in d) == (name == "streak") for d in s]) for s in segments(rows, p) for label in range(1, 10)) for p in "ab"}
        assert {r["pool"]: r["value"] for r in got.collect()} == want, name
    windows = [2, 7, 30]
    got = {(r["pool"], r["w"]): (r["most"], r["least"]) for r in secondary.rolling_extremes(h, 9, windows, ["label"]).collect()}
    for p in "ab":
        for w in windows:
            counts = [sum(label in d for d in s[i : i + w]) for s in segments(rows, p) for label in range(1, 10) for i in range(len(s) - w + 1)]
            assert got.get((p, w)) == ((max(counts), min(counts)) if counts else None)


def test_argmax_does_not_depend_on_buckets(spark, bucket, monkeypatch):
    _, h = history(spark, 3)
    rows = lambda: sorted(map(tuple, positional.rolling_argmax(h, M, [2, 7, 30]).collect()))
    got = rows()
    monkeypatch.setattr(scan, "BUCKET", 4096)
    assert got == rows() and len(got) > 10


def test_streaks_are_of_shared_labels(spark, bucket):
    """Of a draw's labels only those of the draw before it too are rows; a missing label is none, and a pool of single draws has 1."""
    draws = [("a", [1, None, 2]), ("a", [3, None, 4]), ("a", [3, 5, 5]), ("a", [5, 3, 6]), ("b", [1, 2, 3]), ("b", [4, 5, 6]), ("c", [None, None, None]), ("d", None)]
    h = segmented(spark.createDataFrame([(p, i, n, True) for i, (p, n) in enumerate(draws)], "pool string, draw_id long, numbers array<long>, eligible boolean").selectExpr("*", "timestamp_ntz'2024-01-01' AS t"))
    got = primary.streak(h)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_intersect(" in plan and "explode(numbers" not in plan
    assert {r["pool"]: r["value"] for r in got.collect()} == {"a": 3, "b": 1}
