"""Multiple testing against brute force, and without a window over a family."""

import random
import re

from tumbler.operators import inference


def brute(tests, alpha=0.05):
    out = {}
    for family in {f for f, _, _ in tests}:
        t = sorted((p, i) for f, i, p in tests if f == family)
        m = len(t)
        last = max((r for r, (p, _) in enumerate(t, 1) if p <= r * alpha / m), default=0)
        stop = min((r for r, (p, _) in enumerate(t, 1) if p > alpha / (m - r + 1)), default=m + 1)
        for r, (_, i) in enumerate(t, 1):
            q = min([1.0, *(x * m / k for k, (x, _) in enumerate(t, 1) if k >= r)])
            holm = min(1.0, max(x * (m - k + 1) for k, (x, _) in enumerate(t, 1) if k <= r))
            out[family, i] = (round(q, 9), r <= last, round(holm, 9), r < stop)
    return out


def test_adjust_matches_brute_force(spark):
    rng = random.Random(3)
    tests = [(f, i, rng.choice([0.0, 1e-9, 1e-4, 0.01, 1.0, rng.random() ** 9, rng.random()])) for f, n in (("a", 300), ("b", 1), (None, 40)) for i in range(n)]
    out = inference.adjust(spark.createDataFrame(tests, "family string, test long, p double"), ["family"], "p", ["test"])
    assert set(out.columns) == {"family", "test", "p", "bh_q", "bh_reject", "holm_p", "holm_reject"}
    got = {(r.family, r.test): (round(r.bh_q, 9), r.bh_reject, round(r.holm_p, 9), r.holm_reject) for r in out.collect()}
    assert got == brute(tests)


def test_no_window_holds_a_family(spark):
    """Windows over tests are inside a bucket of p-values; those over a family only read one row for each bucket."""
    tests = spark.range(1000).selectExpr("id % 2 AS family", "id AS test", "(id + 1) / 2000 AS p")
    plan = inference.adjust(tests, ["family"], "p", ["test"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"[+:]- Window ", line)]
    assert windows
    for line in windows:
        by, order = re.findall(r"\], \[([^\]]*)\], \[([^\]]*)\]", line)[-1]
        assert re.search(r"__[kb]#", by + order), line
