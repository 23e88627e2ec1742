"""The shared battery: its law's p-values on fair draws, planted effects, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators import battery
from tumbler.operators.history import segmented
from tumbler.plans import views
from tumbler.scratch import cut

M = Matrix(3, 1, 15, 6)
LAGS, CROSS, WINDOWS = [1, 2, 3], [1, 2], [4, 9]


def history(spark, pools, draws, biased=()):
    rng, rows = np.random.default_rng(7), []
    for p in range(pools):
        for i in range(draws):
            # A biased pool repeats the draw before it half of the time.
            repeat = p in biased and i and rng.random() < 0.5
            numbers = rows[-1][2] if repeat else [int(x) + 1 for x in rng.permutation(15)[:3]]
            rows.append((p, i, numbers, int(rng.integers(1, 7)), i % 97 != 50, int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "pool long, draw_id long, numbers array<long>, special long, eligible boolean, machine long")
    df = df.withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(draw_id div 20 as int))"))
    return cut(segmented(df), "history")


@pytest.fixture(scope="module")
def table(spark):
    h = history(spark, 60, 250, biased=(0, 1))
    stats = battery.statistics(h, cut(battery.cells(h, M, "machine"), "cells"), M, LAGS, CROSS, WINDOWS)
    return battery.family_table(cut(stats, "statistics"), M, LAGS, CROSS, WINDOWS).toPandas()


def test_every_statistic_of_every_pool(table):
    assert len(table) == 60 * 35 and table.groupby("pool").statistic.nunique().eq(35).all()
    assert table[table.statistic == "p3b_s006"].p.isna().all() and table[table.statistic != "p3b_s006"].p.notna().all()
    assert table.p.dropna().between(0, 1).all()


def test_laws_hold_on_fair_draws(table):
    """On 58 fair pools a tenth of the p-values is below 0.1 at most, but for chance; where laws are exact enough, about half below 0.5."""
    fair = table[~table.pool.isin([0, 1]) & table.p.notna()]
    for name, group in fair.groupby("statistic"):
        assert (group.p < 0.1).sum() <= 16, name
    for name in ("fs001", "fs006", "fs009", "fs011", "fs012", "fs013", "p3s005", "p3s006", "p3s009", "p3s012", "p3b_s001", "p3b_s004", "p3b_s010"):
        assert 13 <= (fair[fair.statistic == name].p < 0.5).sum() <= 45, name


def test_planted_repeats_are_promoted(table):
    found = table[table.statistic.isin(["fs006", "p3s002", "p3b_s007"])].set_index(["statistic", "pool"]).promoted
    assert all(found[s, p] for s in ("fs006", "p3s002", "p3b_s007") for p in (0, 1))
    assert (table[~table.pool.isin([0, 1])].promoted == True).sum() <= 3  # noqa: E712


def test_cells_are_one_scan_and_one_shuffle(spark):
    h = views.eligible(spark, "/root/testdata/sf0.001")
    plan = battery.cells(h, views.MATRIX, "machine")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_error_function():
    from math import erfc

    for x in (0.0, 0.3, 1.0, 3.0, 6.0):
        value = eval(battery._erfc("x").replace("exp", "__import__('math').exp"), {"x": x})
        assert value == pytest.approx(erfc(x), rel=2e-7)


def test_binomial_tails():
    from math import comb, sqrt

    code = {"__builtins__": {}, "sqrt": sqrt, "abs": abs, "ln": __import__("math").log, "exp": __import__("math").exp}
    score = battery._score("k", "n", "q").replace("CASE WHEN", "(lambda t: None) if False else (0.0 if").replace("THEN 0e0 ELSE", "else").replace(" END)", "))")
    for n, q in ((5, 0.02), (40, 0.1), (900, 1 / 2162), (900, 0.1)):
        for k in range(min(n, 130)):
            true = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1, n + 1))
            if 1e-12 < true < 1 - 1e-9:
                u = eval(score, code, {"k": k, "n": n, "q": q})
                got = 0.5 * __import__("math").erfc(u / sqrt(2))
                assert got == pytest.approx(true, rel=0.12, abs=1e-3) and (true > 1e-3 or got == pytest.approx(true, rel=0.3)), (n, q, k)


def test_many_permutations(spark):
    """Against every dealing of a small block, and the observed statistic against plain counts."""
    from itertools import permutations

    from tumbler.operators import models

    m = Matrix(2, 1, 4)
    rows = [("p", "x", 0, [1, 2], 0), ("p", "x", 1, [1, 3], 0), ("p", "x", 2, [3, 4], 1), ("p", "x", 3, [2, 4], 1), ("p", "y", 4, [1, 4], 1), ("q", "x", 5, [1, 2], 0), ("p", "y", 6, [1, 2], None)]
    df = spark.createDataFrame(rows, "pool string, week string, draw_id long, numbers array<long>, machine long").repartition(3)
    got = models.permuted_margins(df, m, "week", "machine", 3000).toPandas()

    def chi2(cats):
        total = 0.0
        for c in (0, 1):
            mine = [r[3] for r, k in zip(rows[:5], cats) if k == c]
            e = len(mine) / 2
            total += sum((sum(label in x for x in mine) - e) ** 2 / e for label in range(1, 5)) if mine else 0
        return total

    mine = got[got.pool == "p"].set_index("permutation").chi2
    assert len(got) == 2 * 3001 and mine[0] == pytest.approx(chi2([0, 0, 1, 1, 1]))
    dealings = [round(chi2([*d, 1]), 9) for d in set(permutations([0, 0, 1, 1]))]
    for value in set(dealings):
        share = (mine[1:].round(9) == value).mean()
        assert share == pytest.approx(dealings.count(value) / len(dealings), abs=0.05)
    again = models.permuted_margins(df.repartition(5), m, "week", "machine", 3000).toPandas().set_index(["pool", "permutation"]).chi2
    assert again["p"].sort_index().tolist() == pytest.approx(mine.sort_index().tolist())


def test_cells_are_counted_where_draws_are_read(spark, monkeypatch):
    """Tasks send counts, not a row for every cell of a draw; missing labels, specials and categories are in no cell of theirs."""
    draws = [("a", [3, 1, 2], 4, 0), ("a", [3, None, 2], None, None), ("b", [15, 14, 7], 6, 2), ("a", [1, 2, 3], 4, 0), (None, None, 1, 1)]
    h = spark.createDataFrame(draws, "pool string, numbers array<long>, special long, machine long")
    got = battery.cells(h, M, "machine")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {tuple(r)[:4]: r["c"] for r in got.collect()}
    monkeypatch.setattr(battery, "DENSE", 0)
    assert found == {tuple(r)[:4]: r["c"] for r in battery.cells(h, M, "machine").collect()}
    of = lambda kind, pool: {(sub, key): c for (p, k, sub, key), c in found.items() if (p, k) == (pool, kind)}
    assert of("label", "a") == {("", 1): 2, ("", 2): 3, ("", 3): 3} and of("special", "a") == {("", 4): 2} and of("special", None) == {("", 1): 1}
    assert of("pair", "a") == {("", 18): 2, ("", 19): 2, ("", 35): 3} and of("triple", "a") == {("", 291): 2}
    assert of("next", "a") == {("1 2", 49): 1, ("1 2", 18): 1, ("2 3", 18): 1, ("2 3", 35): 1} and of("apart", "b")[("3 1", 127)] == 1
    assert of("category", "a")[("-", 3)] == 1 and of("category place", "a")[("0 1", 3)] == 1 and of("category place", "b") == {("2 1", 15): 1, ("2 2", 14): 1, ("2 3", 7): 1}
    assert of("draw_sum", "a") == {("", 6): 2} and of("range", "a") == {("", 2): 2} and of("adjacent_pairs", "a") == {("", 2): 2, ("", 1): 1}
    assert of("min_spacing", "a") == {("", 1): 3} and of("max_spacing", "b") == {("", 7): 1} and of("odd_count", "a") == {("", 2): 2, ("", 1): 1}
