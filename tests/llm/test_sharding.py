"""Operator 9: the hypergeometric law, exact sizes, uniform shards, awkward columns."""

import itertools
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, rows, saved, table
from tumbler.llm import sharding


def chi2(have, want):
    return sum((a - b) ** 2 / b for a, b in zip(have, want))


@pytest.mark.parametrize("good, bad, n", [(5, 7, 4), (30, 10, 25), (3, 900, 40), (1, 1, 1)])
def test_hypergeometric_matches_counting(good, bad, n):
    pmf = [comb(good, x) * comb(bad, n - x) / comb(good + bad, n) for x in range(n + 1)]
    edges = np.concatenate([[0], np.cumsum(pmf)])
    for x, p in enumerate(pmf):
        if p > 1e-9:  # u just inside both ends of x's share of [0, 1)
            assert {sharding.hypergeometric(good, bad, n, edges[x] + p * q) for q in (0.001, 0.999)} == {x}


def test_hypergeometric_beyond_any_limit():
    # A population of 10**13: moments of the law, and the whole population when all is drawn.
    good, bad, n, rng = 3 * 10**12, 7 * 10**12, 10**6, np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(good, bad, n, u) for u in rng.random(4000)])
    assert abs(x.mean() - 0.3 * n) < 5 * np.sqrt(0.21 * n / 4000) and abs(x.var() / (0.21 * n) - 1) < 0.12
    assert sharding.hypergeometric(good, bad, good + bad, 0.7) == good and sharding.hypergeometric(0, 5, 3, 0.2) == 0


def test_matrix_law_by_chi_square():
    # All matrices with these sums, by how many permutations give each.
    sizes, shares = [3, 2], [2, 2, 1]
    labels = [s for s, c in enumerate(shares) for _ in range(c)]
    want = Counter(tuple(tuple(p[a:b].count(s) for s in range(3)) for a, b in ((0, 3), (3, 5))) for p in itertools.permutations(labels))
    have = Counter(tuple(map(tuple, sharding.communication_matrix(sizes, shares, seed))) for seed in range(6000))
    assert set(have) == set(want)
    share = 6000 / sum(want.values())
    assert chi2([have[k] for k in want], [want[k] * share for k in want]) < len(want) + 4 * np.sqrt(2 * len(want))
    m = sharding.communication_matrix([7, 0, 13, 1], [7, 7, 7], 1)
    assert m.sum(1).tolist() == [7, 0, 13, 1] and m.sum(0).tolist() == [7, 7, 7]


def test_exact_gapless_and_repeatable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 5)
    sf = saved(spark, tmp_path)
    out = sharding.op9_shard_matrix(spark, sf, 4).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, sharding.op9_shard_matrix(spark, sf, 4).collect()))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(len(rows()) // 4 + (s < len(rows()) % 4)))


def test_every_row_is_as_likely_in_every_place(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 3)
    df = spark.range(12).select(F.col("id"))
    place, together = Counter(), 0
    for seed in range(24):
        got = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, ["id"], 3, seed).collect()}
        place.update((i, s) for i, (s, _) in got.items())
        together += sum(got[a][0] == got[b][0] for a, b in itertools.combinations(range(12), 2))
    assert chi2([place[i, s] for i in range(12) for s in range(3)], [8] * 36) < 24 + 4 * np.sqrt(48)
    assert abs(together / 24 - 66 * 3 / 11) < 1.5  # two rows share one of three shards of four with probability 3/11


def test_awkward_tables(spark):
    df = clashing(table(spark))  # has columns shard and slot
    out = sharding.shard_rows(df.withColumn("sh_part", F.lit(1)), ["doc_id"], 3)
    assert out.count() == df.count() and dict(out.dtypes)["shard"] == "int" and "sh_part" in out.columns
    assert sharding.shard_rows(sharding.digest(clashing(table(spark)).limit(0)), ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, "x" * 300_000)], "doc_id long, text string")
    assert sorted(r["size"] for r in sharding.shard_rows(sharding.digest(odd), ["doc_id", "size"], 2).collect()) == [1, 1, 300_001]
