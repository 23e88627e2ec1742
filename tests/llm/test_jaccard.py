"""Operator 3 against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.fixtures import clashing, rows, saved, table
from tumbler.llm import jaccard_join
from tumbler.llm.components import components


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def family(seed):
    """Near copies that chain, a common template with different ends, exact copies, and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, base, template = [], words(rng.choice([30, 80, 200])), words(60)
    for _ in range(25):
        base = list(base)
        base[rng.randrange(len(base))] = f"new{rng.random()}"
        docs.append(" ".join(base))
    docs += [" ".join(template + words(rng.choice([5, 14, 18, 30]))) for _ in range(25)]
    docs += [" ".join(words(rng.choice([1, 3, 4, 5, 6, 9, 25]))) for _ in range(40)]
    docs += [docs[3], docs[3].upper(), docs[3].replace(" ", "\n"), docs[-1], docs[-1], "a b", "A  b", "a b c"]
    rng.shuffle(docs)
    return [(i, d) for i, d in enumerate(docs)] + [(500, None), (501, ""), (502, " "), (7, docs[9]), (7, docs[9]), (None, docs[11])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_all_pairs(spark, seed, monkeypatch):
    for name, value in (("GROUP", 4), ("SLICE", 3), ("MASK_BITS", 3), ("BLOCK_BYTES", 2000), ("BUCKET_BYTES", 8000)):
        monkeypatch.setattr(jaccard_join, name, value)
    docs = family(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert got(jaccard_join.join_components(clashing(df))) == sorted(jaccard_join.brute(docs), key=key)


def test_awkward_rows(spark, tmp_path):
    assert got(jaccard_join.op3_group_matrix(spark, saved(spark, tmp_path))) == sorted(jaccard_join.brute([r[:2] for r in rows()]))
    assert jaccard_join.join_components(table(spark).limit(0)).count() == 0


def test_filters_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.sort(rng.choice(2**40, n, replace=False).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(n) < 0.93], rng.choice(2**40, int(rng.integers(0, 6))).astype(np.uint64)]))
        if len(b) and jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            low = [jaccard_join.lowest(x) for x in (a, b)]
            weight = lambda x: (x % np.uint64(7)).astype(int) + 1 + np.isin(x, np.intersect1d(a, b))
            picked = [jaccard_join.chosen(x, weight(y)) for x, y in zip((a, b), low)]
            assert len(np.intersect1d(*picked))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5)]
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect())) == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
