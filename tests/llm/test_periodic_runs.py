"""Periodic runs against a search over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import clashing, rows, saved, table
from tumbler.llm import periodic_runs


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        j = 0
        while j + q < len(words):
            first = j
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > first and j + q - first >= max(6, 4 * q):
                found.setdefault((first, j + q - first), q)
            j += j == first
    return sorted((s, n, q) for (s, n), q in found.items())


def split(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


@pytest.mark.parametrize("longest", [2, 8, 2048])
def test_runs_match_brute_force(monkeypatch, longest):
    monkeypatch.setattr(periodic_runs, "LONGEST_BLOCK", longest)
    rng = random.Random(longest)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.choice([0, 1, 5, 6, 7, rng.randint(0, 60), rng.randint(0, 300)]), rng.choice([1, 2, 2, 3, 5])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        got = periodic_runs.runs_of(np.array(sum(docs, []), "i8"), np.cumsum([0, *map(len, docs)]))
        assert got == [(k, *r) for k, words in enumerate(docs) for r in brute(words)]


def test_transform_finds_every_equal_place():
    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 32, 64, 256, 2048):
        words = rng.integers(0, 2 + size // 64, 40 * size + 100)
        at = np.arange(0, 20 * size, size)
        words[at[3] + size + size // 2 : at[3] + 2 * size + size // 2] = words[at[3] : at[3] + size].copy()
        want = [(k, t) for k, i in enumerate(at) for t in range(size) if (words[i : i + size] == words[i + size + t : i + 2 * size + t]).all()]
        assert list(zip(*map(np.ndarray.tolist, periodic_runs.zeros(words, at, at + size, size)))) == want


def test_long_periods():
    rng = np.random.default_rng(2)
    for q, times in ((1500, 5), (3001, 4), (5000, 6)):
        words = np.concatenate([np.arange(777) + 10**6, np.tile(rng.integers(0, 50, q), times), np.arange(99) + 2 * 10**6])
        assert periodic_runs.runs_of(words, np.array([0, len(words)])) == [(0, 777, q * times, q)]


def want_row(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n < 3000 else []
    keep = [True] * n
    for s, size, q in runs:
        keep[s + q : s + size] = [False] * (size - q)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    row = (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (*row, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(w for w, k in zip(words, keep) if k))))


def test_registered_query(spark, tmp_path):
    got = {r[0]: tuple(r) for r in periodic_runs.op11_block_convolution(spark, saved(spark, tmp_path)).collect()}
    want = {i: want_row(i, t) for i, t, *_ in rows()}
    assert {i: r for i, r in got.items() if len(split(dict(r_[:2] for r_ in rows())[i])) < 3000} == {i: r for i, r in want.items() if len(split(dict(r_[:2] for r_ in rows())[i])) < 3000}
    assert len(got) == len(want)


def test_registered_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in periodic_runs.op11_block_convolution(spark, sf).collect()}
    short = {i: t for i, t in docs if len(split(t)) < 3000}
    assert {i: got[i] for i in short} == {i: want_row(i, t) for i, t in short.items()} and len(got) == len(docs)
    assert sum(r[1] > 0 for r in got.values()) > 3


def test_awkward_tables(spark):
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(clashing(table(spark))).collect()}
    assert found[0]["n_words"] == 0 and found[0]["runs"] == [] and found[0]["collapsed"] == ""
    assert periodic_runs.find_runs(table(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([("x", "a a a a a a a b"), ("x", "a a a a a a a b"), (None, "p q p q p q p q"), (None, None)], "doc_id string, text string")
    out = sorted((r["doc_id"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(twice).collect())
    assert out == [("", [], ""), ("", [(0, 8, 2)], "p q"), ("x", [(0, 7, 1)], "a b"), ("x", [(0, 7, 1)], "a b")]

