"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.fixtures import clashing, rows, table
from tumbler.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed, letters="abc", n=150):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(n)}
    for w in sorted(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    return {w: rng.choice([2, 3, 20, 25, 250, 251, 3000]) for w in sorted(words)}


def brute(counts):
    """word -> (form, root, n, n_near, form_n)"""
    forms, many = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        forms[w], many[w] = best if best is not None and counts[best] >= 10 * n else None, len(around)
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, many[w], counts.get(forms[w])))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abc", "abÿzéq"])
def test_pairs_are_found_once(letters):
    for seed in range(40):
        words = sorted(vocabulary(seed, letters, 30))
        for parts in (lambda m: [(0, m // 2), (m // 2, m)], lambda m: [(i, i + 1) for i in range(m)]):
            a, b = spelling.near_pairs(words, [(i, len(w), *p) for i, w in enumerate(words) for p in parts(len(w))])
            assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if near(w, v)]


def written(spark, counts, tmp_path):
    spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("low", spelling.F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/v")
    return spark.read.parquet(f"{tmp_path}/v")


@pytest.mark.parametrize("shared", [3, 20_000])
def test_groups(spark, tmp_path, monkeypatch, shared):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (shared,))
    counts = vocabulary(7)
    assert sorted(map(tuple, spelling.group_spellings(written(spark, counts, tmp_path)).collect())) == brute(counts)


def test_hot_halves_are_refined(spark):
    words = spark.createDataFrame([(f"shared{c}{d}", 2) for c in "abcdefghij" for d in "abcdefghij"] + [("another", 5)], "word string, n long")
    many = lambda shared: spelling.dealt(words, shared).groupBy("key", "low", "high").count().where("count > 10 AND high - low > 1").count()
    assert many(10) == 0 and many(1000) > 0


def test_forms_lead_to_roots(spark, tmp_path):
    counts = {"letters": 50_000, "lettters": 5000, "letttters": 500, "lettttters": 50, "letttttters": 5, "unalike": 2}
    out = {r["word"]: r for r in spelling.group_spellings(written(spark, counts, tmp_path)).collect()}
    assert {r["root"] for w, r in out.items() if w != "unalike"} == {"letters"}
    assert out["letttttters"]["form"] == "lettttters" and out["unalike"]["root"] == "unalike" and out["unalike"]["n_near"] == 0


def counted(docs):
    lower, total = {c: c + 32 for c in range(65, 91)}, Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_registered_query_on_the_given_table(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 500)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, spelling.op12_search_schemes(spark, sf).collect()))
    want = counted(docs)
    assert {r[0]: r[3] for r in got} == want
    by_delete: dict = {}
    for w in want:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_delete.setdefault(k, set()).add(w)
    around = {w: {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by_delete[k] if near(w, v)} for w in want}
    assert {r[0]: r[4] for r in got} == {w: len(x) for w, x in around.items()}
    best = {w: min(x, key=lambda v: (-want[v], v), default=None) for w, x in around.items()}
    assert {r[0]: r[1] for r in got} == {w: v if v and want[v] >= 10 * want[w] else None for w, v in best.items()}
    assert sum(r[1] is not None for r in got) > 3


def test_awkward_tables(spark, tmp_path):
    docs = clashing(table(spark))
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, errors=True).where("n > 1").collect()}
    assert got == counted([r[:2] for r in rows()])
    assert spelling.word_counts(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([], "word string, n long")
    empty.write.parquet(f"{tmp_path}/none")
    assert spelling.group_spellings(spark.read.schema(empty.schema).parquet(f"{tmp_path}/none")).count() == 0
    nulls = spark.createDataFrame([(None, "Ünsicher unsicher"), (3, None), (3, "UNSICHER"), (3, "UNSICHER")], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(nulls).collect()} == {"Ünsicher": 1, "unsicher": 3}
