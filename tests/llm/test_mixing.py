"""Operator 4: the flow against every assignment, the selection against every choice, and the whole mix."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, rows, saved, table
from tests.llm.test_first import split
from tumbler.llm import mixing


def cost(flow, capacity, most):
    """What a flow costs (None if some pattern gives more than it may) and how much it serves."""
    used = Counter()
    for (p, _), n in flow.items():
        used[p] += n
    if any(used[p] > most * n for p, n in capacity.items()):
        return None
    full = lambda n, c: sum((r + 1) ** 2 * min(c, max(0, n - r * c)) for r in range(most))
    return -sum(used.values()), sum(full(used[p], c) for p, c in capacity.items())


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_cheapest_of_the_largest(seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"][: rng.randint(2, 3)]
    sets = [list(c) for k in (1, 2) for c in itertools.combinations(names, k)]
    members = {"".join(m): m for m in rng.sample(sets, min(len(sets), 3))}
    capacity = {p: rng.randint(0, 3) for p in members}
    quota = {s: rng.randint(0, 5) for s in names}
    flow = mixing.route(capacity, members, quota, 2)
    served = {s: sum(n for (_, t), n in flow.items() if t == s) for s in names}
    assert all(n >= 0 for n in flow.values()) and all(served[s] <= quota[s] for s in names)
    edges = [(p, s) for p in members for s in members[p]]
    best = None
    for ways in itertools.product(*[range(min(2 * capacity[p], quota[s]) + 1) for p, s in edges]):
        one = dict(zip(edges, ways))
        if all(sum(n for (_, t), n in one.items() if t == s) <= quota[s] for s in names) and (c := cost(one, capacity, 2)) is not None:
            best = c if best is None else min(best, c)
    assert cost(flow, capacity, 2) == best


def test_flow_serves_overlapping_sources():
    # b can only use the shared pattern; a must then repeat its own text.
    flow = mixing.route({"a": 10, "ab": 10}, {"a": ["a"], "ab": ["a", "b"]}, {"a": 15, "b": 10}, 2)
    assert flow["ab", "b"] == 10 and flow["a", "a"] + flow["ab", "a"] == 15
    assert mixing.fill({"a": 10, "b": 100}, {"a": 3, "b": 1}, 100, 2) == {"a": 20.0, "b": 80.0}
    many = {f"{i}": [f"s{i}", f"s{i + 1}"] for i in range(6000)}  # more patterns than any fixed limit
    flow = mixing.route(dict.fromkeys(many, 7), many, {f"s{i}": 7 for i in range(6001)}, 2)
    assert sum(flow.values()) == 7 * 6001


def sums(sizes, most=2):
    best = {0}
    for n in sizes:
        best = {x + k * n for x in best for k in range(most + 1)}
    return best


@pytest.mark.parametrize("bits", [1 << 30, 4000])
def test_copies_come_as_near_as_any(monkeypatch, bits):
    monkeypatch.setattr(mixing, "BITS", bits)
    rng = random.Random(2)
    for n in [1, 2, 3, 4, 5, 6, 9, 30] * 10:
        have = {(rng.randint(3, 6), i): rng.choice([rng.randint(1, 60), rng.randint(1, 2000)]) for i in range(n)}
        want = rng.randint(0, 2 * sum(have.values()))
        taken = mixing.copies(have, want, 2)
        off = abs(want - sum(taken[k] * x for k, x in have.items()))
        assert set(taken) == set(have) and set(taken.values()) <= {0, 1, 2}
        if bits > 4000:
            assert off == min(abs(want - x) for x in sums(have.values()))
        elif n == 30:
            assert off <= 60
    one_outweighs = [2065, 100, 300, 250, 400, 77, 20, 350, 300, 200]  # of 4062
    assert abs(6817 - sum(k * x for k, x in zip(mixing.nearest(one_outweighs, 6817, 2), one_outweighs))) == min(abs(6817 - x) for x in sums(one_outweighs))
    assert mixing.nearest([], 5, 2) == [] and mixing.nearest([3], 0, 2) == [0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_mix_comes_as_near_as_documents_allow(spark, sf):
    path = f"/root/testdata/{sf}"
    source = {r[0]: r[1] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source").collect()}
    by = {}
    for r in mixing.op4_mix_flow(spark, path).collect():
        by.setdefault(source[r["doc_id"]], []).append(r)
    for own in by.values():
        target, reach = own[0]["target"], 1
        for r in own:
            reach |= reach << r["size"] | reach << 2 * r["size"]
        at = round(target)
        best = next(d for d in range(at + 1) if reach >> at - d & 1 or reach >> at + d & 1)
        assert abs(sum(r["taken"] for r in own) - target) <= best + 2


def test_whole_mix(spark, tmp_path):
    out = mixing.op4_mix_flow(spark, sf := saved(spark, tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.op4_mix_flow(spark, sf).collect()))
    docs = {r[0]: r for r in rows()}
    assert len(out) == len(docs)
    sizes = Counter()
    for r in docs.values():
        sizes[r[3]] += len(split(r[1]))
    for r in out:
        assert r["size"] == len(split(docs[r["doc_id"]][1])) and r["source_size"] == sizes[docs[r["doc_id"]][3]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    weights = dict(zip(["a", "b", "é", None], (3, 1, 2, 3)))
    targets = {docs[r["doc_id"]][3]: r["target"] for r in out}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    open_ = [s for s in targets if targets[s] < 2 * sizes[s] - 1e-6]
    assert len({round(targets[s] / weights[s], 6) for s in open_}) <= 1
    for s, t in targets.items():
        own = [r for r in out if docs[r["doc_id"]][3] == s]
        best = {0}  # all sums that copies of this source's documents can have
        for r in own:
            best = {x + k * r["size"] for x in best for k in range(3)}
        nearest = min(abs(x - t) for x in best)
        assert abs(sum(r["taken"] for r in own) - t) <= nearest + 2


def test_overlapping_membership_and_awkward_tables(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"]) for i in range(30)] + [(i, "w " * 10, ["a", "b"]) for i in range(30, 60)] + [(90, None, []), (91, "", None), (92, "x y", [None])], "doc_id long, text string, src array<string>")
    out, targets, members = mixing.mix(df, F.col("src"), weights=(1, 1, 1))
    taken = {p: sum(r["taken"] for r in out.collect() if r["pattern"] == p) for p in members}
    assert sum(taken.values()) == pytest.approx(sum(t for _, t in targets.values()), abs=20)
    assert taken['["a","b"]'] >= targets["b"][1] - 20 and out.count() == 63
    got, _, _ = mixing.mix(clashing(table(spark)), F.array("source"))
    assert got.count() == len(rows())
    assert mixing.mix(table(spark).limit(0), F.array("source"))[0].count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), (1, "w " * 300_000, "a")], "doc_id long, text string, source string")
    assert {r["size"] for r in mixing.mix(long, F.array("source"))[0].collect()} == {300_000}
