"""Packing: every id in one piece, windows without gaps, differencing against its definition."""

import random
import zlib
from array import array
from collections import defaultdict

import pytest

from tests.llm.fixtures import clashing, rows, saved, table
from tumbler.llm import packing


def plain(sizes, k):
    """Differencing by its definition, with sorted lists; sums only."""
    parts = [(tuple([s] + [0] * (k - 1)), i) for i, s in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _), *parts = parts
        parts.append((tuple(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)), n))
        n += 1
    return parts[0][0]


def test_differencing_follows_its_definition():
    rng = random.Random(1)
    for _ in range(300):
        k, sizes = rng.randint(1, 9), [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
        window, most = packing.difference(sizes, k)
        sums = [0] * k
        for w, s in zip(window, sizes):
            sums[w] += s
        assert tuple(sorted(sums, reverse=True)) == plain(sizes, k) and most == max(sums)


def test_count_rises_until_nothing_exceeds():
    window, k = packing.windows_of([6, 6, 6], 10)
    assert k == 3 and sorted(window) == [0, 1, 2]  # two windows would hold 12
    assert packing.windows_of([10], 10)[1] == 1
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        window, k = packing.windows_of(sizes, 100)
        sums = [0] * k
        for w, s in zip(window, sizes):
            sums[w] += s
        assert max(sums) <= 100 and all(packing.difference(sizes, j)[1] > 100 for j in range(-(-sum(sizes) // 100), k))


def test_windows_are_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 2047) for _ in range(600)]
    window, k = packing.windows_of(sizes, 2048)
    assert sum(sizes) / (2048 * k) > 0.95


def tokens(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs):
    """Rows of the query against the documents; gives the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_doc) == sorted(docs)
    for i, ids in docs.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
        assert sum(r["length"] < 2048 for r in by_doc[i]) <= 1  # cut at whole windows only
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return 1 - sum(map(len, docs.values())) / (2048 * len(by_sequence))


def test_registered_query(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    check(packing.op13_differencing(spark, saved(spark, tmp_path)).collect(), {i: tokens(t) for i, t, *_ in rows()})


def test_registered_query_on_the_given_table(spark):
    pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.01"
    docs = {r[0]: tokens(r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert check(packing.op13_differencing(spark, sf).collect(), docs) < 0.05


def test_groups_and_what_tasks_leave(spark):
    """Small groups and windows over several tasks; sequences hold the pieces' ids, filled up."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    packed = packing.pack(clashing(table(spark)).repartition(5), open(path).read(), capacity=64, group=4)
    out = packed.collect()
    assert len({r["sequence_id"] >> 32 for r in out}) > 5
    got = defaultdict(dict)
    for r in out:
        got[r["doc_id"]][r["start"]] = r["ids"]
    assert {i: b"".join(x for _, x in sorted(p.items())) for i, p in got.items()} == {i: array("I", tokens(t)).tobytes() for i, t, *_ in rows()}
    for r in packing.sequences(packed, 64, 9).collect():
        ids = array("I", bytes(r["ids"]))
        assert len(ids) == 64 and sum(p["length"] for p in r["parts"]) == r["n_tokens"] and set(ids[r["n_tokens"] :]) <= {9}
        for p in r["parts"]:
            assert ids[p["offset"] : p["offset"] + p["length"]].tobytes() == got[p["doc_id"]][p["start"]]
    assert packing.pack(table(spark).limit(0), open(path).read()).count() == 0
    same = spark.createDataFrame([("x", "one two"), ("x", "one two"), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["doc_tokens"]) for r in packing.pack(same, open(path).read()).collect()) == [("", 1), ("x", 3), ("x", 3)]
