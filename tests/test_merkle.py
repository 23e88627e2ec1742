"""Seals: the tree against plain hashing, proofs, comparison of versions, raw lines with offsets."""

import hashlib
from collections import Counter

import pytest

from tumbler.operators import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    hashes = Counter(sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r)) for r in rows)
    n = sum(hashes.values())
    depth = next(d for d in range(9) if n <= merkle.LEAF * 16**d)

    def node(prefix):
        if len(prefix) == depth:
            own = sorted(f"{h}*{c}" for h, c in hashes.items() if h.startswith(prefix))
            return sha(",".join(own)) if own else None
        parts = [(d, node(prefix + d)) for d in "0123456789abcdef"]
        return sha("".join(d + x for d, x in parts if x)) if any(x for _, x in parts) else None

    return n, sha(f"{n}:{node('') or sha('')}")


ROWS = [(i % 40, None if i % 7 == 0 else f"t,{i % 100}é") for i in range(700)] + [(1, "same")] * 300
SCHEMA = "id long, text string"


def test_seal_matches_plain_hashing(spark, monkeypatch):
    for leaf in (1, 3, 256, 5000):
        monkeypatch.setattr(merkle, "LEAF", leaf)
        df = spark.createDataFrame(ROWS, SCHEMA)
        assert tuple(merkle.seal(df.repartition(5), ["id", "text"]).first()) == plain(ROWS)
    assert tuple(merkle.seal(df.limit(0), ["id", "text"]).first()) == (0, sha("0:" + sha("")))
    other = [*ROWS[1:], (ROWS[0][0], "")]
    assert merkle.seal(spark.createDataFrame(other, SCHEMA), ["id", "text"]).first()["seal"] != plain(ROWS)[1]


def test_keys_have_their_own_depth(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF", 4)
    rows = [("big", i) for i in range(500)] + [("small", 1), ("small", 1), (None, 7)]
    got = {r["k"]: (r["n"], r["seal"]) for r in merkle.seal(spark.createDataFrame(rows, "k string, v long"), ["v"], ["k"]).collect()}
    assert got == {k: plain([(v,) for x, v in rows if x == k]) for k in ("big", "small", None)}


def test_single_rows_are_proved(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF", 16)
    df = spark.createDataFrame(ROWS, SCHEMA)
    sealed = merkle.seal(df, ["id", "text"]).first()["seal"]
    h = df.where("text = 'same'").select(merkle.row_hash(["id", "text"])).first()[0]
    found = merkle.proof(df, ["id", "text"], h)
    assert merkle.proves(found, h, sealed) and not merkle.proves(found, h, sha("x")) and len(found["leaf"]) < 60
    assert not merkle.proves(found | {"n": 999}, h, sealed) and not merkle.proves(found | {"leaf": [f"{h}*1"]}, h, sealed)
    with pytest.raises(KeyError):
        merkle.proof(df, ["id", "text"], sha("no such row"))


def test_versions_are_compared(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAF", 8)
    a, b = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([*ROWS[5:], (9, "new"), (1, "same")], SCHEMA)
    hashes = lambda rows: Counter(sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r)) for r in rows)
    x, y = hashes(ROWS), hashes([*ROWS[5:], (9, "new"), (1, "same")])
    got = {r["h"]: (r["n_a"], r["n_b"]) for r in merkle.differences(a, b, ["id", "text"]).collect()}
    assert got == {h: (x[h], y[h]) for h in x.keys() | y.keys() if x[h] != y[h]} and len(got) == 7
    assert merkle.differences(a, a, ["id", "text"]).count() == 0


def test_lines_have_offsets_however_files_are_split(spark, tmp_path):
    text = {"a.txt": [f"{i},{'é' * (i % 9)}" for i in range(3000)], "b.txt": ["", "7,x", ""]}
    for name, rows in text.items():
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    want = []
    for name, rows in text.items():
        at = 0
        for r in rows:
            want.append((name, at, r))
            at += len(r.encode()) + 1
    try:
        for size in ("128m", "5000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, merkle.lines(spark, str(tmp_path)).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = spark.createDataFrame([(7,), (12,)], "id int")
    chosen = [r for r in want if r[2].split(",")[0] in ("7", "12")]
    assert tuple(merkle.seal_lines(spark, str(tmp_path), ids).first()) == plain(chosen) and len(chosen) == 3
