"""Operators 6 and 8 against brute force and held-out comparison."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, clashing, rows, saved, table
from tumbler.llm import lm_score, repeats


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


def copies(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 140))) for _ in range(6)]
    out = [(i, "".join(rng.choice(pool)[rng.randint(0, 20) :] + rng.choice("xyz") * rng.randint(0, 3) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    return out + [(50, None), (51, ""), (52, "q" * 49), (53, "q" * 49), (54, "r" * 300), (55, "r" * 50), (2, out[9][1]), (2, out[9][1]), (None, out[3][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "CHUNK", 130)
    monkeypatch.setattr(repeats, "SUFFIXES", 60)
    docs = copies(seed)
    key = lambda r: (r[0] is not None, r)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(clashing(df)).drop("kept")) == sorted(repeats.brute(docs), key=key)


def test_longest_previous_factors():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(0, 60))
        raw = rng.integers(0, 2, (n, 56)).astype(np.uint8)
        raw[:, 3:] = 0
        raw[:, repeats.LENGTH:] = 0
        raw[:, -7] = 0
        raw[:, repeats.LENGTH - 1] = rng.integers(0, 2, n)
        words = raw.view(">u8").astype(np.uint64).reshape(n, 7)
        words, docs = words[np.lexsort(words.T[::-1])], rng.integers(0, 12, n)
        common = lambda a, b: min(repeats.LENGTH, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 56))
        text = [w.astype(">u8").tobytes() for w in words]
        shared = repeats.shared_prefixes(words)
        assert shared.tolist() == [0 if not i else common(text[i - 1], text[i]) for i in range(n)]
        for least in (1, 3, repeats.LENGTH):
            want = [max((common(text[i], text[j]) for j in range(n) if docs[j] < docs[i]), default=0) for i in range(n)]
            have = repeats.longest_previous(shared, docs, least)
            assert [x if x >= least else 0 for x in want] == [x if x >= least else 0 for x in have.tolist()]


def test_repeats_on_awkward_rows(spark, tmp_path):
    out = got(repeats.op6_previous_factors(spark, saved(spark, tmp_path)))
    assert out == sorted(repeats.brute([r[:2] for r in rows()]))
    kept = dict(repeats.remove_repeats(table(spark), keep_bytes=True).select("doc_id", "kept").collect())
    assert all(len(kept[r[0]]) == r[1] - r[2] for r in out)
    assert repeats.remove_repeats(table(spark).limit(0)).count() == 0


def test_ppm_is_a_distribution():
    rng = random.Random(1)
    codes, _ = lm_score.grams([bytes(rng.choice(b"abc ") for _ in range(50)) for _ in range(20)], 3)
    model = lm_score.Ppm(*lm_score.sums(codes, np.ones(len(codes), np.int64)), 3)
    for context in (b"abc", b"zzz", b"aa ", b"\n\n\n", b"zab"):
        p = 10 ** model.log10(int.from_bytes(context, "big") << 8 | np.arange(256))
        assert p.sum() == pytest.approx(1) and (p > 0).all()
    assert model.score([b"abc"]) == pytest.approx(sum(model.log10(np.array([int.from_bytes(x, "big")])) for x in (b"\n\n\na", b"\n\nab", b"\nabc", b"abc\n")))


def dictionary_ppm(train: list[bytes], order: int):
    """log10 of a byte after a context, from plain dictionaries of sets."""
    seen: list[dict] = [{} for _ in range(order + 1)]  # by length: context -> byte -> count
    for t in train:
        padded = b"\n" * order + t + b"\n"
        for i in range(order, len(padded)):
            table = seen[order].setdefault(padded[i - order : i], Counter())
            table[padded[i]] += 1
    for j in range(order - 1, -1, -1):
        for context, table in seen[j + 1].items():
            for byte in table:
                seen[j].setdefault(context[1:], Counter())[byte] += 1

    def log10(context: bytes, byte: int) -> float:
        out, tried = 0.0, set()
        for j in range(order, -1, -1):
            table = seen[j].get(context[len(context) - j :])
            if table is None:
                continue
            n = sum(c for b, c in table.items() if b not in tried)
            if byte in table:
                return out + np.log10((table[byte] - 0.5) / n)
            if n:
                out += np.log10(0.5 * len(set(table) - tried) / n)
            tried = set(table)
        return out - np.log10(max(1, 256 - len(tried)))

    return log10


def test_sums_by_text_either_way():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 6))) for _ in range(70_000)]  # more than fit beside a code
    value = lambda codes: np.sqrt(codes.astype(float))
    many, few = lm_score.by_gram(texts, value, 5), np.concatenate([lm_score.by_gram(texts[i : i + 700], value, 5) for i in range(0, 70_000, 700)])
    assert many == pytest.approx(few)
    raw = np.frombuffer(bytes(range(60, 90)), np.uint8)
    for width in range(1, 8):
        assert lm_score.byte_windows(raw, width).tolist() == [int.from_bytes(raw[i : i + width].tobytes(), "big") for i in range(30 - width + 1)]
        assert len(lm_score.byte_windows(raw[:3], width)) == max(0, 4 - width)


@pytest.mark.parametrize("order", [1, 5])
def test_scores_match_dictionaries(spark, order):
    rng = random.Random(order)
    words = ["ab", "abc", "Cab", "b", "zé", "the", "x" * 9]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(40)] + [(60, None), (61, " \t"), (62, "\u00c9 unseen \U0001f600"), (None, "ab ab"), (3, "the the")]
    joined = lambda t: b" ".join(lm_score.tokens(t))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    log10 = dictionary_ppm([joined(t) for i, t in docs if not held(i)], order)
    want = []
    for i, t in docs:
        padded = b"\n" * order + joined(t) + b"\n"
        want.append((i, sum(log10(padded[k - order : k], padded[k]) for k in range(order, len(padded)))))
    have = [(r["doc_id"], r["score"]) for r in lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order).collect()]
    key = lambda r: (r[0] is not None, r)
    assert [i for i, _ in sorted(have, key=key)] == [i for i, _ in sorted(want, key=key)]
    assert [x for _, x in sorted(have, key=key)] == pytest.approx([x for _, x in sorted(want, key=key)], rel=1e-9)


def test_scores(spark):
    docs = [*((r[0], r[1]) for r in rows()), (None, "null id here"), (300, "one one"), (300, "one one")]
    out = lm_score.score(clashing(spark.createDataFrame(docs, "doc_id long, text string")))
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs}
    seen = Counter()
    for i, t in docs:
        if not held[i]:
            seen.update([*lm_score.tokens(t), b""])
    assert lm_score.tokens("A\u00c9b\x0bc\x1cd \u00a0") == ["a\u00c9b".encode(), b"c\x1cd", b"\xc2\xa0"]
    n, room = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    want = []
    for i, t in docs:
        words = [*lm_score.tokens(t), b""]
        want.append((i, held[i], len(words), sum(w in seen for w in words), n, round(sum(np.log10((seen[w] + 0.5) / room) for w in words), 6)))
    rows_ = got(out)
    assert sorted(((*r[:5], round(r[5], 6)) for r in rows_), key=lambda r: (r[0] is not None, r)) == sorted(want, key=lambda r: (r[0] is not None, r))
    assert all(r[6] < 0 for r in rows_)
    trained = [r for r in rows_ if r[2] > 50]
    assert sum(r[6] for r in trained if not r[1]) > sum(r[5] for r in trained if not r[1])
    assert lm_score.score(table(spark).limit(0)).count() == 0
    one = lm_score.score(spark.createDataFrame([(4, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1
    assert SCHEMA
