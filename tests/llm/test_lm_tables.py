"""Operator 8 with its model in many buckets and copies scores as one model that holds all grams."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import rows
from tumbler.llm import lm_score


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_buckets_and_copies_score_as_one_model(spark, monkeypatch, order):
    docs = [*((r[0], r[1]) for r in rows()), (None, "null id here"), (300, "one one"), (300, "one one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    joined = lambda t: b" ".join(lm_score.tokens(t))
    counts = Counter(lm_score.grams([joined(t) for i, t in docs if not held(i)], order)[0].tolist())
    codes = np.array(sorted(counts))
    model = lm_score.Ppm(codes, np.array([counts[c] for c in codes.tolist()]), order)
    want = sorted(((i is not None, -1 if i is None else i), model.score([joined(t)])[0]) for i, t in docs)
    texts = sum(len(t or "") for _, t in docs)
    for sizes in ({}, {"BUCKET_BYTES": max(1, texts // 70), "BLOCK_BYTES": max(1, texts // 30), "ASKERS": 4, "LOOKUP": 50, "TALLY": 500, "CHUNK": 300}):
        for name, value in sizes.items():
            monkeypatch.setattr(lm_score, name, value)
        have = sorted(((r.doc_id is not None, -1 if r.doc_id is None else r.doc_id), r.score) for r in lm_score.score(df, order=order).collect())
        assert [r[0] for r in have] == [r[0] for r in want]
        assert [r[1] for r in have] == pytest.approx([r[1] for r in want], rel=1e-9)


def test_packed_forms():
    rng = random.Random(3)
    for n in (0, 1, 7, 5000):
        numbers = np.array([rng.randrange(1 << rng.choice([1, 9, 48, 55])) for _ in range(n)], np.int64)
        assert lm_score.unpack(lm_score.pack(numbers)).tolist() == numbers.tolist()
        assert lm_score.unpack_sorted(lm_score.pack_sorted(np.sort(numbers))).tolist() == sorted(numbers.tolist())
        values = np.array([-0.5 * rng.randrange(40) for _ in range(n)])
        assert lm_score.unpack_values(lm_score.pack_values(values)).tolist() == values.tolist()
        words = [bytes([97 + i % 26]) * (1 + i % 5) for i in range(n)]
        assert lm_score.unpack_words(lm_score.pack_words(words)) == words
        got = lm_score.shares(np.sort(numbers), words, 11, 5)
        assert sorted(w for _, mine in got.values() for w in mine) == sorted(words)
        assert sorted(i for at, _ in got.values() for i in at.tolist()) == list(range(n))
