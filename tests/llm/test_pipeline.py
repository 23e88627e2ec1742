"""Each pipeline stage against brute force on its own input, and all of them together."""

import random
from collections import Counter

import pytest

from tests.llm.fixtures import SCHEMA, clashing, rows, table, texts
from tests.llm.test_first import split
from tumbler.llm import contamination, jaccard_join, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    rng = random.Random(4)
    item = " ".join(rng.choice(texts(9)[14].split()) for _ in range(40))
    more = [(1000 + i, t, "en", "a", 1) for i, t in enumerate([f"{texts(2)[20]} {item}", item, item])]
    more += [(1010, " ".join([*(f"q{i}" for i in range(500)), item[: len(item) // 2], *(f"v{i}" for i in range(300))]), "en", "a", 7)]
    spark.createDataFrame([*rows(), *more, rows()[6], rows()[40], rows()[40]], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def multiset(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = multiset(docs), stage(spark, docs, sf).persist()
        after = multiset(out)
        if i < 4:
            assert out.columns == docs.columns
        if i == 0:
            assert not after - before
            assert all(len(split(r[1])) >= 20 for r in after)
        if i == 1:
            label = {r[0]: r[2] for r in jaccard_join.brute([(r[0], r[1]) for r in before])}
            assert after == Counter(r for r in before if label[r[0]] == r[0])
        if i == 2:
            bad = {r[0] for r in contamination.brute([(r[0], r[1]) for r in before], [tuple(r) for r in items]) if r[5]}
            want, window = Counter(), [contamination.words_in(next(t for _, t in items if t))[k : k + 13] for k in range(28)]
            for r, n in before.items():
                words = contamination.words_in(r[1])
                hit = {j + k for j in range(len(words) - 12) if words[j : j + 13] in window for k in range(13)}
                if r[0] not in bad:
                    want[r[0], " ".join(w for j, w in enumerate(words) if j not in hit), r[2], r[3], r[4] if not hit else None] += n
            assert bad and want == Counter((r[0], " ".join(contamination.words_in(r[1])), r[2], r[3], r[4] if r in before else None) for r in after.elements())
            assert 1010 in {r[0] for r in after} and all(r[4] == len(r[1]) for r in after if r not in before)
        if i == 3:
            assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
            # Each source comes as near its target as whole documents, 0 to 2 times, can.
            words, names = {r: len(split(r[1])) for r in before}, sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
            sizes = {s: sum(words[r] * n for r, n in before.items() if r[3] == s) for s in names}
            targets = mixing.fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
            for s, t in targets.items():
                sums = 1  # bit x: documents of this source can add up to x words
                for r, n in before.items():
                    for _ in range(n if r[3] == s else 0):
                        sums |= sums << words[r] | sums << 2 * words[r]
                nearest = min(abs(x - t) for x in range(sums.bit_length()) if sums >> x & 1)
                assert abs(sum(words[r] * n for r, n in after.items() if r[3] == s) - t) <= nearest + 1 + 0.01 * t
        if i == 4:
            assert sum(after.values()) == sum(before.values())
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in before.elements())
            counts = Counter(r["shard"] for r in out.collect())
            assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_awkward_input(spark, sf):
    odd = clashing(table(spark)).unionByName(clashing(spark.createDataFrame([(None, None, None, None, None), (None, "x y", None, None, 3)], SCHEMA)))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, sf).columns == odd.columns
        stage(spark, odd, sf).collect()
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, odd, sf).count() == odd.count()
