"""Groups and files grow in number with the input, not in size."""

import numpy as np
import pytest

from tests.llm.fixtures import rows, saved
from tumbler.llm import common, lm_score, token_store


def test_blocks_grow_in_number():
    each = lm_score.BLOCK_BYTES
    assert lm_score.block_count(0, 4) == 8
    assert lm_score.block_count(100 * each, 4) == 100


def test_shards_grow_in_number(spark, tmp_path, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(token_store, "SHARD_BYTES", 2000)
    docs = spark.read.parquet(f"{saved(spark, tmp_path)}/documents.parquet")
    token_store.write_shards(docs, open(path).read(), f"{tmp_path}/shards")
    assert spark.read.format("binaryFile").load(f"{tmp_path}/shards").count() > 8
    assert token_store.read_shards(spark, f"{tmp_path}/shards").count() == len(rows())


def test_a_blocks_buckets_do_not_depend_on_their_number():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, np.uint64))
    for buckets in (1, 7, 1000, (1 << 31) - 1):
        at = common.bucket_slices(hashes, buckets)
        assert len(at) <= len(hashes) and [x for i, j in at.values() for x in range(i, j)] == list(range(len(hashes)))
        assert all((int(h) * buckets) >> 64 == b for b, (i, j) in at.items() for h in hashes[i:j])
    assert common.bucket_slices(hashes[:0], 5) == {}
