"""Features of the past on a stream equal those of a batch over the same draws."""

import random

import pytest
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators import models
from tumbler.streaming import retrievals

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_equals_batch(spark, tmp_path):
    rng, m = random.Random(4), Matrix(3, 1, 8)
    draws = [(p, i, rng.sample(range(1, 9), 3)) for i in range(40) for p in ("a", "b")]
    df = spark.createDataFrame(draws, "pool string, draw_id long, numbers array<long>").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(draw_id div 5 as int))"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        for first, last in ((0, 13), (13, 14), (14, 40)):  # three runs: state is kept in the checkpoint between them
            df.where(f"draw_id >= {first} AND draw_id < {last}").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
            query = retrievals.expanding_features(stream, m).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["pool", "label", "draw_id", "n", "c", "gap", "prev", "hit"]
    got = {tuple(r[c] for c in names): r["decayed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(int(r[c]) if c == "label" else r[c] for c in names): r["decayed"] for r in models.features(df, m).collect()}
    assert set(got) == set(want) and len(got) == 80 * 8
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
