"""Forms of plans that keep work and memory in proportion to the input."""

import hashlib
from collections import Counter

import pytest

from tumbler.functions.exact import Matrix
from tumbler.operators import inference, models, reconcile
from tumbler.sources import payloads


def test_nulls_are_counted_before_they_meet_the_observed(spark):
    nulls = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", 1.0), (None, 2.0)], "k string, value double")
    seen = spark.createDataFrame([("a", 7.0), ("b", 0.0)], "k string, observed double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = inference.mc_pvalue(nulls, seen, ["k"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert {r["k"]: (r["b"], r["n_null"]) for r in got.collect()} == {"a": (2, 9), "b": (1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "rightHint=(strategy=broadcast)" in plan  # the nulls' side is streamed
    with pytest.raises(Exception, match="no null values"):
        inference.mc_pvalue(nulls, spark.createDataFrame([("c", 7.0)], "k string, observed double"), ["k"]).collect()


def test_history_lines_are_split_once(spark):
    lines = spark.createDataFrame([("lotto", "9/26/26 1 5 LOTTO DP")], "game string, content string")
    plan = payloads.history_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(content") == 1


def test_only_close_draws_are_ranked(spark, monkeypatch):
    """Blocks cut by hashes give what ranking whole blocks gives, whatever the categories' sizes."""
    m = Matrix(2, 1, 6)
    rows = [("AB"[i % 2], i, i // 400, (0, 0, 0, 0, 2, 5, 5)[i % 7], [1 + i % 6, 1 + (i + 1 + i % 2) % 6]) for i in range(1000)]
    h = spark.createDataFrame(rows, "pool string, draw_id long, week int, machine int, numbers array<int>")
    found = []
    for whole in (50, 10_000):
        monkeypatch.setattr(models, "WHOLE", whole)
        found.append({(r["pool"], r["permutation"]): round(r["chi2"], 9) for r in models.permuted_chi2(h, m, "week", "machine", 7).collect()})
    assert found[0] == found[1] and len(found[0]) == 16
    for k in range(1, 8):  # the rule itself
        cats, dealt = {}, {}
        for pool, i, week, cat, numbers in rows:
            cats.setdefault((pool, week), []).append(cat)
            dealt.setdefault((pool, week), []).append((hashlib.md5(f"{k}:{i}".encode()).hexdigest(), numbers))
        counts, n = Counter(), Counter()
        for key, own in dealt.items():
            for cat, (_, numbers) in zip(sorted(cats[key]), sorted(own)):
                n[key[0], cat] += 1
                counts.update((key[0], cat, x) for x in numbers)
        for pool in "AB":
            want = sum((counts[pool, c, x] - n[pool, c] / 3) ** 2 / (n[pool, c] / 3) for c in (0, 2, 5) for x in range(1, 7))
            assert found[0][pool, k] == pytest.approx(want)


def test_equal_draws_are_dealt_together(spark):
    """Many draws of two kinds: what is shuffled are kinds with counts, and the law is the hypergeometric one."""
    m = Matrix(1, 1, 2)
    h = spark.range(30_000).selectExpr("'A' AS pool", "0 AS week", "id AS draw_id", "array(1 + id % 2) AS numbers", "id % 3 AS machine")
    got = models.permuted_margins(h, m, "week", "machine", 400)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :]
    assert "Aggregate" in moved and "draw_id" not in moved.split("Aggregate")[0]
    chi2 = [r["chi2"] for r in got.where("permutation > 0").collect()]
    # Two free cells: a chi-square's mean is 2, its standard error over 400 dealings 0.1.
    assert len(chi2) == 400 and abs(sum(chi2) / 400 - 2) < 0.5


def test_convergence_streams_the_values(spark):
    """Values meet the figures of their few keys where they are read."""
    rows = spark.range(2_000).selectExpr("'ab' || id % 3 AS k", "id % 4 AS batch", "cast(id * 37 % 2000 AS double) AS value")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = inference.convergence(rows, ["k"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert got.where("NOT passed").count() == 0 and got.count() == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "strategy=broadcast" in plan


def test_workbooks_are_read_one_at_a_time(spark):
    """Rows leave a workbook without a table of all workbooks of a batch."""
    files = spark.createDataFrame([("a", b"")], "path string, content binary")
    plan = payloads.xlsx_draws(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" in plan


def test_partitions_by_key_follow_the_rows(spark):
    """Rows stay in the partitions they are dealt to until the ledger has met them; every entry of a field is a row."""
    rows = reconcile.dealt(spark.range(100).selectExpr("id % 20 AS key", "'f' || id % 2 AS field", "'CONFLICT' AS class", "'unresolved' AS status", "'1' AS value_a", "'2' AS value_b"), ["key"], 10)
    assert rows.rdd.getNumPartitions() == 10
    ledger = spark.createDataFrame([(1, "f1", "7", "resolved"), (1, "f1", "8", "resolved"), (2, "f0", "9", "open")], "key long, field string, resolved_value string, status string")
    got = reconcile.resolve(rows, ledger, ["key"])
    assert sorted(r["final_value"] for r in got.where("status = 'resolved'").collect()) == ["7"] * 5 + ["8"] * 5 and got.count() == 105
