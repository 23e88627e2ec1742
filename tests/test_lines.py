"""CSV with line numbers, and checks compiled into one aggregation."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tumbler.operators import audit
from tumbler.sources import lines

SCHEMA = StructType().add("id", "long").add("price", "double").add("day", "date").add("flag", "boolean").add("name", "string")


def test_cells_are_reported_by_file_and_line(spark, tmp_path):
    head = "id,price,day,flag,name\n"
    (tmp_path / "a.csv").write_text(head + '1,2.5,2024-01-02,true,"x, y"\n\n2,,,,\nz,bad,2024-13-01,maybe,ok\n3,1\n' + "".join(f"{i},1,,,\n" for i in range(10, 400)) + "q,1,,,\n")
    (tmp_path / "b.csv").write_text("id,cost,day,flag,name\n7,1,,false,é\n")
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = lines.typed_csv(spark, str(tmp_path), SCHEMA)
            assert sorted(map(tuple, bad.collect()), key=str) == sorted(
                [("a.csv", 5, "id", "z"), ("a.csv", 5, "price", "bad"), ("a.csv", 5, "day", "2024-13-01"), ("a.csv", 5, "flag", "maybe"), ("a.csv", 6, None, "3,1"), ("a.csv", 397, "id", "q"), ("b.csv", 1, None, "id,cost,day,flag,name")], key=str
            )
            rows = {r["id"]: tuple(r) for r in good.collect()}
            assert len(rows) == 393 and rows[1] == (1, 2.5, dt.date(2024, 1, 2), True, "x, y") and rows[2] == (2, None, None, None, None) and rows[7][4] == "é"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_checks_are_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rules = {f"c{i}": F.col("o_orderkey") % 50 == i for i in range(20)} | {"null": F.lit(None).cast("boolean"), "none": F.col("o_orderkey") < 0}
    out = audit.compiled(df, rules)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["check"]: (r["passed"], r["n_violations"]) for r in out.collect()}
    assert got["none"] == got["null"] == (True, 0) and got["c3"] == (False, df.where("o_orderkey % 50 = 3").count()) and len(got) == 22


def test_a_text_in_parts_is_numbered_through(spark, tmp_path, monkeypatch):
    """Lines written by ranges of the key, in more than one file, have the numbers and offsets of one text."""
    monkeypatch.setattr(lines, "PART", 50)
    path = f"file://{tmp_path}/ordered"
    lines.write_ordered(spark.range(400).selectExpr("399 - id AS k"), "k", F.col("k").cast("string"), path, "k")
    assert len(list((tmp_path / "ordered").glob("part-*"))) > 1
    got = sorted((r["number"], r["offset"], r["line"]) for r in lines.numbered(spark, path, True).collect())
    at, want = 0, []
    for i, text in enumerate(["k", *map(str, range(400))], 1):
        want.append((i, at, text))
        at += len(text) + 1
    assert got == want
