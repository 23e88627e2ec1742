"""The driver's tables seen as draws, reports of several sources, rule eras and schedules.

Every view is given for Spark and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators import reconcile
from tumbler.operators.history import segmented
from tumbler.scratch import cut

MATRIX = Matrix(5, 1, 47, 15)
HALF = "2024-01-16"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: (era, first day, last day, certain from, pool) for each priority: three spans, a gap in 1997, a quarantine in 1999.
#: Draw weekdays (Monday 0) and change class of each era.
DAYS = {"E1": [0, 2], "E2": [0, 2, 5], "E3": [1, 4]}
CHANGES = {"E1": "baseline", "E2": "schedule", "E3": "matrix"}
SPANS = [("E1", "1995-01-01", "1996-12-31", None, "P1"), ("E2", "1997-02-01", "1998-12-31", None, "P1"), ("E3", "1999-01-01", None, "1999-03-01", "P2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as draws of 5 of 47 labels, in drawing order, with a special label of 15."""
    e = table(spark, sf_dir, "events")
    numbers = F.expr("transform(sequence(0, 4), i -> 1 + ((31 * event_id + 7 * user_id) % 47 + i * (1 + (event_id + 13 * user_id) % 46)) % 47)")
    half = F.when(F.col("ts") < F.lit(HALF).cast("timestamp_ntz"), "-S1").otherwise("-S2")
    return e.select(F.col("event_id").alias("draw_id"), F.col("event_type").alias("game_id"), F.col("ts").alias("t"), F.concat("event_type", half).alias("pool"), numbers.alias("numbers"), F.expr("1 + (17 * event_id + user_id) % 15").alias("special"), (F.col("event_id") % 17 != 0).alias("eligible"), (F.col("user_id") % 3).alias("machine"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(draws(spark, sf_dir))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a written table, for statistics that read it more than once."""
    return cut(history(spark, sf_dir), "history")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws without places and segments, for statistics that don't cross draws: one narrow scan."""
    return draws(spark, sf_dir).where("eligible")


DRAWS = f"""draws AS (
    SELECT event_id AS draw_id, event_type AS game_id, ts AS t,
           event_type || CASE WHEN ts < TIMESTAMP '{HALF}' THEN '-S1' ELSE '-S2' END AS pool,
           list_transform(range(5), lambda i: 1 + ((31 * event_id + 7 * user_id) % 47 + i * (1 + (event_id + 13 * user_id) % 46)) % 47) AS numbers,
           1 + (17 * event_id + user_id) % 15 AS special, event_id % 17 <> 0 AS eligible, user_id % 3 AS machine FROM events),
numbered AS (SELECT *, row_number() OVER w AS rn, sum(eligible::INT) OVER w AS el FROM draws WINDOW w AS (PARTITION BY pool ORDER BY t, draw_id)),
h AS (SELECT *, min(rn) OVER g AS seg, count(*) OVER g AS seg_len, rn - min(rn) OVER g + 1 AS idx
      FROM numbered WHERE eligible WINDOW g AS (PARTITION BY pool, rn - el)),
x AS (SELECT pool, draw_id, seg, seg_len, idx, machine, unnest(numbers) AS label, unnest(range(1, 6)) AS pos FROM h),
pools AS (SELECT pool, count(*)::DOUBLE AS n FROM h GROUP BY pool),
lab AS (SELECT unnest(range(1, 48)) AS label)"""


def sql(rest: str) -> str:
    return f"WITH {DRAWS} {rest}"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reports: key is the order, source the supplier, tier 1..3; zero discounts and taxes are missing."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("source"), (1 + F.col("l_suppkey") % 3).cast("int").alias("tier"), F.col("l_quantity").alias("quantity"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"), "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ranked(staged(spark, sf_dir), ["key"], ORDER)


ORDER = ["tier", "source", "l_linenumber", "l_partkey", "quantity", "l_extendedprice"]
STAGED = """staged AS (
    SELECT l_orderkey AS key, l_suppkey AS source, (1 + l_suppkey % 3)::INT AS tier, l_quantity AS quantity,
           nullif(l_discount, 0.0) AS discount, nullif(l_tax, 0.0) AS tax, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_shipdate FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, source, l_linenumber, l_partkey, quantity, l_extendedprice)::INT AS rank FROM staged)"""


def eras(spark: SparkSession) -> DataFrame:
    rows = [(f"{p[0]}{era}", p, lo, hi, clear, f"{p[0]}{pool}") for p in PRIORITIES for era, lo, hi, clear, pool in SPANS]
    text = spark.createDataFrame(rows, "era string, game string, lo string, hi string, clear_from string, pool string")
    return text.withColumns({c: F.col(c).cast("date") for c in ("lo", "hi", "clear_from")})


def _day(x: str | None) -> str:
    return f"DATE '{x}'" if x else "NULL::DATE"


ERAS = "eras(era, game, lo, hi, clear_from, pool) AS (VALUES " + ", ".join(f"('{p[0]}{e}', '{p}', {_day(lo)}, {_day(hi)}, {_day(c)}, '{p[0]}{pool}')" for p in PRIORITIES for e, lo, hi, c, pool in SPANS) + ")"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("game"), F.col("o_orderdate").cast("date").alias("d"), "o_orderdate", "o_custkey", "o_totalprice")
