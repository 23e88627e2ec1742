"""Rule eras: which era a draw belongs to, and checks on the eras themselves.

eras: era, game, lo (date), hi (date or null: ongoing), clear_from (date or null: the first date that is certain), pool.
Draws are assigned by bins of days, so eras may be many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forever():
    return F.lit("9999-12-31").cast("date")


#: Days of a bin of the interval join.
BIN = 64


def binned(eras: DataFrame) -> tuple[DataFrame, int, int]:
    """(game, bin, eras): the eras that reach into each bin of days, and the first and the last bin. All days after the last bound
    of any era are alike, so an era that goes on ends in the last bin; a span has a row for each of its bins."""
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BIN)
    low, high = eras.agg(F.min(number(F.col("lo"))), F.max(F.greatest(number(F.col("lo")), number(F.coalesce("hi", "lo"))))).first()
    low, high = int(low or 0) - 1, int(high or 0) + 1
    last = F.when(F.col("hi").isNull(), F.lit(high)).otherwise(number(F.col("hi")))
    rows = eras.where("hi IS NULL OR hi >= lo").select("game", F.explode(F.sequence(number(F.col("lo")).cast("int"), last.cast("int"))).alias("bin"), F.struct("lo", F.coalesce("hi", forever()).alias("hi"), "clear_from", "era", "pool").alias("e"))
    return rows.groupBy("game", "bin").agg(F.array_sort(F.collect_list("e")).alias("eras")), low, high


def assign(draws: DataFrame, eras: DataFrame, game: str = "game", day: str = "d") -> DataFrame:
    """Adds era, pool and status: ok, quarantined (before the era's certain date), none or ambiguous.

    A quarantined draw gets the first containing era; none and ambiguous get nulls. Draws meet the eras of their bin of days by an
    equi join, which Spark broadcasts where the eras are few and shuffles otherwise; dates decide within the bin.
    """
    bins, low, high = binned(eras)
    bins = bins.select(F.col("game").alias("__game"), F.col("bin").alias("__bin"), F.col("eras").alias("__eras"))
    own = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / BIN)))
    joined = draws.join(bins, (F.col(game) == F.col("__game")) & (own == F.col("__bin")), "left").drop("__game", "__bin")
    inside = joined.withColumn("__in", F.filter(F.coalesce("__eras", F.array().cast(bins.schema["__eras"].dataType)), lambda e: (e["lo"] <= F.col(day)) & (F.col(day) <= e["hi"])))
    early = F.exists("__in", lambda e: e["clear_from"].isNotNull() & (F.col(day) < e["clear_from"]))
    status = F.when(F.size("__in") == 0, "none").when(early, "quarantined").when(F.size("__in") > 1, "ambiguous").otherwise("ok")
    out = inside.withColumn("status", status)
    first = F.when(F.col("status").isin("ok", "quarantined"), F.try_element_at("__in", F.lit(1)))
    return out.withColumns({"era": first["era"], "pool": first["pool"]}).drop("__in", "__eras")


def shared_pools(eras: DataFrame) -> DataFrame:
    """(pool, games, n_eras): pools that eras of several games claim; only draws of one game may be pooled."""
    return eras.groupBy("pool").agg(F.array_sort(F.collect_set("game")).alias("games"), F.count(F.lit(1)).alias("n_eras")).where("size(games) > 1")


def require(assigned: DataFrame) -> DataFrame:
    """The same rows; running it raises on a draw whose era is not certain."""
    good = F.col("status") == "ok"
    return assigned.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no certain era: "), F.col("status"))).cast("boolean")))


def unknown_pools(draws: DataFrame, eras: DataFrame) -> DataFrame:
    """Draws whose era is not registered: any row here forbids pooling."""
    return draws.join(eras.select("era").distinct(), "era", "left_anti")


def pool_conflicts(eras: DataFrame, *matrix: str) -> DataFrame:
    """Pools whose eras disagree on the draw's matrix columns."""
    return eras.groupBy("pool").agg(F.count_distinct(F.struct(*matrix)).alias("n_matrices")).where("n_matrices > 1")


#: Change classes that begin a new pool, and those that must not (fixed values).
MATERIAL, MINOR = ("baseline", "matrix", "mechanism"), ("schedule", "economic", "administrative")


def integrity(eras: DataFrame) -> DataFrame:
    """(game, era, problem): duplicate ids, reversed spans, overlaps with the era before, gaps after it, quarantines.

    With a column weekdays (array, Monday 0) a gap counts only if a draw day of either era lies in it; with a column change,
    material changes must begin a new pool and minor ones must not; with verified, such eras must have no quarantine.
    """
    by = Window.partitionBy("game").orderBy("lo", "era")
    e = eras.withColumns({"before": F.lag(F.coalesce("hi", forever())).over(by), "same": F.count(F.lit(1)).over(Window.partitionBy("era")), "nth": F.row_number().over(Window.partitionBy("pool").orderBy("game", F.asc_nulls_last("lo"), "era"))})
    gap = F.col("lo") > F.date_add("before", 1)
    if "weekdays" in eras.columns:
        days = F.array_union("weekdays", F.coalesce(F.lag("weekdays").over(by), F.array().cast("array<int>")))
        e = e.withColumn("days", days)
        inside = F.expr("exists(sequence(date_add(before, 1), date_add(lo, -1)), x -> array_contains(days, weekday(x)))")
        gap = F.when(gap, inside).otherwise(False)
    never = F.lit(False)
    change = F.col("change") if "change" in eras.columns else F.lit(None).cast("string")
    problems = F.array(
        F.when(F.col("same") > 1, "duplicate_id"),
        F.when(F.col("hi") < F.col("lo"), "reversed_span"),
        F.when(F.col("lo") <= F.col("before"), "overlap"),
        F.when(gap, "gap"),
        F.when(F.col("clear_from") <= F.col("lo"), "empty_quarantine"),
        F.when(F.col("clear_from") > F.col("hi"), "quarantine_past_end"),
        F.when((F.col("verified") if "verified" in eras.columns else never) & F.col("clear_from").isNotNull(), "verified_quarantine"),
        F.when(change.isin(*MATERIAL) & (F.col("nth") > 1), "material_change_reuses_pool"),
        F.when(change.isin(*MINOR) & (F.col("nth") == 1), "minor_change_begins_pool"),
        F.when(F.col("lo").isNull(), "undated"),
    )
    return e.select("game", "era", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def listing(eras: DataFrame, draws: DataFrame) -> DataFrame:
    """Every era with its span and how many draws (column era) it has, in order of game and first day."""
    n = draws.groupBy("era").agg(F.count(F.lit(1)).alias("n_draws"))
    return eras.join(n, "era", "left").select("game", "era", "pool", "lo", "hi", "clear_from", F.coalesce("n_draws", F.lit(0)).alias("n_draws")).orderBy("game", "lo", "era")


def expected_days(spans: DataFrame, weekdays: list[int]) -> DataFrame:
    """(keys of spans, d): the days of lo..hi that fall on these weekdays (Monday 0)."""
    keys = [c for c in spans.columns if c not in ("lo", "hi")]
    days = spans.select(*keys, F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.where(F.weekday("d").isin(weekdays))


def schedule_audit(spans: DataFrame, observed: DataFrame, weekdays: list[int]) -> DataFrame:
    """(keys, d, state): expected days without a draw (missing) and draws off schedule (extra)."""
    keys = [c for c in spans.columns if c not in ("lo", "hi")]
    want, have = expected_days(spans, weekdays), observed.select(*keys, "d").distinct()
    missing = want.join(have, [*keys, "d"], "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(have.join(want, [*keys, "d"], "left_anti").withColumn("state", F.lit("extra")))


def order_audit(draws: DataFrame, by: list[str], year: str) -> DataFrame:
    """Adds claim: whether a stored sequence can be the order of drawing.

    If every sequence of a group's year is ascending the source sorts ("sorted"); otherwise an ascending one is
    "unknown" and the rest are "physical". The group's verdict is an aggregate joined back.
    """
    rows = draws.withColumn("__asc", F.col("numbers") == F.array_sort("numbers"))
    whole = rows.groupBy(*by, year).agg(F.bool_and("__asc").alias("__all"))
    return rows.join(whole, [*by, year]).withColumn("claim", F.when(F.col("__all"), "sorted").when(F.col("__asc"), "unknown").otherwise("physical")).drop("__asc", "__all")
