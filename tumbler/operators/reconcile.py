"""From records as reported by several sources to one canonical row for each key.

staged: key columns, source, tier (1, 2 official; 3 and null not), the compared fields, and columns that make the
order of records total. A key has as many rows as sources report it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tumbler.operators.regimes import assign

UNKNOWN_TIER = 3
#: Ledgers and registers are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: Rows of a partition that is worked on by key.
PART = 1_000_000


def few_rows(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has at most so many rows; only so many are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, key: list[str], part: int = PART) -> DataFrame:
    """The rows dealt by key to as many partitions as leave so many rows in each, so a task's memory doesn't follow the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part)), *key)


def with_tier(staged: DataFrame, tiers: DataFrame) -> DataFrame:
    """Left join of source tiers; a source that isn't registered counts as unofficial."""
    return staged.join(few_rows(tiers.select("source", "tier")), "source", "left").withColumn("tier", F.coalesce("tier", F.lit(UNKNOWN_TIER)))


def distinct_reports(staged: DataFrame, key: list[str], signature: list[str], order: list[str]) -> DataFrame:
    """Of records alike in their parsed contents the first; the same source saying something else stays."""
    by = Window.partitionBy(*key, *signature).orderBy(*order)
    return staged.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def ranked(staged: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds rank within the key (1: the primary record)."""
    return staged.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def reports(rows: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """key and r: the key's ranked records as an array, the primary first. Ranks were worked out by key, so this needs no
    shuffle of its own; a key has as many records as sources report it."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "source", "tier", *cols))).alias("r"))


def compare(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The differences of each other record from the primary, by field, with class and status; of fields that agree only the
    first, the main one, has a row.

    MATCH, FIELD_COMPLEMENT (one side missing) or CONFLICT; a conflict of an unofficial source with an official
    primary is resolved by precedence.
    """
    first, others = F.col("r")[0], F.expr("slice(r, 2, greatest(size(r) - 1, 0))")
    pairs = reports(rows, key, fields).select(*key, first.alias("p"), F.explode(others).alias("o"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f"p.{f}").cast("string").alias("value_a"), F.col(f"o.{f}").cast("string").alias("value_b"), (F.col(f"p.{f}") == F.col(f"o.{f}")).alias("same")) for i, f in enumerate(fields)])
    out = pairs.select(*key, F.col("o.rank").alias("rank"), F.col("p.source").alias("source_a"), F.col("o.source").alias("source_b"), F.col("p.tier").alias("tier_a"), F.col("o.tier").alias("tier_b"), F.inline(cells))
    kind = F.when(F.col("value_a").isNull() & F.col("value_b").isNull(), "MATCH").when(F.col("same").isNull(), "FIELD_COMPLEMENT").when(F.col("same"), "MATCH").otherwise("CONFLICT")
    out = out.withColumn("class", kind).where("class <> 'MATCH' OR i = 0")
    secondary = (F.col("tier_a") <= 2) & (F.col("tier_b") >= 3)
    return out.withColumn("status", F.when((F.col("class") == "CONFLICT") & ~secondary, "unresolved").otherwise("resolved")).drop("same", "i")


def filled(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """For each key and field, the value of the best-ranked record that has one. A plain aggregation."""
    return rows.groupBy(*key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("rank"))).alias(f) for f in fields])


def sequence_source(rows: DataFrame, key: list[str], order_pref: Column, sequence: list[str]) -> DataFrame:
    """The record that supplies a key's sequence: the primary, or an official one (tier 1, 2) with better order
    semantics (lower order_pref). All of `sequence` comes from that one record."""
    allowed = (F.col("rank") == 1) | (F.col("tier") <= 2)
    best = F.min_by(F.struct(*sequence), F.when(allowed, F.struct(order_pref.alias("o"), F.col("rank"))))
    return rows.groupBy(*key).agg(best.alias("x")).select(*key, "x.*")


def resolve(compared: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Conflicts with a resolved ledger entry (key, field, resolved_value, status) become resolved and get its value."""
    # Entries meet their key as a list, so rows that are dealt by key stay where they are.
    entries = ledger.where("status = 'resolved'").groupBy(*key).agg(F.collect_list(F.struct("field", "resolved_value")).alias("__led"))
    own = F.transform(F.filter("__led", lambda e: e["field"] == F.col("field")), lambda e: e["resolved_value"])
    out = compared.join(few_rows(entries), key, "left").select(*compared.columns, F.explode_outer(own).alias("resolved_value"))
    hit = (F.col("class") == "CONFLICT") & F.col("resolved_value").isNotNull()
    return out.withColumns({"status": F.when(hit, "resolved").otherwise(F.col("status")), "final_value": F.when(hit, F.col("resolved_value")).otherwise(F.coalesce("value_a", "value_b"))})


def canonical(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the primary's source, filled fields, corroborating sources, and whether a conflict is open.

    Unlike the comparison table, a field missing on one side only counts as a conflict here (strict = as the
    canonical build does), unless the other source is unofficial and the primary is not.
    """
    others = F.expr("slice(r, 2, greatest(size(r) - 1, 0))")
    value = lambda f: F.try_element_at(F.filter(F.transform("r", lambda x: x[f]), lambda x: x.isNotNull()), F.lit(1))
    dispute = lambda x: (F.col("r")[0]["tier"] > 2) | (x["tier"] <= 2)
    conflict = lambda f: F.exists(others, lambda x: ~x[f].eqNullSafe(F.col("r")[0][f]) & F.coalesce(dispute(x), F.lit(False)))
    out = reports(rows, key, fields)
    return out.select(*key, F.col("r")[0]["source"].alias("source"), F.col("r")[0]["tier"].alias("tier"), *[value(f).alias(f) for f in fields], (F.size("r") - 1).cast("long").alias("n_corroborating"), *[conflict(f).alias(f"conflict_{f}") for f in fields])


def canonical_id(prefix: Column, day: Column, second: Column) -> Column:
    """PREFIX-D-2024-01-31, with -DP at the end for the second stream."""
    return F.concat(prefix, F.lit("-D-"), F.date_format(day, "yyyy-MM-dd"), F.when(second, F.lit("-DP")).otherwise(F.lit("")))


def shown(value: Column, kind: str) -> Column:
    """A value as text: nothing for null, ';' between an array's entries."""
    text = F.array_join(value.cast("array<string>"), ";") if kind.startswith("array") else value.cast("string")
    return F.coalesce(text, F.lit(""))


def canonical_rows(rows: DataFrame, key: list[str], fields: list[str], ledger: DataFrame, eras: DataFrame, sequence: str, order_pref: Column, game: str = "game", day: str = "d") -> DataFrame:
    """The canonical build as one composition: precedence, filled fields, sequence source, ledger, eras.

    rows: ranked records with game and day. ledger: (key, field, resolved_value, evidence, status). The field `sequence` comes
    whole from the sequence source (seq_source); where the records differ on a field with a resolved entry, its value is taken
    and no conflict is open, and for the sequence its evidence becomes the source. Draws without one era are left
    out; quarantined ones get the first containing era and status QUARANTINED.
    """
    base = canonical(rows, key, fields).drop(sequence)
    chosen = sequence_source(rows, key, order_pref, ["source", sequence]).withColumnRenamed("source", "seq_source")
    facts = rows.where("rank = 1").select(*key, game, day)
    differs = lambda f: F.exists("r", lambda x: ~x[f].eqNullSafe(F.col("r")[0][f]))
    raw = reports(rows, key, fields).select(*key, *[differs(f).alias(f"differs_{f}") for f in fields])
    out = base.join(chosen, key).join(facts, key).join(raw, key)
    kinds = dict(rows.dtypes)
    entries = ledger.where("status = 'resolved'").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("resolved_value", "evidence")))).alias("led"))
    out = out.join(few_rows(entries), key, "left")
    for f in fields:
        hit = F.col(f"differs_{f}") & F.col("led")[f].isNotNull()
        out = out.withColumns({f: F.when(hit, F.col("led")[f]["resolved_value"].cast(kinds[f])).otherwise(F.col(f)), f"conflict_{f}": F.col(f"conflict_{f}") & ~F.coalesce(hit, F.lit(False))})
        if f == sequence:
            out = out.withColumn("seq_source", F.when(hit, F.coalesce(F.col("led")[f]["evidence"].cast(kinds["source"]), "seq_source")).otherwise(F.col("seq_source")))
    placed = assign(out.drop("led", *[f"differs_{f}" for f in fields]), eras, game, day).where(F.col("status").isin("ok", "quarantined"))
    return placed.withColumn("status", F.when(F.col("status") == "quarantined", "QUARANTINED"))


def reasons(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """Adds an array of all reasons that hold, in order. A null condition does not hold."""
    return df.withColumn(name, F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]), lambda x: x.isNotNull()))


def structural_reasons(draws: DataFrame, k: int, low: int, high: int, specials: int) -> DataFrame:
    """Every way in which a draw breaks its matrix, and its status: REJECTED, QUARANTINED or VALID."""
    n = F.col("numbers")
    rules = [
        ("no_regime", F.col("pool").isNull()),
        ("wrong_count", F.coalesce(F.size(n), F.lit(0)) != k),
        ("repeated_number", F.size(F.array_distinct(n)) != F.size(n)),
        ("out_of_range", F.exists(n, lambda x: (x < low) | (x > high))),
        ("special_missing", F.col("special").isNull()),
        ("special_out_of_range", (F.col("special") < 1) | (F.col("special") > specials)),
    ]
    out = reasons(draws, rules)
    return out.withColumn("status", F.when(F.size("reasons") > 0, "REJECTED").when(F.coalesce(F.col("quarantined"), F.lit(False)), "QUARANTINED").otherwise("VALID"))


def eligibility(canon: DataFrame, excluded: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reasons and eligible (no reason). Keys on the exclusion ledger (decision excluded) get the first reason."""
    out_list = excluded.where("decision = 'excluded'").select(F.col(key).alias("__k")).distinct()
    joined = canon.join(out_list, F.col(key) == F.col("__k"), "left")
    out = reasons(joined, [("excluded", F.col("__k").isNotNull()), *rules])
    return out.drop("__k").withColumn("eligible", F.size("reasons") == 0)


def eligibility_codes(canon: DataFrame, excluded: DataFrame, key: str, day: str = "d") -> DataFrame:
    """Adds codes, notes and eligible (no code): every reason that keeps a canonical row from being analysed, with a note each.

    canon: key, source, sha256, status, provisional, official (some source of tier 1 or 2), era, clear_from, day, conflict, and
    notes that it has already. excluded: key, reason, decision_id. A row may get boundary_quarantine twice, for its status
    and for its date.
    """
    listed = excluded.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct("reason", "decision_id")).alias("__x"))
    rows = canon.join(few_rows(listed), F.col(key) == F.col("__k"), "left")
    status, noted = F.coalesce("status", F.lit("")), F.concat(F.lit("validation_status="), F.coalesce("status", F.lit("")))
    # Codes and notes are fixed values.
    rules = [
        ("excluded_non_draw_artifact", F.col("__k").isNotNull(), F.concat(F.lit("excluded by ledger ("), F.coalesce("__x.reason", F.lit("")), F.lit("; "), F.coalesce("__x.decision_id", F.lit("")), F.lit(")"))),
        ("missing_provenance", (F.coalesce(F.col("source").cast("string"), F.lit("")) == "") | (F.coalesce("sha256", F.lit("")) == ""), F.lit("missing provenance")),
        ("structural_rejection", status == "REJECTED", noted),
        ("boundary_quarantine", status == "QUARANTINED", noted),
        ("invalid_status", ~status.isin("REJECTED", "QUARANTINED", "VALID"), noted),
        ("provisional_source", F.col("provisional"), F.lit("provisional source")),
        ("unofficial_source_only", ~F.col("official"), F.lit("no authoritative (tier<=2) source")),
        ("no_regime", F.col("era").isNull(), F.lit("no regime")),
        ("boundary_quarantine", F.col("era").isNotNull() & (F.col(day) < F.col("clear_from")), F.lit("quarantine window")),
        ("unresolved_conflict", F.col("conflict"), F.lit("unresolved winning-number conflict")),
    ]
    hits = F.filter(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), note.alias("note"))) for code, cond, note in rules]), lambda x: x.isNotNull())
    out = rows.withColumn("__h", hits)
    notes = F.concat(F.when(F.coalesce("notes", F.lit("")) != "", F.array("notes")).otherwise(F.array().cast("array<string>")), F.transform("__h", lambda x: x["note"]))
    return out.withColumns({"codes": F.transform("__h", lambda x: x["code"]), "notes": F.array_join(notes, "; "), "eligible": F.size("__h") == 0}).drop("__h", "__k", "__x")
