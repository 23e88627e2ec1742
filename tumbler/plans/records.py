"""Queries over the canonical build and its guards, eras, seals and payload forms; importing this module adds them to the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler import scratch
from tumbler.functions import exact
from tumbler.operators import audit, history, merkle, primary, reconcile, regimes, splits
from tumbler.plans import views
from tumbler.plans.catalog import ASSIGNED, CANON, FIELDS, ORDERED, PAIRED, SPLIT, STRUCT, query
from tumbler.plans.views import ERAS, MATRIX, sql
from tumbler.sources import lines, payloads

# ------------------------------------------------------------------ canonical build and eligibility
LEDGER_VALUE, EVIDENCE = 25.0, 77


def _pref():
    return F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def _reports(spark, sf_dir: str) -> DataFrame:
    facts = views.orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "game", "d")
    return views.ranked(spark, sf_dir).join(facts, "key")


def _ledger(spark, sf_dir: str) -> DataFrame:
    """Dear orders have an entry for the quantity; those still open are not resolved yet."""
    dear = views.table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return dear.select(F.col("o_orderkey").alias("key"), F.lit("quantity").alias("field"), F.lit(str(LEDGER_VALUE)).alias("resolved_value"), F.lit(str(EVIDENCE)).alias("evidence"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"))


def _canonical(spark, sf_dir: str) -> DataFrame:
    return reconcile.canonical_rows(_reports(spark, sf_dir), ["key"], FIELDS, _ledger(spark, sf_dir), views.eras(spark), "quantity", _pref())


FULL = f"""{CANON}, {ERAS}, fact AS (SELECT o_orderkey AS key, o_orderpriority AS game, o_orderdate::DATE AS d FROM orders),
sq AS (SELECT key, source AS seq_source, quantity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, rank) AS n FROM ranked WHERE rank = 1 OR tier <= 2) WHERE n = 1),
dif AS (SELECT key, field, bool_or(va IS DISTINCT FROM vb) AS x FROM pairs GROUP BY ALL),
led AS (SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'),
hit AS (SELECT dif.key FROM dif JOIN led USING (key) WHERE field = 'quantity' AND x),
mt AS (SELECT f.key, f.game, f.d, min(e.era) AS era, min(e.pool) AS pool, min(e.clear_from) AS clear_from, count(e.era) AS n, coalesce(bool_or(f.d < e.clear_from), false) AS early FROM fact f LEFT JOIN eras e ON e.game = f.game AND f.d BETWEEN e.lo AND coalesce(e.hi, DATE '9999-12-31') GROUP BY ALL),
full_ AS (SELECT c.key, c.source, c.tier, CASE WHEN h.key IS NOT NULL THEN {LEDGER_VALUE} ELSE sq.quantity END AS quantity, c.discount, c.tax, c.n_corroborating, CASE WHEN h.key IS NOT NULL THEN {EVIDENCE} ELSE sq.seq_source END AS seq_source,
    c.conflict_quantity AND h.key IS NULL AS conflict_quantity, mt.game, mt.d, mt.era, mt.pool, mt.clear_from, mt.n, mt.early FROM canon c JOIN sq ON sq.key = c.key JOIN mt ON mt.key = c.key LEFT JOIN hit h ON h.key = c.key)"""


@query("canonical_draws", f"{FULL} SELECT 'O' || game[1:1] || '-D-' || d || CASE WHEN quantity > 40 THEN '-DP' ELSE '' END AS draw_id, key, era, pool, source, seq_source::BIGINT AS seq_source, quantity::DOUBLE AS quantity, discount, tax, conflict_quantity, CASE WHEN early THEN 'QUARANTINED' END AS status FROM full_ WHERE n = 1 OR early")
def canonical_draws(spark, sf_dir):
    """Order lines as reports, through precedence, filled fields, sequence source, ledger and eras, with canonical ids."""
    out = _canonical(spark, sf_dir)
    name = reconcile.canonical_id(F.concat(F.lit("O"), F.substring("game", 1, 1)), F.col("d"), F.col("quantity") > 40)
    return out.select(name.alias("draw_id"), "key", "era", "pool", "source", F.col("seq_source").cast("long").alias("seq_source"), F.col("quantity").cast("double").alias("quantity"), "discount", "tax", "conflict_quantity", "status")


def _gated(spark, sf_dir: str) -> DataFrame:
    """Canonical rows of all orders, dated or not, through the gate. Rows without tax have no checksum, those without discount
    no status yet."""
    rows = reconcile.canonical(_reports(spark, sf_dir), ["key"], FIELDS)
    o = views.table(spark, sf_dir, "orders")
    placed = regimes.assign(rows.join(views.orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "game", "d"), "key"), views.eras(spark))
    clear = views.eras(spark).select(F.col("era").alias("e"), "clear_from")
    placed = placed.join(F.broadcast(clear), F.col("era") == F.col("e"), "left")
    status = F.when(F.col("quantity") > 45, "REJECTED").when(F.col("status") == "quarantined", "QUARANTINED").when(F.col("discount").isNull(), "PENDING").otherwise("VALID")
    canon = placed.select("key", "source", F.when(F.col("tax").isNotNull(), F.sha2(F.col("key").cast("string"), 256)).alias("sha256"), status.alias("status"), (F.col("n_corroborating") == 0).alias("provisional"), (F.col("tier") <= 2).alias("official"), "era", "clear_from", "d", F.col("conflict_quantity").alias("conflict"), F.when(F.col("tax").isNull(), "no tax").alias("notes"))
    excluded = o.where("o_totalprice > 450000").select(F.col("o_orderkey").alias("key"), F.lit("too_dear").alias("reason"), F.lit("D1").alias("decision_id"))
    return reconcile.eligibility_codes(canon, excluded, "key")


GATED = f"""{CANON}, {ASSIGNED.removeprefix("WITH ")}, g0 AS (SELECT c.*, a.d, a.era, a.status AS placed, e.clear_from FROM canon c JOIN assigned a ON a.o_orderkey = c.key LEFT JOIN (SELECT era, clear_from FROM eras) e ON e.era = a.era),
g1 AS (SELECT *, CASE WHEN quantity > 45 THEN 'REJECTED' WHEN placed = 'quarantined' THEN 'QUARANTINED' WHEN discount IS NULL THEN 'PENDING' ELSE 'VALID' END AS st, key IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) AS ex FROM g0),
g2 AS (SELECT *, list_filter([CASE WHEN ex THEN ['excluded_non_draw_artifact', 'excluded by ledger (too_dear; D1)'] END, CASE WHEN tax IS NULL THEN ['missing_provenance', 'missing provenance'] END,
    CASE WHEN st = 'REJECTED' THEN ['structural_rejection', 'validation_status=REJECTED'] END, CASE WHEN st = 'QUARANTINED' THEN ['boundary_quarantine', 'validation_status=QUARANTINED'] END, CASE WHEN st = 'PENDING' THEN ['invalid_status', 'validation_status=PENDING'] END,
    CASE WHEN n_corroborating = 0 THEN ['provisional_source', 'provisional source'] END, CASE WHEN tier > 2 THEN ['unofficial_source_only', 'no authoritative (tier<=2) source'] END, CASE WHEN era IS NULL THEN ['no_regime', 'no regime'] END,
    CASE WHEN d < clear_from THEN ['boundary_quarantine', 'quarantine window'] END, CASE WHEN conflict_quantity THEN ['unresolved_conflict', 'unresolved winning-number conflict'] END], lambda r: r IS NOT NULL) AS h FROM g1),
gated AS (SELECT *, array_to_string(list_transform(h, lambda x: x[1]), ';') AS codes, array_to_string(list_concat(CASE WHEN tax IS NULL THEN ['no tax'] ELSE [] END, list_transform(h, lambda x: x[2])), '; ') AS notes, len(h) = 0 AS eligible FROM g2)"""


@query("eligibility_codes", f"{GATED} SELECT key, codes, notes, eligible FROM gated")
def eligibility_codes(spark, sf_dir):
    return _gated(spark, sf_dir).select("key", F.array_join("codes", ";").alias("codes"), "notes", "eligible")


@query("authority_checks", f"""{GATED}, seqs AS (SELECT key, source AS seq_source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, rank) AS n FROM ranked WHERE rank = 1 OR tier <= 2) WHERE n = 1),
c(name, n) AS (SELECT 'key_unique', count(*) FROM (SELECT key FROM gated GROUP BY key HAVING count(*) > 1)
UNION ALL SELECT 'provenanced', count(*) FROM gated WHERE tax IS NULL UNION ALL SELECT 'eligible_is_valid', count(*) FROM gated WHERE eligible AND st <> 'VALID'
UNION ALL SELECT 'no_eligible_quarantined', count(*) FROM gated WHERE eligible AND d < clear_from UNION ALL SELECT 'no_eligible_unofficial', count(*) FROM gated WHERE eligible AND tier > 2
UNION ALL SELECT 'sequence_from_backing_source', count(*) FROM seqs ANTI JOIN ranked r ON r.key = seqs.key AND r.source = seqs.seq_source)
SELECT name AS "check", n = 0 AS passed, n::BIGINT AS n_violations FROM c""")
def authority_checks(spark, sf_dir):
    g, rows = _gated(spark, sf_dir), _reports(spark, sf_dir)
    ok = g.where("eligible")
    seqs = reconcile.sequence_source(rows, ["key"], _pref(), ["source"])
    return audit.checks({
        "key_unique": audit.unique(g, ["key"]), "provenanced": g.where("sha256 IS NULL"), "eligible_is_valid": ok.where("status <> 'VALID'"),
        "no_eligible_quarantined": ok.where("d < clear_from"), "no_eligible_unofficial": ok.where("NOT official"),
        "sequence_from_backing_source": seqs.join(rows.select("key", "source"), ["key", "source"], "left_anti"),
    })


# ------------------------------------------------------------------ eras
def _used(spark, sf_dir: str) -> DataFrame:
    era = F.substring("era", 2, 2)
    pick = lambda named, kind: F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in named.items() for x in kv])[era].cast(kind)
    e = views.eras(spark).withColumns({"weekdays": pick(views.DAYS, "array<int>"), "change": pick(views.CHANGES, "string"), "verified": era == "E3", "k": F.when(era == "E3", 6).otherwise(5)})
    return e.join(views.orders(spark, sf_dir).select("game").distinct(), "game", "left_semi")


MARKED = f"""WITH {ERAS}, used AS (SELECT DISTINCT o_orderpriority AS game FROM orders), e AS (SELECT eras.*, era[2:3] AS kind, lag(coalesce(hi, DATE '9999-12-31')) OVER (PARTITION BY game ORDER BY lo, era) AS before, row_number() OVER (PARTITION BY pool ORDER BY game, lo, era) AS nth FROM eras JOIN used USING (game)),
dd AS (SELECT era, before, lo, game, kind, CASE kind WHEN 'E1' THEN [0, 2] WHEN 'E2' THEN [0, 2, 5] ELSE [1, 4] END AS own FROM e), d2 AS (SELECT *, lag(own) OVER (PARTITION BY game ORDER BY lo, era) AS prev FROM dd),
gaps AS (SELECT game, era FROM d2 WHERE lo > before + 1 AND len(list_filter(generate_series(before::TIMESTAMP + INTERVAL 1 DAY, lo::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: list_contains(list_concat(own, coalesce(prev, [])), isodow(x) - 1))) > 0)"""


@query("regime_novelty", f"""{MARKED} SELECT game, era, 'gap' AS problem FROM gaps UNION ALL SELECT game, era, 'overlap' FROM e WHERE lo <= before UNION ALL SELECT game, era, 'verified_quarantine' FROM e WHERE kind = 'E3' AND clear_from IS NOT NULL
UNION ALL SELECT game, era, 'material_change_reuses_pool' FROM e WHERE kind IN ('E1', 'E3') AND nth > 1 UNION ALL SELECT game, era, 'minor_change_begins_pool' FROM e WHERE kind = 'E2' AND nth = 1 UNION ALL SELECT game, era, 'quarantine_past_end' FROM e WHERE clear_from > hi UNION ALL SELECT game, era, 'empty_quarantine' FROM e WHERE clear_from <= lo""")
def regime_novelty(spark, sf_dir):
    """The eras in use with weekdays and change classes: gaps on draw days, changes against pools, proven eras in quarantine."""
    return regimes.integrity(_used(spark, sf_dir))


@query("pool_matrix_conflicts", f"WITH {ERAS}, used AS (SELECT DISTINCT o_orderpriority AS game FROM orders) SELECT pool, count(DISTINCT CASE WHEN era[2:3] = 'E3' THEN 6 ELSE 5 END)::BIGINT AS n_matrices FROM eras JOIN used USING (game) GROUP BY pool HAVING n_matrices > 1")
def pool_matrix_conflicts(spark, sf_dir):
    return regimes.pool_conflicts(_used(spark, sf_dir), "k")


@query("era_listing", f"{ASSIGNED} SELECT game, era, pool, lo::VARCHAR AS lo, hi::VARCHAR AS hi, clear_from::VARCHAR AS clear_from, n_draws FROM (SELECT e.game, e.era, e.pool, e.lo, e.hi, e.clear_from, count(a.era)::BIGINT AS n_draws FROM eras e LEFT JOIN assigned a ON a.era = e.era GROUP BY ALL)")
def era_listing(spark, sf_dir):
    out = regimes.listing(views.eras(spark), regimes.assign(views.orders(spark, sf_dir), views.eras(spark)))
    return out.withColumns({c: F.col(c).cast("string") for c in ("lo", "hi", "clear_from")})


@query("era_claims", f"{ASSIGNED} SELECT o_orderkey, era AS actual, CASE WHEN era IS NULL THEN 'unassigned' WHEN era[2:3] <> 'E1' THEN 'differs' ELSE 'agrees' END AS claim FROM assigned")
def era_claims(spark, sf_dir):
    """Every order claims its game's first era; the spans say which it is."""
    a = regimes.assign(views.orders(spark, sf_dir), views.eras(spark))
    claim = F.when(F.col("era").isNull(), "unassigned").when(F.col("era") != F.concat(F.substring("game", 1, 1), F.lit("E1")), "differs").otherwise("agrees")
    return a.select("o_orderkey", F.col("era").alias("actual"), claim.alias("claim"))


# ------------------------------------------------------------------ firewall, seals, plans
@query("firewall_ids", f"WITH {SPLIT} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM split WHERE split = 'exploration')")
def firewall_ids(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    ids = splits.chronological(o, "o_orderpriority", "o_orderdate", "o_orderkey").where("split = 'exploration'").select("o_orderkey")
    return splits.only_ids(o.select("o_orderkey", "o_custkey"), ids, "o_orderkey")


def _merkle(rows: str, levels: int = 6) -> str:
    """Seals by hash tree of rows(g, h), for up to so many levels below the root: sealed(g, n, seal)."""
    leaf = lambda d: f"SELECT g, left(h, {d}) AS p, sha256(string_agg(h || '*' || c, ',' ORDER BY h)) AS s FROM hc JOIN sz USING (g) WHERE d = {d} GROUP BY ALL"
    parts = [f"t{levels} AS ({leaf(levels)})"]
    parts += [f"t{d} AS ({leaf(d)} UNION ALL SELECT g, left(p, {d}) AS up, sha256(string_agg(right(p, 1) || s, '' ORDER BY p)) FROM t{d + 1} GROUP BY g, up)" for d in range(levels - 1, -1, -1)]
    deep = " + ".join(f"(sum(c) > {256 * 16**d})::INT" for d in range(levels))
    return f"hh(g, h) AS ({rows}), hc AS (SELECT g, h, count(*)::BIGINT AS c FROM hh GROUP BY ALL), sz AS (SELECT g, sum(c)::BIGINT AS n, {deep} AS d FROM hc GROUP BY g), {', '.join(parts)}, sealed AS (SELECT g, n, sha256(n || ':' || s) AS seal FROM sz JOIN t0 USING (g))"


def _row(*cols: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in cols) + ")"


@query("row_seal", f"WITH {_merkle('SELECT 0, ' + _row('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_returnflag') + ' FROM lineitem')} SELECT n, seal FROM sealed")
def row_seal(spark, sf_dir):
    return splits.seal(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])


@query("line_seal", f"WITH {_merkle('SELECT 0, ' + _row("'part-0.txt'", 'o', 'line') + " FROM (SELECT line, coalesce(sum(strlen(line) + 1) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, o_orderkey FROM (SELECT o_orderkey, o_orderkey || ',' || o_custkey || ',' || o_orderstatus AS line FROM orders)) WHERE o_orderkey % 5 = 0")} SELECT n, seal FROM sealed")
def line_seal(spark, sf_dir):
    """Orders written as lines of one text, in parts, in order of their keys; the raw lines of every fifth order are sealed with their offsets."""
    o = views.table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")
    path = f"{scratch.folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write_ordered(o, "o_orderkey", line, path)
    rows = merkle.lines(spark, path, True).withColumn("file", F.lit("part-0.txt"))
    fifth = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return merkle.seal(rows.withColumn("id", F.substring_index("line", ",", 1)).join(fifth, "id", "left_semi"), ["file", "offset", "line"])


@query("split_manifest", f"WITH {SPLIT}, {_merkle("SELECT o_orderpriority, " + _row("o_orderkey") + " FROM split WHERE split = 'holdout'")}, y AS (SELECT o_orderpriority, count(*) FILTER (split = 'exploration')::BIGINT AS n_exploration, count(*) FILTER (split = 'holdout')::BIGINT AS n_holdout, (max(o_orderdate) FILTER (split = 'exploration'))::DATE::VARCHAR AS last_exploration, (min(o_orderdate) FILTER (split = 'holdout'))::DATE::VARCHAR AS first_holdout FROM split GROUP BY ALL) SELECT y.*, seal AS holdout_seal FROM y JOIN sealed ON y.o_orderpriority = sealed.g")
def split_manifest(spark, sf_dir):
    s = splits.chronological(views.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return splits.manifest(s, "o_orderpriority", "o_orderdate", "o_orderkey").withColumns({c: F.col(c).cast("date").cast("string") for c in ("last_exploration", "first_holdout")})


@query("observation_plan", sql(f", {ORDERED}, a AS (SELECT DISTINCT pool, seg, seg_len FROM h), o AS (SELECT pool, min(rn) AS seg, count(*) AS len FROM nv WHERE ok GROUP BY pool, rn - el), t AS (SELECT pool, count(*)::BIGINT AS n_draws, min(t)::DATE::VARCHAR AS first_day, max(t)::DATE::VARCHAR AS last_day FROM h GROUP BY pool), s1 AS (SELECT pool, string_agg(seg_len::VARCHAR, ';' ORDER BY seg) AS segments FROM a GROUP BY pool), s2 AS (SELECT pool, string_agg(len::VARCHAR, ';' ORDER BY seg) AS order_segments FROM o GROUP BY pool) SELECT t.*, segments, order_segments, sha256(t.pool || '|' || n_draws || '|' || segments || '|' || coalesce(order_segments, '')) AS plan_hash FROM t JOIN s1 USING (pool) LEFT JOIN s2 USING (pool)"))
def observation_plan(spark, sf_dir):
    """Per pool: draws, days, lengths of segments and of segments in known order, and a hash of all that."""
    return history.observation_plan(views.draws(spark, sf_dir).withColumn("ordered", F.col("machine") != 0), "ordered")


@query("segment_draws", sql(" SELECT h.pool, h.seg::BIGINT AS seg, min(h.draw_id) AS draw_id, count(*)::BIGINT AS n FROM h JOIN (SELECT pool, seg, min(t) AS first_t FROM h GROUP BY ALL) s ON s.pool = h.pool AND s.first_t = h.t GROUP BY h.pool, h.seg"))
def segment_draws(spark, sf_dir):
    """The draws at the first time of each segment, looked up by pool and time."""
    h = views.history(spark, sf_dir)
    return history.at_times(h, history.segments(h).select("pool", F.col("first_t").alias("t")).distinct()).groupBy("pool", "seg").agg(F.min("draw_id").alias("draw_id"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ payload forms
@query("dispatch_parsed", "SELECT CASE o_orderstatus WHEN 'F' THEN 'positional' ELSE 'dated' END AS source, o_orderdate::DATE::VARCHAR AS d, ((1 + o_orderkey % 50) || CASE o_orderstatus WHEN 'F' THEN ';' || (1 + o_custkey % 50) ELSE '' END) AS numbers FROM orders WHERE o_orderstatus <> 'P'")
def dispatch_parsed(spark, sf_dir):
    """Orders as payloads of two sources, each with its parser, after their hashes have been compared; state P is a third
    source without a parser, which gives nothing."""
    o = views.table(spark, sf_dir, "orders")
    a, b = F.expr("1 + o_orderkey % 50").cast("string"), F.expr("1 + o_custkey % 50").cast("string")
    positional = F.concat_ws(",", "o_orderpriority", F.date_format("o_orderdate", "M,d,yyyy"), a, b, F.lit("3"), F.lit("2"))
    dated = F.concat_ws(",", F.date_format("o_orderdate", "M/d/yyyy"), a, F.lit("4"), F.lit("3x"), F.lit("$1.0M"))
    content = F.when(F.col("o_orderstatus") == "F", positional).otherwise(dated)
    source = F.when(F.col("o_orderstatus") == "F", "positional").when(F.col("o_orderstatus") == "P", "unknown").otherwise("dated")
    rows = o.select(source.alias("source"), content.alias("content"), F.sha2(content.cast("binary"), 256).alias("sha256"))
    parsers = {"positional": lambda x: payloads.positional_csv_draws(x, 2), "dated": lambda x: payloads.dated_csv_draws(x, 1)}
    return payloads.dispatch(rows, parsers).select("source", F.col("d").cast("string").alias("d"), reconcile.shown(F.col("numbers"), "array").alias("numbers"))


@query("history_lines", """WITH o AS (SELECT *, (1 + o_orderkey % 40) AS a, (41 + o_custkey % 9) AS b, o_orderkey % 9 AS s, o_linenumber AS form FROM (SELECT orders.*, l_linenumber AS o_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey))
SELECT CASE WHEN form <= 4 THEN 'lotto' WHEN form = 5 THEN 'powerball' ELSE 'mega' END AS game, o_orderdate::DATE::VARCHAR AS d, CASE WHEN form IN (2, 5) THEN 'second' ELSE 'main' END AS stream, a || ';' || b AS numbers,
    CASE WHEN form IN (5, 6) THEN s END::INT AS special, CASE WHEN form IN (3, 5) THEN 4 WHEN form = 6 AND s > 4 THEN 3 END::INT AS multiplier, CASE WHEN form <= 3 THEN s::VARCHAR END AS machine, CASE WHEN form <= 3 THEN 'C' END AS balls FROM o WHERE form <= 6""")
def history_lines(spark, sf_dir):
    """Order lines as lines of a tagged history, in six forms by line number; others have a tag that no form knows."""
    o = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("form")), "o_orderkey")
    s = F.expr("o_orderkey % 9").cast("string")
    head = F.concat(F.date_format("o_orderdate", "M/d/yy"), F.lit(" "), F.expr("1 + o_orderkey % 40").cast("string"), F.lit(" "), F.expr("41 + o_custkey % 9").cast("string"))
    more = F.when(F.expr("o_orderkey % 9") > 4, F.lit(" X3")).otherwise(F.lit(""))
    tails = {1: F.concat(F.lit(" LOTTO "), s, F.lit(" / C")), 2: F.concat(F.lit(" LOTTO DP "), s, F.lit(" / C")), 3: F.concat(F.lit(" X4 "), s, F.lit(" / C")), 4: F.lit(""), 5: F.concat(F.lit(" PB "), s, F.lit(" X4 POWERBALL DP")), 6: F.concat(F.lit(" MB "), s, more)}
    tail = F.lit(" ???")
    for form, text in tails.items():
        tail = F.when(F.col("form") == form, text).otherwise(tail)
    game = F.when(F.col("form") <= 4, "lotto").when(F.col("form") == 5, "powerball").otherwise("mega")
    out = payloads.history_lines(o.select(game.alias("game"), F.concat(head, tail).alias("content")))
    return out.select("game", F.col("d").cast("string").alias("d"), "stream", reconcile.shown(F.col("numbers"), "array").alias("numbers"), "special", "multiplier", "machine", "balls")


@query("embedded_stream", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d, 'main' AS stream, ((1 + o_orderkey % 50) || ';' || (1 + o_custkey % 50)) AS numbers FROM orders UNION ALL SELECT o_orderkey, o_orderdate::DATE::VARCHAR, 'second', ((1 + o_custkey % 50) || ';' || (1 + o_orderkey % 50)) FROM orders WHERE o_orderstatus = 'F'")
def embedded_stream(spark, sf_dir):
    """Orders as blocks of an archive page; finished ones hold a second draw in the same block."""
    o = views.table(spark, sf_dir, "orders")
    a, b = (F.concat(F.lit("<i>"), F.expr(x).cast("string"), F.lit("</i>")) for x in ("1 + o_orderkey % 50", "1 + o_custkey % 50"))
    second = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Second Draw"), b, a)).otherwise("")
    special = F.concat(F.lit("<b>"), F.col("o_orderkey").cast("string"), F.lit("</b>"))
    block = F.concat(F.lit("<tr><td>"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("</td>"), a, b, special, second, F.when(F.col("o_orderstatus") == "F", special).otherwise(""), F.lit("</tr>"))
    out = payloads.html_draws(o.select(block.alias("content")), "<tr>.*?</tr>", r"<td>([0-9/]+)</td>", "MM/dd/yyyy", r"<i>(\d+)</i>", 2, r"<b>(\d+)</b>", second="Second Draw")
    return out.select(F.col("special").cast("long").alias("o_orderkey"), F.col("d").cast("string").alias("d"), "stream", reconcile.shown(F.col("numbers"), "array").alias("numbers"))


# ------------------------------------------------------------------ checks on splits and segments, manifests
@query("split_checks", f"""WITH {SPLIT}, g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (split = 'holdout') AS h, max(o_orderdate) FILTER (split = 'exploration') AS last_e, min(o_orderdate) FILTER (split = 'holdout') AS first_h FROM split GROUP BY 1),
c(name, n) AS (SELECT 'ids_on_both_sides', count(*) FROM (SELECT o_orderkey FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'ids_without_side', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM split)
UNION ALL SELECT 'holdout_of_wrong_size', count(*) FROM g WHERE h <> ceil(0.2::DOUBLE * n) UNION ALL SELECT 'holdout_before_exploration', count(*) FROM g WHERE first_h < last_e) SELECT name AS "check", n = 0 AS passed, n::BIGINT AS n_violations FROM c""")
def split_checks(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    s = splits.chronological(o, "o_orderpriority", "o_orderdate", "o_orderkey")
    g = splits.summary(s, "o_orderpriority", "o_orderdate")
    return audit.checks({
        "ids_on_both_sides": s.groupBy("o_orderkey").agg(F.count_distinct("split").alias("n")).where("n > 1"),
        "ids_without_side": o.join(s.select("o_orderkey"), "o_orderkey", "left_anti"),
        "holdout_of_wrong_size": g.where(F.col("n_holdout") != F.ceil(F.lit(0.2) * (F.col("n_exploration") + F.col("n_holdout")))),
        "holdout_before_exploration": g.where("first_holdout < last_exploration"),
    })


@query("segment_checks", sql(""", c(name, n) AS (SELECT 'eligible_draws_without_segment', count(*) FROM draws WHERE eligible AND draw_id NOT IN (SELECT draw_id FROM h) UNION ALL SELECT 'lengths_off', count(*) FROM (SELECT pool, seg FROM h GROUP BY ALL HAVING count(*) <> any_value(seg_len) OR max(idx) <> any_value(seg_len) OR min(idx) <> 1)
UNION ALL SELECT 'ineligible_draws_inside', count(*) FROM (SELECT n.draw_id FROM numbered n JOIN (SELECT pool, seg, any_value(seg_len) AS l FROM h GROUP BY ALL) s ON s.pool = n.pool AND n.rn >= s.seg AND n.rn < s.seg + s.l WHERE NOT n.eligible)) SELECT name AS "check", n = 0 AS passed, n::BIGINT AS n_violations FROM c"""))
def segment_checks(spark, sf_dir):
    d, h = views.draws(spark, sf_dir), views.history(spark, sf_dir)
    s = h.groupBy("pool", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("seg_len").alias("l"), F.max("idx").alias("last"), F.min("idx").alias("first"), F.max("rn").alias("end"))
    return audit.checks({
        "eligible_draws_without_segment": d.where("eligible").join(h.select("draw_id"), "draw_id", "left_anti"),
        "lengths_off": s.where("n <> l OR last <> l OR first <> 1"),
        # A segment's places are contiguous, so no ineligible draw stands between its first and last.
        "ineligible_draws_inside": s.where("end <> seg + l - 1"),
    })


@query("manifest_by_reason", f"{GATED}, r AS (SELECT unnest(string_split(codes, ';')) AS reason FROM gated WHERE codes <> '' UNION ALL SELECT 'eligible' FROM gated WHERE eligible) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason")
def manifest_by_reason(spark, sf_dir):
    """How many rows each code keeps out, and how many are eligible; a row counts under each of its codes."""
    g = _gated(spark, sf_dir)
    return audit.by_reason(g, "codes", "eligible")


@query("applicability", sql(f", s AS (SELECT pool, max(seg_len) AS longest FROM h GROUP BY pool), p AS (SELECT pool, count(special) > 0 AS has_special FROM h GROUP BY pool) SELECT pool, has_special AS special_statistics, longest > 1 AS serial_statistics, longest >= 5 AS rolling_statistics FROM s JOIN p USING (pool)"))
def applicability(spark, sf_dir):
    """Which families of statistics a pool's draws allow: special ones need a special label, rolling ones a window that fits."""
    return history.applicability(views.history(spark, sf_dir), 5)


BASE = exact.baseline(MATRIX)
WANTED = {"no_neighbours": BASE["no_neighbours"], "odd_mean": BASE["odd_mean"], "sum_mean": BASE["sum_mean"]}


@query("baseline_rates", sql(f", {STRUCT}, v AS (SELECT pool, unnest(['no_neighbours', 'odd_mean', 'sum_mean']) AS quantity, unnest([(adjacent_pairs = 0)::INT::DOUBLE, odd_count::DOUBLE, draw_sum::DOUBLE]) AS x FROM st) SELECT pool, quantity, round(avg(x), 6) AS observed, CASE quantity {' '.join(f'''WHEN '{k}' THEN {round(v, 6)}::DOUBLE''' for k, v in WANTED.items())} END AS expected FROM v GROUP BY ALL"))
def baseline_rates(spark, sf_dir):
    """Means over each pool's draws beside their exact expectations."""
    s = primary.structure(views.eligible(spark, sf_dir))
    values = {"no_neighbours": (F.col("adjacent_pairs") == 0).cast("double"), "odd_mean": F.col("odd_count").cast("double"), "sum_mean": F.col("draw_sum").cast("double")}
    rows = s.select("pool", F.inline(F.array(*[F.struct(F.lit(k).alias("quantity"), x.alias("x"), F.lit(round(WANTED[k], 6)).alias("expected")) for k, x in values.items()])))
    return rows.groupBy("pool", "quantity").agg(F.round(F.avg("x"), 6).alias("observed"), F.max("expected").alias("expected"))


@query("order_adjudication", sql(f", {PAIRED}, a AS (SELECT pool, count(*)::BIGINT AS n, avg((numbers = list_sort(numbers))::INT) AS ascending FROM h GROUP BY pool), s AS (SELECT p.pool, count(lg.pool) FILTER (list_sort(prev) = list_sort(cur)) AS same FROM pools p LEFT JOIN lg ON lg.pool = p.pool AND lag = 1 GROUP BY p.pool) SELECT a.pool, n, round(ascending, 6) AS ascending, CASE WHEN same > 0 THEN 'repeated_draws' WHEN ascending > 0.5 THEN 'sorted_suspected' ELSE 'kept' END AS verdict FROM a JOIN s USING (pool)"))
def order_adjudication(spark, sf_dir):
    """A pool whose neighbours repeat a whole draw, or more than half of whose sequences ascend, can't be taken as drawn."""
    return history.adjudicated(views.history(spark, sf_dir))
