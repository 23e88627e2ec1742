"""Query catalog: name -> (function of (spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.functions import exact
from tumbler.operators import history, inference, positional, primary, reconcile, regimes, secondary, splits
from tumbler.plans import views
from tumbler.plans.views import ERAS, MATRIX, ORDER, STAGED, sql
from tumbler.scratch import cut

CATALOG: dict[str, tuple[Callable, str | None]] = {}
WINDOWS, LAGS = [5, 10], [1, 2, 3, 4, 5]
P, N, K, M = 5 / 47, 47, 5, 15
MEAN, VAR = exact.moments(exact.overlap_pmf(MATRIX))


def query(name: str, oracle: str | None = None):
    def add(f):
        CATALOG[name] = (f, oracle)
        return f

    return add


#: Statistics that look at one draw at a time need no segments.
ALONE = {"fs001", "fs002", "fs003", "fs004", "fs005", "fs009", "fs010", "fs012", "fs013", "p3s001", "p3s011", "p3s012", "p3b_s001", "p3b_s002", "p3b_s003", "p3b_s004", "p3b_s005", "p3b_s006", "p3b_s010"}


#: Statistics of pairs of draws (a streak is of pairs too) read the history more than once, so it is written first.
SERIAL = {"fs006", "fs008", "fs011", "p3s002", "p3b_s007", "p3b_s008"}


def per_pool(name: str, f: Callable, oracle: str, column: str = "value", kind: str = "double") -> None:
    """A statistic with one value for each pool of the draws view."""
    source = views.eligible if name in ALONE else views.written if name in SERIAL else views.history

    def run(spark, sf_dir: str) -> DataFrame:
        value = F.col(column)
        return f(source(spark, sf_dir)).select("pool", (F.round(value.cast("double"), 6) if kind == "double" else value.cast(kind)).alias("value"))

    CATALOG[name] = (run, sql(oracle))


# ------------------------------------------------------------------ primary statistics
COUNTS = "c AS (SELECT p.pool, p.n, l.label, count(x.label) AS c FROM pools p CROSS JOIN lab l LEFT JOIN x ON x.pool = p.pool AND x.label = l.label GROUP BY ALL)"
freq = lambda h: primary.frequency(h, MATRIX)
per_pool("fs001", freq, f", {COUNTS} SELECT pool, round(sum((c - n * {P}) ** 2 / (n * {P})), 6) AS value FROM c GROUP BY pool", "chi2")
per_pool("fs002", freq, f", {COUNTS} SELECT pool, round(max(abs(c - n * {P}) / sqrt(n * {P} * (1 - {P}))), 6) AS value FROM c GROUP BY pool", "max_z")
per_pool("fs003", freq, f", {COUNTS} SELECT pool, max(c)::BIGINT AS value FROM c GROUP BY pool", "max_c", "long")
per_pool("fs004", freq, f", {COUNTS} SELECT pool, min(c)::BIGINT AS value FROM c GROUP BY pool", "min_c", "long")
PAIRS = "pr AS (SELECT a.pool, a.label AS a, b.label AS b, count(*) AS c FROM x a JOIN x b ON a.draw_id = b.draw_id AND a.label < b.label GROUP BY ALL)"
per_pool("fs005", lambda h: primary.combinations(h, 2, MATRIX).groupBy("pool").agg(F.max("c").alias("value")), f", {PAIRS} SELECT pool, max(c)::BIGINT AS value FROM pr GROUP BY pool", kind="long")
PAIRED = "lg AS (SELECT b.pool, k AS lag, a.numbers AS prev, b.numbers AS cur, a.special AS prev_special, b.special FROM h b, range(1, 6) r(k), h a WHERE a.pool = b.pool AND a.seg = b.seg AND a.idx = b.idx - k)"
per_pool("fs006", lambda h: h.select("pool").distinct().join(primary.overlap(h, [1]), "pool", "left").withColumn("value", F.coalesce("total", F.lit(0))), f", {PAIRED} SELECT p.pool, coalesce(sum(len(list_intersect(prev, cur))), 0)::BIGINT AS value FROM pools p LEFT JOIN lg ON lg.pool = p.pool AND lag = 1 GROUP BY p.pool", kind="long")
GRID = "grid AS (SELECT h.pool, h.seg, h.seg_len, h.idx, l.label, list_contains(h.numbers, l.label) AS hit FROM h CROSS JOIN lab l)"
RUNS = f"{GRID}, isl AS (SELECT *, idx - row_number() OVER (PARTITION BY pool, seg, label, hit ORDER BY idx) AS g FROM grid), runs AS (SELECT pool, hit, count(*) AS r FROM isl GROUP BY pool, seg, label, hit, g)"
per_pool("fs007", lambda h: primary.drought(h, MATRIX), f", {RUNS} SELECT pool, max(r)::BIGINT AS value FROM runs WHERE NOT hit GROUP BY pool", kind="long")
per_pool("fs008", primary.streak, f", {RUNS} SELECT pool, max(r)::BIGINT AS value FROM runs WHERE hit GROUP BY pool", kind="long")
SPECIAL = "s AS (SELECT p.pool, p.n, k, count(h.special) AS c FROM pools p CROSS JOIN range(1, 16) r(k) LEFT JOIN h ON h.pool = p.pool AND h.special = k GROUP BY ALL)"
spec = lambda h: primary.special_frequency(h, MATRIX)
per_pool("fs009", spec, f", {SPECIAL} SELECT pool, round(sum((c - n / 15) ** 2 / (n / 15)), 6) AS value FROM s GROUP BY pool", "chi2")
per_pool("fs010", spec, f", {SPECIAL} SELECT pool, round(max(abs(c - n / 15) / sqrt(n / 15 * (1 - 1 / 15.0::DOUBLE))), 6) AS value FROM s GROUP BY pool", "max_z")
per_pool("fs011", primary.special_repeats, f", {PAIRED} SELECT p.pool, count(*) FILTER (lag = 1 AND special = prev_special)::BIGINT AS value FROM pools p LEFT JOIN lg ON lg.pool = p.pool GROUP BY p.pool", kind="long")
per_pool("fs012", lambda h: primary.dispersion(h, "draw_sum"), " SELECT pool, round(var_samp(list_sum(numbers)), 6) AS value FROM h GROUP BY pool")
per_pool("fs013", lambda h: primary.dispersion(h, "odd_count"), " SELECT pool, round(var_samp(len(list_filter(numbers, lambda v: v % 2 = 1))), 6) AS value FROM h GROUP BY pool")

# ------------------------------------------------------------------ secondary statistics
per_pool("p3s001", lambda h: primary.combinations(h, 3, MATRIX).groupBy("pool").agg(F.max("c").alias("value")), ", tr AS (SELECT a.pool, count(*) AS c FROM x a JOIN x b ON a.draw_id = b.draw_id AND a.label < b.label JOIN x d ON d.draw_id = b.draw_id AND b.label < d.label GROUP BY a.pool, a.label, b.label, d.label) SELECT pool, max(c)::BIGINT AS value FROM tr GROUP BY pool", kind="long")
LAGZ = f"{PAIRED}, z AS (SELECT pool, lag, count(*) AS n_pairs, sum(len(list_intersect(prev, cur))) AS total, (sum(len(list_intersect(prev, cur))) - count(*) * {MEAN}) / sqrt(count(*) * {VAR}) AS z FROM lg GROUP BY pool, lag)"
per_pool("p3s002", lambda h: secondary.max_lag(h, MATRIX, LAGS), f", {LAGZ} SELECT p.pool, round(coalesce(max(abs(z)), 0), 6) AS value FROM pools p LEFT JOIN z ON z.pool = p.pool GROUP BY p.pool")
TERMINAL = "lastseg AS (SELECT pool, max(seg) AS seg FROM h GROUP BY pool), seen AS (SELECT x.pool, label, max(idx) AS seen_at FROM x JOIN lastseg USING (pool, seg) GROUP BY ALL), len AS (SELECT pool, max(idx) AS n FROM h JOIN lastseg USING (pool, seg) GROUP BY pool)"
per_pool("p3s003", lambda h: secondary.terminal(h, MATRIX), f", {TERMINAL} SELECT len.pool, max(n - coalesce(seen_at, 0))::BIGINT AS value FROM len CROSS JOIN lab LEFT JOIN seen ON seen.pool = len.pool AND seen.label = lab.label GROUP BY len.pool", kind="long")


def _rolling_cases(cells: str, p: float) -> str:
    parts = " UNION ALL ".join(f"SELECT pool, idx, {w} AS w, sum(hit::INT) OVER (PARTITION BY pool, seg, label, pos ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS c FROM grid WHERE seg_len >= {w}" for w in WINDOWS)
    return f", {cells}, roll AS ({parts}) SELECT p.pool, round(coalesce(max(CASE WHEN idx >= w THEN abs(c - w * {p}) / sqrt(w * {p} * (1 - {p})) END), 0), 6) AS value FROM pools p LEFT JOIN roll USING (pool) GROUP BY p.pool"


per_pool("p3s004", lambda h: secondary.max_rolling(h, WINDOWS, P, N, ["label"]), _rolling_cases("grid AS (SELECT h.pool, h.seg, h.seg_len, h.idx, l.label, 0 AS pos, list_contains(h.numbers, l.label) AS hit FROM h CROSS JOIN lab l)", P))
STRUCT = "g AS (SELECT pool, draw_id, list_sort(numbers) AS s FROM h), st AS (SELECT pool, draw_id, list_sum(s)::BIGINT AS draw_sum, (s[5] - s[1])::BIGINT AS range, len(list_filter([s[2] - s[1], s[3] - s[2], s[4] - s[3], s[5] - s[4]], lambda v: v = 1))::BIGINT AS adjacent_pairs, list_min([s[2] - s[1], s[3] - s[2], s[4] - s[3], s[5] - s[4]])::BIGINT AS min_spacing, list_max([s[2] - s[1], s[3] - s[2], s[4] - s[3], s[5] - s[4]])::BIGINT AS max_spacing, len(list_filter(s, lambda v: v % 2 = 1))::BIGINT AS odd_count, (1 + len(list_filter([s[2] - s[1], s[3] - s[2], s[4] - s[3], s[5] - s[4]], lambda v: v > 1)))::BIGINT AS run_starts FROM g)"
EXACT = {"draw_sum": exact.sum_pmf(MATRIX), "range": exact.range_pmf(MATRIX), "adjacent_pairs": exact.adjacent_pmf(MATRIX), "min_spacing": exact.min_spacing_pmf(MATRIX), "max_spacing": exact.max_spacing_pmf(MATRIX), "odd_count": exact.odd_pmf(MATRIX)}
for _i, _q in enumerate(EXACT, 5):

    def _cvm(spark, sf_dir: str, q: str = _q) -> DataFrame:
        values = primary.structure(views.eligible(spark, sf_dir)).select("pool", F.lit(q).alias("quantity"), F.col(q).alias("x"))
        reference = spark.createDataFrame([(q, x, p) for x, p in EXACT[q].items()], "quantity string, x long, p double")
        return secondary.discrepancy(values, reference).select("pool", F.round("value", 6).alias("value"))

    _ref = f"ref(x, p) AS (VALUES {', '.join(f'({x}, {p!r}::DOUBLE)' for x, p in EXACT[_q].items())})"
    CATALOG[f"p3s{_i:03d}"] = (_cvm, sql(f", {STRUCT}, {_ref}, f0 AS (SELECT x, p, sum(p) OVER (ORDER BY x) AS f0 FROM ref) SELECT pool, round(sum(p * (f - f0) ** 2), 6) AS value FROM (SELECT st.pool, f0.x, p, f0, count(*) FILTER (st.{_q} <= f0.x) / count(*)::DOUBLE AS f FROM st CROSS JOIN f0 GROUP BY ALL) GROUP BY pool"))

CELLS = "cc AS (SELECT p.pool, p.n, r.pos, l.label, count(x.label) AS c FROM pools p CROSS JOIN (SELECT unnest(range(1, 6)) AS pos) r CROSS JOIN lab l LEFT JOIN x ON x.pool = p.pool AND x.pos = r.pos AND x.label = l.label GROUP BY ALL)"
omni = lambda h: positional.omnibus(h, MATRIX)
MAXZ = f", {CELLS} SELECT pool, round(max(abs(c - n / 47) / sqrt(n / 47 * (1 - {1 / 47}))), 6) AS value FROM cc GROUP BY pool"
per_pool("p3s011", omni, MAXZ, "max_z")
CAT = "cats AS (SELECT pool, machine, count(*)::DOUBLE AS n FROM h GROUP BY ALL)"
per_pool("p3s012", lambda h: secondary.category_chi2(h, MATRIX, "machine"), f", {CAT}, cl AS (SELECT p.pool, p.n, p.machine, l.label, count(x.label) AS c FROM cats p CROSS JOIN lab l LEFT JOIN x ON x.pool = p.pool AND x.machine = p.machine AND x.label = l.label GROUP BY ALL) SELECT pool, round(sum((c - n * {P}) ** 2 / (n * {P})), 6) AS value FROM cl GROUP BY pool")

# ------------------------------------------------------------------ positional statistics
per_pool("p3b_s001", omni, f", {CELLS} SELECT pool, round(sum((c - n / 47) ** 2 / (n / 47)), 6) AS value FROM cc GROUP BY pool", "chi2")
per_pool("p3b_s002", omni, MAXZ, "max_z")
per_pool("p3b_s003", lambda h: positional.position_discrepancy(h, MATRIX), f", {CELLS}, cm AS (SELECT pool, pos, label, n, sum(c) OVER (PARTITION BY pool, pos ORDER BY label) AS cum FROM cc), t AS (SELECT pool, pos, sum((cum / n - label / 47.0::DOUBLE) ** 2 / 47) AS t FROM cm GROUP BY pool, pos) SELECT pool, round(max(t), 6) AS value FROM t GROUP BY pool")
ADJ = "aj AS (SELECT a.pool, a.pos AS j, a.label AS a, b.label AS b, count(*) AS c FROM x a JOIN x b ON a.draw_id = b.draw_id AND b.pos = a.pos + 1 GROUP BY ALL)"
per_pool("p3b_s004", lambda h: positional.transitions(h, MATRIX), f", {ADJ}, cells AS (SELECT p.pool, p.n / (47 * 46) AS e, coalesce(aj.c, 0) AS c FROM pools p CROSS JOIN (SELECT unnest(range(1, 5)) AS j) r CROSS JOIN lab l1 CROSS JOIN (SELECT label AS l2 FROM lab) l2 LEFT JOIN aj ON aj.pool = p.pool AND aj.j = r.j AND aj.a = l1.label AND aj.b = l2) SELECT pool, round(sum((c - e) ** 2 / e), 6) AS value FROM cells GROUP BY pool")
per_pool("p3b_s005", lambda h: positional.pair_residual(h, MATRIX), f", pp AS (SELECT a.pool, count(*) AS c FROM x a JOIN x b ON a.draw_id = b.draw_id AND a.pos <> b.pos GROUP BY a.pool, a.pos, b.pos, a.label, b.label) SELECT p.pool, round(greatest(max(abs(c - n / (47 * 46))), any_value(n) / (47 * 46)) / sqrt(any_value(n) / (47 * 46) * (1 - {1 / (47 * 46)})), 6) AS value FROM pp JOIN pools p ON p.pool = pp.pool GROUP BY p.pool")
per_pool("p3b_s006", lambda h: positional.information(h, MATRIX), f", {ADJ}, mi AS (SELECT *, sum(c) OVER (PARTITION BY pool, j, a) AS ca, sum(c) OVER (PARTITION BY pool, j, b) AS cb, sum(c) OVER (PARTITION BY pool, j) AS t FROM aj), bits AS (SELECT pool, j, sum(c / t::DOUBLE * log2(c::DOUBLE * t / (ca::DOUBLE * cb))) AS bits FROM mi GROUP BY pool, j) SELECT pool, round(max(bits), 6) AS value FROM bits GROUP BY pool")


def _serial(lags: str, where: str) -> str:
    return f", {PAIRED}, q AS (SELECT pool, lag, j, k, count(*) AS n, count(*) FILTER (prev[j] = cur[k]) AS hits FROM lg, range(1, 6) a(j), range(1, 6) b(k) WHERE lag IN ({lags}) AND {where} GROUP BY ALL) SELECT p.pool, round(coalesce(max(abs(hits - q.n * {1 / 47}) / sqrt(q.n * {1 / 47} * (1 - {1 / 47}))), 0), 6) AS value FROM pools p LEFT JOIN q ON q.pool = p.pool GROUP BY p.pool"


per_pool("p3b_s007", lambda h: positional.max_serial(h, MATRIX, LAGS, False), _serial("1, 2, 3, 4, 5", "j = k"))
per_pool("p3b_s008", lambda h: positional.max_serial(h, MATRIX, [1, 2, 3], True), _serial("1, 2, 3", "true"))
per_pool("p3b_s009", lambda h: positional.rolling(h, MATRIX, WINDOWS), _rolling_cases("grid AS (SELECT h.pool, h.seg, h.seg_len, h.idx, l.label, r.pos, h.numbers[r.pos] = l.label AS hit FROM h CROSS JOIN lab l CROSS JOIN (SELECT unnest(range(1, 6)) AS pos) r)", 1 / 47))
ROLL = " UNION ALL ".join(f"SELECT pool, seg, pos, label, idx, {w} AS w, sum(hit::INT) OVER (PARTITION BY pool, seg, label, pos ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS c FROM grid WHERE seg_len >= {w}" for w in WINDOWS)


@query("rolling_argmax", sql(f", grid AS (SELECT h.pool, h.seg, h.seg_len, h.idx, l.label, r.pos, h.numbers[r.pos] = l.label AS hit FROM h CROSS JOIN lab l CROSS JOIN (SELECT unnest(range(1, 6)) AS pos) r), roll AS ({ROLL}), zs AS (SELECT *, abs(c - w * {1 / 47}) / sqrt(w * {1 / 47} * (1 - {1 / 47})) AS z FROM roll WHERE idx >= w) SELECT pool, seg::BIGINT AS seg, pos::INT AS pos, w::INT AS w, (idx - w + 1)::BIGINT AS start, label::BIGINT AS label, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY pool, seg, pos, w ORDER BY round(z, 9) DESC, idx, label) AS r FROM zs) WHERE r = 1"))
def rolling_argmax(spark, sf_dir):
    return positional.rolling_argmax(views.history(spark, sf_dir), MATRIX, WINDOWS).select("pool", "seg", F.col("pos").cast("int").alias("pos"), F.col("w").cast("int").alias("w"), "start", F.col("label").cast("long").alias("label"), F.round("z", 6).alias("z"))


per_pool("p3b_s010", lambda h: positional.omnibus(h, MATRIX, ("machine",)), f", {CAT}, cl AS (SELECT p.pool, p.n, p.machine, r.pos, l.label, count(x.label) AS c FROM cats p CROSS JOIN (SELECT unnest(range(1, 6)) AS pos) r CROSS JOIN lab l LEFT JOIN x ON x.pool = p.pool AND x.machine = p.machine AND x.pos = r.pos AND x.label = l.label GROUP BY ALL) SELECT pool, round(sum((c - n / 47) ** 2 / (n / 47)), 6) AS value FROM cl GROUP BY pool", "chi2")


# ------------------------------------------------------------------ diagnostics
@query("number_freq_diag", sql(f", {COUNTS} SELECT pool, label::BIGINT AS label, c::BIGINT AS c, round((c - n * {P}) / sqrt(n * {P} * (1 - {P})), 6) AS z FROM c"))
def number_freq_diag(spark, sf_dir):
    z = (F.col("c") - F.col("n").cast("double") * P) / F.sqrt(F.col("n").cast("double") * P * (1 - P))
    return primary.label_counts(views.eligible(spark, sf_dir), MATRIX).select("pool", F.col("label").cast("long").alias("label"), F.col("c").cast("long").alias("c"), F.round(z, 6).alias("z"))


@query("pair_counts", sql(f", {PAIRS} SELECT pool, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM pr"))
def pair_counts(spark, sf_dir):
    return primary.combinations(views.eligible(spark, sf_dir), 2, MATRIX).select("pool", F.col("labels")[0].cast("long").alias("a"), F.col("labels")[1].cast("long").alias("b"), F.col("c").cast("long").alias("c"))


@query("triple_argmax", sql(", tr AS (SELECT a.pool, a.label AS a, b.label AS b, d.label AS d, count(*) AS c FROM x a JOIN x b ON a.draw_id = b.draw_id AND a.label < b.label JOIN x d ON d.draw_id = b.draw_id AND b.label < d.label GROUP BY ALL), rk AS (SELECT *, rank() OVER (PARTITION BY pool ORDER BY c DESC) AS r FROM tr) SELECT pool, a::BIGINT AS a, b::BIGINT AS b, d::BIGINT AS d, c::BIGINT AS c FROM rk WHERE r = 1"))
def triple_argmax(spark, sf_dir):
    top = primary.top_combinations(views.eligible(spark, sf_dir), 3, MATRIX)
    return top.select("pool", *[F.col("labels")[i].cast("long").alias(n) for i, n in enumerate("abd")], F.col("c").cast("long").alias("c"))


@query("serial_diag", sql(f", {LAGZ} SELECT pool, lag::BIGINT AS lag, n_pairs::BIGINT AS n_pairs, total::BIGINT AS total, round(z, 6) AS z FROM z"))
def serial_diag(spark, sf_dir):
    return secondary.lag_scan(views.history(spark, sf_dir), MATRIX, LAGS).select("pool", F.col("lag").cast("long").alias("lag"), "n_pairs", "total", F.round("z", 6).alias("z"))


@query("terminal_by_label", sql(f", {TERMINAL} SELECT len.pool, lab.label::BIGINT AS label, (n - coalesce(seen_at, 0))::BIGINT AS drought FROM len CROSS JOIN lab LEFT JOIN seen ON seen.pool = len.pool AND seen.label = lab.label"))
def terminal_by_label(spark, sf_dir):
    return secondary.terminal_by_label(views.history(spark, sf_dir), MATRIX).withColumn("label", F.col("label").cast("long"))


@query("position_residuals", sql(f", {CELLS} SELECT pool, pos::BIGINT AS pos, label::BIGINT AS label, round((c - n / 47) / sqrt(n / 47 * (1 - {1 / 47})), 6) AS z FROM cc"))
def position_residuals(spark, sf_dir):
    n = F.col("n").cast("double")
    return positional.cell_counts(views.eligible(spark, sf_dir), MATRIX).select("pool", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"), F.round((F.col("c") - n / 47) / F.sqrt(n / 47 * (1 - 1 / 47)), 6).alias("z"))


@query("spacings", sql(f", {STRUCT} SELECT draw_id, draw_sum, range, adjacent_pairs, min_spacing, max_spacing, odd_count, run_starts FROM st"))
def spacings(spark, sf_dir):
    return primary.structure(views.eligible(spark, sf_dir)).drop("pool")


@query("equipment_sufficiency", sql(", c AS (SELECT pool, machine, count(*) AS n FROM h GROUP BY ALL) SELECT pool, sum(n)::BIGINT AS n_populated, count(*)::BIGINT AS n_categories, count(*) FILTER (n >= 30)::BIGINT AS n_eligible, coalesce(sum(n) FILTER (n >= 30), 0)::BIGINT AS n_included, count(*) FILTER (n >= 30) >= 2 AND coalesce(sum(n) FILTER (n >= 30), 0) >= 100 AS sufficient FROM c GROUP BY pool"))
def equipment_sufficiency(spark, sf_dir):
    return secondary.sufficiency(views.eligible(spark, sf_dir), "machine", 2, 30, 100)


# ------------------------------------------------------------------ scans and rows
@query("scan_metadata_whitelist", sql(" SELECT draw_id, game_id, pool, eligible FROM draws"))
def scan_metadata_whitelist(spark, sf_dir):
    return views.draws(spark, sf_dir).select("draw_id", "game_id", "pool", "eligible")


@query("explode_numbers", sql(" SELECT draw_id, p::INT AS position, 'main' AS kind, n::BIGINT AS number FROM (SELECT draw_id, unnest(numbers) AS n, unnest(range(1, 6)) AS p FROM draws) UNION ALL SELECT draw_id, 6, 'special', special FROM draws"))
def explode_numbers(spark, sf_dir):
    return history.number_rows(views.draws(spark, sf_dir))


@query("manifest_counts", sql(" SELECT game_id, count(*)::BIGINT AS n, count(*) FILTER (eligible)::BIGINT AS n_eligible, min(t)::DATE::VARCHAR AS first_day, max(t)::DATE::VARCHAR AS last_day FROM draws GROUP BY game_id"))
def manifest_counts(spark, sf_dir):
    return views.draws(spark, sf_dir).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"), F.min("t").cast("date").cast("string").alias("first_day"), F.max("t").cast("date").cast("string").alias("last_day"))


@query("segments", sql(" SELECT DISTINCT pool, seg::BIGINT AS seg, seg_len::BIGINT AS seg_len FROM h"))
def segments(spark, sf_dir):
    return history.segments(views.history(spark, sf_dir)).select("pool", "seg", "seg_len")


@query("segment_lengths", sql(" SELECT pool, count(DISTINCT seg)::BIGINT AS n_segments, max(seg_len)::BIGINT AS longest, count(*)::BIGINT AS n_draws FROM h GROUP BY pool"))
def segment_lengths(spark, sf_dir):
    return history.segments(views.history(spark, sf_dir)).groupBy("pool").agg(F.count(F.lit(1)).alias("n_segments"), F.max("seg_len").alias("longest"), F.sum("seg_len").alias("n_draws"))


ORDERED = "ov AS (SELECT *, eligible AND machine <> 0 AS ok FROM draws), nv AS (SELECT *, row_number() OVER w AS rn, sum(ok::INT) OVER w AS el FROM ov WINDOW w AS (PARTITION BY pool ORDER BY t, draw_id))"


@query("order_segments", sql(f", {ORDERED} SELECT pool, min(rn)::BIGINT AS seg, count(*)::BIGINT AS seg_len FROM nv WHERE ok GROUP BY pool, rn - el"))
def order_segments(spark, sf_dir):
    """Segments of the draws whose physical order is known (here: of machines other than 0)."""
    known = views.draws(spark, sf_dir).withColumn("ok", F.col("eligible") & (F.col("machine") != 0))
    return history.segments(history.segmented(known, eligible="ok")).select("pool", "seg", "seg_len")


@query("duplicate_consecutive", sql(f", {PAIRED} SELECT p.pool, count(lg.pool)::BIGINT AS n_pairs, count(*) FILTER (list_sort(prev) = list_sort(cur))::BIGINT AS n_same FROM pools p LEFT JOIN lg ON lg.pool = p.pool AND lag = 1 GROUP BY p.pool"))
def duplicate_consecutive(spark, sf_dir):
    h = views.history(spark, sf_dir)
    both = history.lagged(h, [1], ["numbers"]).groupBy("pool").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.array_sort("numbers") == F.array_sort("prev_numbers")).alias("b"))
    return h.select("pool").distinct().join(both, "pool", "left").select("pool", F.coalesce("a", F.lit(0)).alias("n_pairs"), F.coalesce("b", F.lit(0)).alias("n_same"))


@query("order_audit", sql(", a AS (SELECT draw_id, game_id, machine, numbers = list_sort(numbers) AS up, date_trunc('day', t) AS d FROM draws), b AS (SELECT *, bool_and(up) OVER (PARTITION BY game_id, machine, d) AS every FROM a) SELECT draw_id, CASE WHEN every THEN 'sorted' WHEN up THEN 'unknown' ELSE 'physical' END AS claim FROM b"))
def order_audit(spark, sf_dir):
    d = views.draws(spark, sf_dir).withColumn("d", F.date_trunc("day", "t"))
    return regimes.order_audit(d, ["game_id", "machine"], "d").select("draw_id", "claim")


# ------------------------------------------------------------------ eras and schedules
ASSIGNED = f"""WITH {ERAS}, o AS (SELECT o_orderkey, o_orderpriority AS game, o_orderdate::DATE AS d FROM orders),
m AS (SELECT o.o_orderkey, o.d, min(e.era) AS era, min(e.pool) AS pool, count(e.era) AS n, coalesce(bool_or(o.d < e.clear_from), false) AS early
      FROM o LEFT JOIN eras e ON e.game = o.game AND o.d BETWEEN e.lo AND coalesce(e.hi, DATE '9999-12-31') GROUP BY ALL),
assigned AS (SELECT o_orderkey, d, CASE WHEN n = 0 THEN 'none' WHEN early THEN 'quarantined' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, era, pool FROM m)"""


@query("interval_join_regime", f"{ASSIGNED} SELECT o_orderkey, status, era, pool FROM assigned")
def interval_join_regime(spark, sf_dir):
    return regimes.assign(views.orders(spark, sf_dir), views.eras(spark)).select("o_orderkey", "status", "era", "pool")


@query("pool_guard", f"{ASSIGNED} SELECT pool, count(*)::BIGINT AS n, min(d)::VARCHAR AS first_day, max(d)::VARCHAR AS last_day FROM assigned WHERE status = 'ok' GROUP BY pool")
def pool_guard(spark, sf_dir):
    ok = regimes.require(regimes.assign(views.orders(spark, sf_dir), views.eras(spark)).where("status = 'ok'"))
    return ok.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day"))


@query("regime_integrity", f"""WITH {ERAS}, used AS (SELECT DISTINCT o_orderpriority AS game FROM orders), e AS (SELECT eras.*, lag(coalesce(hi, DATE '9999-12-31')) OVER (PARTITION BY game ORDER BY lo, era) AS before FROM eras JOIN used USING (game))
SELECT game, era, 'gap' AS problem FROM e WHERE lo > before + 1 UNION ALL SELECT game, era, 'overlap' FROM e WHERE lo <= before UNION ALL SELECT game, era, 'empty_quarantine' FROM e WHERE clear_from <= lo""")
def regime_integrity(spark, sf_dir):
    used = views.orders(spark, sf_dir).select("game").distinct()
    return regimes.integrity(views.eras(spark).join(used, "game", "left_semi"))


@query("schedule_missing", """WITH o AS (SELECT DISTINCT o_orderpriority AS game, o_orderstatus AS state_of, o_orderdate::DATE AS d FROM orders), b AS (SELECT game, state_of, min(d) AS lo, max(d) AS hi FROM o GROUP BY ALL),
w AS (SELECT game, state_of, d FROM (SELECT game, state_of, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM b) WHERE isodow(d) IN (1, 3, 6))
SELECT game, state_of, d::VARCHAR AS d, 'missing' AS state FROM w ANTI JOIN o USING (game, state_of, d) UNION ALL SELECT game, state_of, d::VARCHAR, 'extra' FROM o ANTI JOIN w USING (game, state_of, d)""")
def schedule_missing(spark, sf_dir):
    """Orders by priority and state as the observed draws of a calendar that they do not fill."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("game"), F.col("o_orderstatus").alias("state_of"), F.col("o_orderdate").cast("date").alias("d"))
    return regimes.schedule_audit(o.groupBy("game", "state_of").agg(F.min("d").alias("lo"), F.max("d").alias("hi")), o, [0, 2, 5]).withColumn("d", F.col("d").cast("string"))


BROKEN = """, b AS (SELECT draw_id, CASE WHEN special = 6 THEN NULL ELSE pool END AS pool,
    CASE WHEN machine = 2 AND special = 3 THEN numbers[1:4] WHEN special = 4 THEN list_concat(numbers[1:4], numbers[1:1]) WHEN special = 7 AND machine = 2 THEN numbers[1:0] ELSE numbers END AS n,
    CASE WHEN special = 5 THEN NULL ELSE special END AS s, machine = 1 AS q FROM draws),
v AS (SELECT *, list_filter([CASE WHEN pool IS NULL THEN 'no_regime' END, CASE WHEN len(n) <> 5 THEN 'wrong_count' END, CASE WHEN len(list_distinct(n)) <> len(n) THEN 'repeated_number' END,
    CASE WHEN len(list_filter(n, lambda x: x > 45)) > 0 THEN 'out_of_range' END, CASE WHEN s IS NULL THEN 'special_missing' END, CASE WHEN s > 14 THEN 'special_out_of_range' END], lambda r: r IS NOT NULL) AS r FROM b)"""


@query("validate_reasons", sql(f"{BROKEN} SELECT draw_id, array_to_string(list_sort(r), ';') AS reasons, CASE WHEN len(r) > 0 THEN 'REJECTED' WHEN q THEN 'QUARANTINED' ELSE 'VALID' END AS status FROM v"))
def validate_reasons(spark, sf_dir):
    """The draws against a tighter matrix, 1..45 and special 1..14, some with a label short or repeated, without special or
    pool, so that every rule fires; machine 1 is quarantined."""
    n, s, machine = F.col("numbers"), F.col("special"), F.col("machine")
    four = F.slice(n, 1, 4)
    broken = F.when((machine == 2) & (s == 3), four).when(s == 4, F.concat(four, F.slice(n, 1, 1))).when((s == 7) & (machine == 2), F.slice(n, 1, 0)).otherwise(n)
    d = views.draws(spark, sf_dir).select("draw_id", F.when(s != 6, F.col("pool")).alias("pool"), broken.alias("numbers"), F.when(s != 5, s).alias("special"), (machine == 1).alias("quarantined"))
    return reconcile.structural_reasons(d, 5, 1, 45, 14).select("draw_id", F.array_join(F.array_sort("reasons"), ";").alias("reasons"), "status")


# ------------------------------------------------------------------ reconciliation
_ranked = views.ranked


@query("precedence_primary", f"WITH {STAGED} SELECT key, source, tier, quantity FROM ranked WHERE rank = 1")
def precedence_primary(spark, sf_dir):
    return _ranked(spark, sf_dir).where("rank = 1").select("key", "source", "tier", "quantity")


@query("signature_dedupe", f"WITH {STAGED}, d AS (SELECT *, row_number() OVER (PARTITION BY key, source, l_returnflag ORDER BY tier, source, l_linenumber, l_partkey, quantity, l_extendedprice) AS n FROM staged) SELECT key, source, l_returnflag, l_partkey, quantity FROM d WHERE n = 1")
def signature_dedupe(spark, sf_dir):
    return reconcile.distinct_reports(views.staged(spark, sf_dir), ["key"], ["source", "l_returnflag"], ORDER).select("key", "source", "l_returnflag", "l_partkey", "quantity")


COMPARED = f"""WITH {STAGED}, pairs AS (SELECT b.key, b.rank, a.source AS source_a, b.source AS source_b, a.tier AS ta, b.tier AS tb, f.field, f.va, f.vb FROM ranked b JOIN ranked a ON a.key = b.key AND a.rank = 1 AND b.rank > 1,
    LATERAL (VALUES ('quantity', a.quantity, b.quantity), ('discount', a.discount, b.discount), ('tax', a.tax, b.tax)) f(field, va, vb)),
cls AS (SELECT *, CASE WHEN va IS NULL AND vb IS NULL THEN 'MATCH' WHEN va IS NULL OR vb IS NULL THEN 'FIELD_COMPLEMENT' WHEN va = vb THEN 'MATCH' ELSE 'CONFLICT' END AS class FROM pairs),
st AS (SELECT *, CASE WHEN class = 'CONFLICT' AND NOT (ta <= 2 AND tb >= 3) THEN 'unresolved' ELSE 'resolved' END AS status FROM cls)"""
FIELDS = ["quantity", "discount", "tax"]


@query("reconcile_classify", f"{COMPARED} SELECT key, rank, source_a, source_b, field, class, status FROM st WHERE class <> 'MATCH' OR field = 'quantity'")
def reconcile_classify(spark, sf_dir):
    return reconcile.compare(_ranked(spark, sf_dir), ["key"], FIELDS).select("key", "rank", "source_a", "source_b", "field", "class", "status")


@query("resolution_apply", f"{COMPARED}, led AS (SELECT o_orderkey AS key, 'quantity' AS field FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus <> 'P') SELECT st.key, st.rank, st.field, CASE WHEN class = 'CONFLICT' AND led.key IS NOT NULL THEN 'resolved' ELSE status END AS status, class = 'CONFLICT' AND led.key IS NOT NULL AS by_ledger FROM st LEFT JOIN led ON led.key = st.key AND led.field = st.field WHERE class <> 'MATCH' OR st.field = 'quantity'")
def resolution_apply(spark, sf_dir):
    """A ledger of every seventh order's quantity; entries of orders in state P are not resolved yet."""
    ledger = views.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key"), F.lit("quantity").alias("field"), F.lit("1").alias("resolved_value"), F.when(F.col("o_orderstatus") != "P", "resolved").otherwise("open").alias("status"))
    rows = reconcile.ranked(reconcile.dealt(views.staged(spark, sf_dir), ["key"]), ["key"], ORDER)
    out = reconcile.resolve(reconcile.compare(rows, ["key"], FIELDS), ledger, ["key"])
    return out.select("key", "rank", "field", "status", ((F.col("class") == "CONFLICT") & F.col("resolved_value").isNotNull()).alias("by_ledger"))


@query("field_coalesce", f"WITH {STAGED} SELECT key, arg_min(quantity, rank) AS quantity, arg_min(discount, rank) FILTER (discount IS NOT NULL) AS discount, arg_min(tax, rank) FILTER (tax IS NOT NULL) AS tax FROM ranked GROUP BY key")
def field_coalesce(spark, sf_dir):
    return reconcile.filled(_ranked(spark, sf_dir), ["key"], FIELDS)


@query("sequence_source", f"WITH {STAGED}, p AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pref FROM ranked WHERE rank = 1 OR tier <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pref, rank) AS n FROM p) SELECT key, source, l_returnflag FROM b WHERE n = 1")
def sequence_source(spark, sf_dir):
    pref = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return reconcile.sequence_source(_ranked(spark, sf_dir), ["key"], pref, ["source", "l_returnflag"])


CANON = f"""{COMPARED}, dis AS (SELECT key, field, bool_or(va IS DISTINCT FROM vb AND (ta > 2 OR tb <= 2)) AS c FROM pairs GROUP BY key, field),
fill AS (SELECT key, arg_min(source, rank) AS source, min(tier) FILTER (rank = 1) AS tier, arg_min(quantity, rank) AS quantity, arg_min(discount, rank) FILTER (discount IS NOT NULL) AS discount, arg_min(tax, rank) FILTER (tax IS NOT NULL) AS tax, (count(*) - 1)::BIGINT AS n_corroborating FROM ranked GROUP BY key),
canon AS (SELECT fill.*, coalesce(q.c, false) AS conflict_quantity, coalesce(d.c, false) AS conflict_discount, coalesce(t.c, false) AS conflict_tax FROM fill LEFT JOIN dis q ON q.key = fill.key AND q.field = 'quantity' LEFT JOIN dis d ON d.key = fill.key AND d.field = 'discount' LEFT JOIN dis t ON t.key = fill.key AND t.field = 'tax')"""


@query("canonical_build", f"{CANON} SELECT * FROM canon")
def canonical_build(spark, sf_dir):
    return reconcile.canonical(_ranked(spark, sf_dir), ["key"], FIELDS)


@query("eligibility_reasons", f"{CANON}, ex AS (SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 450000), e AS (SELECT canon.key, list_filter([CASE WHEN ex.key IS NOT NULL THEN 'excluded' END, CASE WHEN tier > 2 THEN 'unofficial_source_only' END, CASE WHEN conflict_quantity THEN 'unresolved_conflict' END, CASE WHEN n_corroborating = 0 THEN 'provisional_source' END], lambda r: r IS NOT NULL) AS r FROM canon LEFT JOIN ex ON ex.key = canon.key) SELECT key, array_to_string(r, ';') AS reasons, len(r) = 0 AS eligible FROM e")
def eligibility_reasons(spark, sf_dir):
    excluded = views.table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("key"), F.lit("excluded").alias("decision"))
    rules = [("unofficial_source_only", F.col("tier") > 2), ("unresolved_conflict", F.col("conflict_quantity")), ("provisional_source", F.col("n_corroborating") == 0)]
    out = reconcile.eligibility(reconcile.canonical(_ranked(spark, sf_dir), ["key"], FIELDS), excluded, "key", rules)
    return out.select("key", F.array_join("reasons", ";").alias("reasons"), "eligible")


@query("tier_left_default", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s.tier, 3)::INT AS tier FROM lineitem LEFT JOIN (SELECT s_suppkey, (1 + s_nationkey % 2)::INT AS tier FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = l_suppkey")
def tier_left_default(spark, sf_dir):
    tiers = views.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source"), (1 + F.col("s_nationkey") % 2).cast("int").alias("tier"))
    x = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("source"))
    return reconcile.with_tier(x, tiers).select("l_orderkey", "l_linenumber", "l_partkey", F.col("source").alias("l_suppkey"), "tier")


@query("semi_exclusion", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_exclusion(spark, sf_dir):
    bad = views.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return views.table(spark, sf_dir, "orders").join(bad, "o_custkey", "left_semi").select("o_orderkey")


@query("anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


# ------------------------------------------------------------------ splits and set operations
SPLIT = "sp AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), split AS (SELECT *, CASE WHEN r <= n - ceil(0.2::DOUBLE * n) THEN 'exploration' ELSE 'holdout' END AS split FROM sp)"


def _split(spark, sf_dir):
    return splits.chronological(views.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey")


@query("chrono_split", f"WITH {SPLIT} SELECT o_orderkey, split FROM split")
def chrono_split(spark, sf_dir):
    return _split(spark, sf_dir).select("o_orderkey", "split")


@query("split_summary", f"WITH {SPLIT} SELECT o_orderpriority, count(*) FILTER (split = 'exploration')::BIGINT AS n_exploration, count(*) FILTER (split = 'holdout')::BIGINT AS n_holdout, (max(o_orderdate) FILTER (split = 'exploration'))::DATE::VARCHAR AS last_exploration, (min(o_orderdate) FILTER (split = 'holdout'))::DATE::VARCHAR AS first_holdout FROM split GROUP BY ALL")
def split_summary(spark, sf_dir):
    out = splits.summary(_split(spark, sf_dir), "o_orderpriority", "o_orderdate")
    return out.withColumns({c: F.col(c).cast("date").cast("string") for c in ("last_exploration", "first_holdout")})


@query("corrected_split", f"WITH {SPLIT} SELECT o_orderkey, split, CASE WHEN o_orderkey % 11 = 0 THEN 'invalidated' ELSE 'kept' END AS state FROM split")
def corrected_split(spark, sf_dir):
    return splits.corrected(_split(spark, sf_dir), views.table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0"), "o_orderkey").select("o_orderkey", "split", "state")


@query("id_set_intersect", sql(" SELECT draw_id FROM draws WHERE eligible INTERSECT SELECT draw_id FROM draws WHERE special > 7"))
def id_set_intersect(spark, sf_dir):
    d = views.draws(spark, sf_dir)
    return d.where("eligible").select("draw_id").intersect(d.where("special > 7").select("draw_id"))


@query("id_set_except", sql(" SELECT draw_id FROM draws WHERE eligible EXCEPT SELECT draw_id FROM draws WHERE special > 7"))
def id_set_except(spark, sf_dir):
    d = views.draws(spark, sf_dir)
    return d.where("eligible").select("draw_id").subtract(d.where("special > 7").select("draw_id"))


@query("union_streams", sql(" SELECT draw_id, 'main' AS stream, special FROM draws WHERE machine = 0 UNION ALL SELECT draw_id, 'second', special FROM draws WHERE machine <> 0"))
def union_streams(spark, sf_dir):
    d = views.draws(spark, sf_dir)
    part = lambda cond, name: d.where(cond).select("draw_id", F.lit(name).alias("stream"), "special")
    return part("machine = 0", "main").unionByName(part("machine <> 0", "second"))


@query("grouping_sets_summary", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(sum(l_quantity), 6) AS total, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS se, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci_low FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), (l_returnflag, l_linenumber))")
def grouping_sets_summary(spark, sf_dir):
    x, q = views.table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    sets = [[F.col("l_returnflag")], [F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag"), F.col("l_linenumber")]]
    se = F.stddev_samp(q) / F.sqrt(F.count(q).cast("double"))
    return x.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(q).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.percentile(q, 0.5), 6).alias("median"), F.round(F.sum(q), 6).alias("total"), F.round(se, 6).alias("se"), F.round(F.avg(q) - 1.96 * se, 6).alias("ci_low"))


# ------------------------------------------------------------------ inference
TESTS = "t AS (SELECT l_returnflag AS family, l_partkey AS test, (((1 + sum(l_linenumber)) % 997 + 1) / 1000.0::DOUBLE) ** 4 AS p, (sum(l_linenumber) % 80) / 10.0::DOUBLE - 4 AS z, sum(l_linenumber) % 3 <> 0 AS converged FROM lineitem GROUP BY ALL)"


def _tests(spark, sf_dir):
    """A derived family of tests: one p-value for each flag and part."""
    x = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("test")).agg(F.sum("l_linenumber").alias("s"))
    return x.select("family", "test", F.pow(((1 + F.col("s")) % 997 + 1) / F.lit(1000.0), F.lit(4)).alias("p"), ((F.col("s") % 80) / F.lit(10.0) - 4).alias("z"), (F.col("s") % 3 != 0).alias("converged"))


RANKS = f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r, count(*) OVER (PARTITION BY family) AS m FROM t)"
BH = f"{RANKS}, b AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC)) AS q, coalesce(max(CASE WHEN p <= r * 0.05::DOUBLE / m THEN r END) OVER (PARTITION BY family), 0) AS k FROM r)"


@query("bh_adjust", f"{BH} SELECT family, test, round(p, 6) AS p, round(q, 6) AS bh_q, r <= k AS bh_reject FROM b")
def bh_adjust(spark, sf_dir):
    return inference.adjust(_tests(spark, sf_dir), ["family"], "p", ["test"]).select("family", "test", F.round("p", 6).alias("p"), F.round("bh_q", 6).alias("bh_q"), "bh_reject")


@query("holm_adjust", f"{RANKS}, b AS (SELECT *, least(1, max(p * (m - r + 1)) OVER (PARTITION BY family ORDER BY r)) AS q, min(CASE WHEN p > 0.05::DOUBLE / (m - r + 1) THEN r END) OVER (PARTITION BY family) AS k FROM r) SELECT family, test, round(q, 6) AS holm_p, coalesce(r < k, true) AS holm_reject FROM b")
def holm_adjust(spark, sf_dir):
    return inference.adjust(_tests(spark, sf_dir), ["family"], "p", ["test"]).select("family", "test", F.round("holm_p", 6).alias("holm_p"), "holm_reject")


@query("promotion", f"{BH} SELECT family, test, round(z, 6) AS z FROM b WHERE r <= k AND abs(z) >= 2.5 AND converged")
def promotion(spark, sf_dir):
    return inference.promote(inference.adjust(_tests(spark, sf_dir), ["family"], "p", ["test"]), converged="converged").select("family", "test", F.round("z", 6).alias("z"))


@query("mc_pvalue", "WITH o AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) + 10 AS observed FROM lineitem GROUP BY ALL), j AS (SELECT o.l_returnflag, o.l_linestatus, count(*) AS n, count(*) FILTER (l_quantity >= observed) AS up, count(*) FILTER (l_quantity <= observed) AS down FROM o JOIN lineitem x ON x.l_returnflag = o.l_returnflag AND x.l_linestatus = o.l_linestatus GROUP BY ALL) SELECT l_returnflag, l_linestatus, 'upper' AS tail, round((up + 1) / (n + 1)::DOUBLE, 6) AS p FROM j UNION ALL SELECT l_returnflag, l_linestatus, 'lower', round((down + 1) / (n + 1)::DOUBLE, 6) FROM j UNION ALL SELECT l_returnflag, l_linestatus, 'two-sided', round((least(2 * least(up, down), n) + 1) / (n + 1)::DOUBLE, 6) FROM j")
def mc_pvalue(spark, sf_dir):
    x, key = views.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    observed = cut(x.groupBy(*key).agg((F.avg("l_quantity") + 10).alias("observed")), "observed")
    nulls = x.select(*key, F.col("l_quantity").alias("value"))
    parts = [inference.mc_pvalue(nulls, observed, key, tail).select(*key, F.lit(tail).alias("tail"), F.round("p", 6).alias("p")) for tail in ("upper", "lower", "two-sided")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("convergence_check", """WITH v AS (SELECT l_returnflag, l_linenumber % 4 AS batch, l_extendedprice AS value FROM lineitem),
p AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(value) AS mean, var_pop(value) AS var, stddev_samp(value) AS sd, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM v GROUP BY ALL),
m AS (SELECT v.l_returnflag, avg((value - mean) ** 4) AS mu4 FROM v JOIN p USING (l_returnflag) GROUP BY ALL),
b AS (SELECT v.l_returnflag, batch, avg(value) AS bm, var_pop(value) AS bv, avg((value <= q90)::INT) AS a1, avg((value < q90)::INT) AS a2, avg((value <= q95)::INT) AS b1, avg((value < q95)::INT) AS b2, avg((value <= q99)::INT) AS c1, avg((value < q99)::INT) AS c2 FROM v JOIN p USING (l_returnflag) GROUP BY ALL),
j AS (SELECT * FROM b JOIN p USING (l_returnflag) JOIN m USING (l_returnflag))
SELECT l_returnflag, 'mean' AS metric, round(any_value(mean), 4) AS pooled, bool_and(abs(bm - mean) <= 4 * sqrt(3) * sd / sqrt(n)) AS passed FROM j GROUP BY ALL
UNION ALL SELECT l_returnflag, 'var', round(any_value(var) / 1e6, 4), bool_and(abs(bv - var) <= 4 * sqrt(3) * sqrt(greatest(mu4 - var * var, 0)) / sqrt(n)) FROM j GROUP BY ALL
UNION ALL SELECT l_returnflag, 'q90', round(any_value(q90), 4), bool_and(a1 >= 0.9 - 4 * sqrt(3 * 0.09 / n) AND a2 <= 0.9 + 4 * sqrt(3 * 0.09 / n)) FROM j GROUP BY ALL
UNION ALL SELECT l_returnflag, 'q95', round(any_value(q95), 4), bool_and(b1 >= 0.95 - 4 * sqrt(3 * 0.0475 / n) AND b2 <= 0.95 + 4 * sqrt(3 * 0.0475 / n)) FROM j GROUP BY ALL
UNION ALL SELECT l_returnflag, 'q99', round(any_value(q99), 4), bool_and(c1 >= 0.99 - 4 * sqrt(3 * 0.0099 / n) AND c2 <= 0.99 + 4 * sqrt(3 * 0.0099 / n)) FROM j GROUP BY ALL""")
def convergence_check(spark, sf_dir):
    v = views.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 4).alias("batch"), F.col("l_extendedprice").alias("value"))
    pooled = F.when(F.col("metric") == "var", F.col("pooled") / 1e6).otherwise(F.col("pooled"))
    return inference.convergence(v, ["l_returnflag"]).select("l_returnflag", "metric", F.round(pooled, 4).alias("pooled"), "passed")
