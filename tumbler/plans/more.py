"""Queries over payloads, exact distributions, models and audits; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tumbler.functions import exact
from tumbler.operators import audit, inference, models, primary
from tumbler.plans import views
from tumbler.plans.catalog import STRUCT, P, query
from tumbler.plans.views import MATRIX, sql
from tumbler.scratch import cut
from tumbler.sources import payloads, store

#: Permutations of a test; p is at least 1 / (PERMUTATIONS + 1).
PERMUTATIONS = 99


# ------------------------------------------------------------------ payloads
@query("json_props_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props_extract(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("json_array_draws", "WITH e AS (SELECT event_id, ts, 1 + event_id % 40 AS a, 1 + user_id % 40 AS b, 1 + event_id % 9 AS s FROM events) SELECT ts::DATE::VARCHAR AS d, 'main' AS stream, a || ' ' || b AS numbers, s::INT AS special FROM e UNION ALL SELECT ts::DATE::VARCHAR, 'second', b::VARCHAR, a::INT FROM e WHERE event_id % 3 = 0")
def json_array_draws(spark, sf_dir):
    """Each event as a payload: a JSON array with one object, a second stream on every third."""
    a, b, s = F.expr("1 + event_id % 40"), F.expr("1 + user_id % 40"), F.expr("1 + event_id % 9")
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("day"), F.concat_ws(" ", a, b).alias("winning"), s.cast("string").alias("bonus"), F.when(F.col("event_id") % 3 == 0, F.concat_ws(" ", b, a)).alias("again"))
    content = views.table(spark, sf_dir, "events").select(F.to_json(F.array(item)).alias("content"))
    out = payloads.json_draws(content, "day", "winning", "bonus", "again")
    return out.select(F.col("d").cast("string").alias("d"), "stream", F.array_join(F.col("numbers").cast("array<string>"), " ").alias("numbers"), "special")


@query("html_regex_rows", r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def html_regex_rows(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("long").alias("n_links"))


@query("html_draw_blocks", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d, (1 + o_orderkey % 50) || '-' || (1 + o_custkey % 50) AS numbers FROM orders WHERE o_orderkey % 5 <> 0")
def html_draw_blocks(spark, sf_dir):
    """Orders as blocks of an archive page; every fifth has a number too few and is dropped."""
    o = views.table(spark, sf_dir, "orders")
    ball = lambda x: F.concat(F.lit("<i>"), x.cast("string"), F.lit("</i>"))
    second = F.when(F.col("o_orderkey") % 5 != 0, ball(F.expr("1 + o_custkey % 50"))).otherwise("")
    block = F.concat(F.lit("<tr><td>"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("</td>"), ball(F.expr("1 + o_orderkey % 50")), second, F.lit("<b>"), F.col("o_orderkey").cast("string"), F.lit("</b></tr>"))
    out = payloads.html_draws(o.select(block.alias("content")), "<tr>.*?</tr>", r"<td>([0-9/]+)</td>", "MM/dd/yyyy", r"<i>(\d+)</i>", 2, r"<b>(\d+)</b>")
    return out.select(F.col("special").cast("long").alias("o_orderkey"), F.col("d").cast("string").alias("d"), F.array_join(F.col("numbers").cast("array<string>"), "-").alias("numbers"))


@query("tagged_line_parse", "SELECT o_orderdate::DATE::VARCHAR AS d, (1 + o_orderkey % 50) || '-' || (1 + o_custkey % 50) AS numbers, CASE o_orderstatus WHEN 'F' THEN 'special' ELSE 'plain' END AS form FROM orders WHERE o_orderstatus <> 'P'")
def tagged_line_parse(spark, sf_dir):
    """Orders as lines M/D/YY a - b TAG; orders in state P have a tag that no form knows."""
    o = views.table(spark, sf_dir, "orders")
    tag = F.when(F.col("o_orderstatus") == "F", F.lit("PB 7")).when(F.col("o_orderstatus") == "P", "???").otherwise("")
    line = F.concat(F.date_format("o_orderdate", "M/d/yy"), F.lit("  "), F.expr("1 + o_orderkey % 50").cast("string"), F.lit(" - "), F.expr("1 + o_custkey % 50").cast("string"), F.lit(" "), tag)
    out = payloads.tagged_lines(o.select(line.alias("content")), [("special", r"^PB \d+$"), ("plain", "^$")])
    return out.select(F.col("d").cast("string").alias("d"), F.array_join(F.col("numbers").cast("array<string>"), "-").alias("numbers"), "form")


@query("positional_csv_parse", "SELECT o_orderpriority AS game, o_orderdate::DATE::VARCHAR AS d, (1 + o_orderkey % 50) || '-' || (1 + o_custkey % 50) AS numbers, (o_orderkey % 9)::INT AS special FROM orders WHERE o_orderkey % 4 <> 0")
def positional_csv_parse(spark, sf_dir):
    """Orders as lines game,MM,DD,YYYY,a,b,special,multiplier; every fourth has an unreadable number."""
    o = views.table(spark, sf_dir, "orders")
    bad = F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).otherwise(F.expr("1 + o_custkey % 50").cast("string"))
    line = F.concat_ws(",", "o_orderpriority", F.date_format("o_orderdate", "M,d,yyyy"), F.expr("1 + o_orderkey % 50").cast("string"), bad, F.expr("o_orderkey % 9").cast("string"), F.lit("2"))
    out = payloads.positional_csv_draws(o.select(line.alias("content")), 2)
    return out.select("game", F.col("d").cast("string").alias("d"), F.array_join(F.col("numbers").cast("array<string>"), "-").alias("numbers"), "special")


@query("dated_csv_parse", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d, (2 + o_orderkey % 4)::INT AS multiplier, floor(o_totalprice)::BIGINT * 10000 AS jackpot FROM orders")
def dated_csv_parse(spark, sf_dir):
    """Orders as lines date,number,special,'3x','$1.23M'; the special field carries the order's key."""
    o = views.table(spark, sf_dir, "orders")
    cents = F.floor("o_totalprice").cast("long")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("7"), F.col("o_orderkey").cast("string"), F.concat(F.expr("2 + o_orderkey % 4").cast("string"), F.lit("x")), F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("M")))
    out = payloads.dated_csv_draws(o.select(line.alias("content")), 1)
    return out.select(F.col("special").cast("long").alias("o_orderkey"), F.col("d").cast("string").alias("d"), "multiplier", F.col("jackpot").cast("long").alias("jackpot"))


@query("content_hash_dedupe", "SELECT source, sha256(text) AS sha256, min(doc_id) AS first_id, count(*)::BIGINT AS n_retrievals FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING min(doc_id) % 7 <> 0 OR count(*) > 1")
def content_hash_dedupe(spark, sf_dir):
    """First retrieval of each content by source; contents seen once under an id divisible by 7 are in the store already."""
    d = store.hashed(views.table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text").select("source", "sha256", F.col("doc_id").alias("retrieved_at"))
    known = d.groupBy("source", "sha256").agg(F.count(F.lit(1)).alias("n"), F.min("retrieved_at").alias("first")).where("n = 1 AND first % 7 = 0")
    return store.new_contents(d, known).withColumnRenamed("retrieved_at", "first_id")


# ------------------------------------------------------------------ exact distributions against the tables
_PMF = ", ".join(f"('{q}', {x}, {p!r}::DOUBLE)" for q, pmf in (("draw_sum", exact.sum_pmf(MATRIX)), ("range", exact.range_pmf(MATRIX)), ("odd_count", exact.odd_pmf(MATRIX))) for x, p in pmf.items())


@query("exact_pmfs", sql(f", {STRUCT}, ref(quantity, x, p) AS (VALUES {_PMF}), v AS (SELECT pool, unnest(['draw_sum', 'range', 'odd_count']) AS quantity, unnest([draw_sum, range, odd_count]) AS x FROM st), c AS (SELECT pool, quantity, x, count(*) AS c FROM v GROUP BY ALL) SELECT p.pool, ref.quantity, ref.x::BIGINT AS x, coalesce(c.c, 0)::BIGINT AS observed, round(p.n * ref.p, 6) AS expected FROM pools p CROSS JOIN ref LEFT JOIN c ON c.pool = p.pool AND c.quantity = ref.quantity AND c.x = ref.x"))
def exact_pmfs(spark, sf_dir):
    """Observed counts of each structural quantity beside the exact expectation, over the whole support."""
    kinds = ["draw_sum", "range", "odd_count"]
    s = primary.structure(views.eligible(spark, sf_dir))
    v = s.select("pool", F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias("x")) for q in kinds])).alias("v")).select("pool", "v.*")
    counts = v.groupBy("pool", "quantity", "x").agg(F.count(F.lit(1)).alias("c"))
    n = v.groupBy("pool", "quantity").agg(F.count(F.lit(1)).alias("n"))
    cells = n.join(F.broadcast(exact.pmf_table(spark, MATRIX)), "quantity").join(counts, ["pool", "quantity", "x"], "left")
    return cells.select("pool", "quantity", "x", F.coalesce("c", F.lit(0)).alias("observed"), F.round(F.col("n") * F.col("p"), 6).alias("expected"))


# ------------------------------------------------------------------ models
PRIOR = "o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t, draw_id) AS k FROM h), gr AS (SELECT o.pool, o.draw_id, o.k, lab.label, list_contains(o.numbers, lab.label)::INT AS hit FROM o CROSS JOIN lab), f AS (SELECT pool, draw_id, label, hit, (k - 1)::BIGINT AS n, coalesce(sum(hit) OVER w, 0)::BIGINT AS c, (k - 1 - coalesce(max(CASE WHEN hit = 1 THEN k END) OVER w, 0))::BIGINT AS gap, coalesce(sum(hit * pow(2.0::DOUBLE, k / 50.0::DOUBLE)) OVER w, 0) * pow(2.0::DOUBLE, -(k - 1) / 50.0::DOUBLE) AS decayed, coalesce(lag(hit) OVER (PARTITION BY pool, label ORDER BY k), 0) = 1 AS prev FROM gr WINDOW w AS (PARTITION BY pool, label ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("expanding_features", sql(f", {PRIOR} SELECT pool, draw_id, label::BIGINT AS label, n, c, round(decayed, 6) AS decayed, gap, prev FROM f"))
def expanding_features(spark, sf_dir):
    return models.features(views.history(spark, sf_dir), MATRIX).select("pool", "draw_id", F.col("label").cast("long").alias("label"), "n", "c", F.round("decayed", 6).alias("decayed"), "gap", "prev")


HITS = ", r AS (SELECT *, row_number() OVER (PARTITION BY pool, draw_id ORDER BY c DESC, label) AS r FROM f WHERE n >= 100), ph AS (SELECT pool, draw_id, sum(hit) FILTER (r <= 10)::BIGINT AS hits10, sum(hit) FILTER (r <= 15)::BIGINT AS hits15, sum(hit) FILTER (r <= 20)::BIGINT AS hits20 FROM r GROUP BY pool, draw_id)"
SCORED = f""", w AS (SELECT pool, draw_id, hit, 'frequency' AS model, (c + 100 * {P}::DOUBLE) / (n + 100) / {P}::DOUBLE AS w FROM f WHERE n >= 100 UNION ALL
    SELECT pool, draw_id, hit, 'decayed', (decayed + 25 * {P}::DOUBLE) / ((1 - pow({0.5 ** (1 / 50)!r}::DOUBLE, n)) / (1 - {0.5 ** (1 / 50)!r}::DOUBLE) + 25) / {P}::DOUBLE FROM f WHERE n >= 100),
ps AS (SELECT pool, draw_id, model, sum(CASE WHEN hit = 1 THEN ln(w) END) AS drawn, sum(w) AS s1, sum(w * w) AS s2, sum(w * w * w) AS s3, sum(w * w * w * w) AS s4, sum(w * w * w * w * w) AS s5 FROM w GROUP BY ALL),
es AS (SELECT *, (s1 * s1 - s2) / 2 AS e2, (e2 * s1 - s1 * s2 + s3) / 3 AS e3, (e3 * s1 - e2 * s2 + s1 * s3 - s4) / 4 AS e4, (e4 * s1 - e3 * s2 + e2 * s3 - s1 * s4 + s5) / 5 AS e5 FROM ps),
sc AS (SELECT pool, draw_id, model, drawn - ln(e5) + ln(1533939.0::DOUBLE) AS log_score FROM es)"""
POOLED = ", ev AS (SELECT pool, model, count(*)::BIGINT AS n, sum(log_score) AS log_e FROM sc GROUP BY ALL)"


@query("m001_pool_hits", sql(f", {PRIOR}{HITS} SELECT * FROM ph"))
def m001_pool_hits(spark, sf_dir):
    """Drawn labels among the 10, 15 and 20 most frequent before; a draw's labels are ranked in its own 47 rows."""
    return models.pool_hits(views.eligible(spark, sf_dir), MATRIX)


@query("walkforward_scores", sql(f", {PRIOR}{SCORED} SELECT pool, draw_id, model, round(log_score, 6) AS log_score FROM sc"))
def walkforward_scores(spark, sf_dir):
    return models.walk_forward(views.history(spark, sf_dir), MATRIX).withColumn("log_score", F.round("log_score", 6))


@query("e_values", sql(f", {PRIOR}{SCORED}{POOLED} SELECT pool, model, n, round(log_e, 5) AS log_e, log_e > ln(20.0::DOUBLE) AS evidence FROM ev"))
def e_values(spark, sf_dir):
    e = models.e_values(models.walk_forward(views.history(spark, sf_dir), MATRIX))
    return e.select("pool", "model", "n", F.round("log_e", 5).alias("log_e"), (F.col("e_value") > 20).alias("evidence"))


@query("model_gate", sql(f", {PRIOR}{SCORED}{POOLED}, t AS (SELECT model, avg(log_score) AS mean, stddev_samp(log_score) / sqrt(count(*)) AS se, sum(log_score) AS log_e FROM sc GROUP BY model), g AS (SELECT model, avg((log_e > 0)::INT) AS pools_gained FROM ev GROUP BY model) SELECT t.model, round(mean, 6) AS mean, round(se, 6) AS se, round(log_e, 4) AS log_e, round(pools_gained, 6) AS pools_gained, array_to_string(list_filter([CASE WHEN mean > 0 THEN 'gains' END, CASE WHEN mean > 1.96 * se THEN 'above_error' END, CASE WHEN log_e > 3 THEN 'evidence' END, CASE WHEN pools_gained > 0.5 THEN 'most_pools' END], lambda x: x IS NOT NULL), ';') AS met, mean > 0 AND mean > 1.96 * se AND log_e > 3 AND pools_gained > 0.5 AS passed FROM t JOIN g ON g.model = t.model"))
def model_gate(spark, sf_dir):
    g = models.gate(models.walk_forward(views.history(spark, sf_dir), MATRIX))
    return g.select("model", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("log_e", 4).alias("log_e"), F.round("pools_gained", 6).alias("pools_gained"), "met", "passed")


@query("candidate_pool", sql(f", {PRIOR}{HITS}{SCORED}{POOLED}, l AS (SELECT pool, avg(hits15) / (15 * 5 / 47.0::DOUBLE) AS lift FROM ph GROUP BY pool) SELECT pool, round(log_e, 5) AS log_e, round(lift, 6) AS lift FROM ev JOIN l USING (pool) WHERE model = 'frequency' ORDER BY log_e DESC, lift DESC, pool LIMIT 1"))
def candidate_pool(spark, sf_dir):
    """The pool that the model does best in: by cumulative score, then lift of its 15 likeliest labels, then name."""
    w = models.walked(views.eligible(spark, sf_dir), MATRIX)
    both = w.groupBy("pool").agg(F.sum("log_frequency").alias("log_e"), (F.avg("hits15") / (15 * 5 / 47.0)).alias("lift"))
    return models.candidate(both).select("pool", F.round("log_e", 5).alias("log_e"), F.round("lift", 6).alias("lift"))


PERMUTED = f"""x0 AS (SELECT pool, date_trunc('week', t) AS b, machine AS cat, draw_id, numbers FROM draws WHERE eligible),
cats AS (SELECT pool, b, row_number() OVER (PARTITION BY pool, b ORDER BY cat, draw_id) AS r, cat FROM x0),
dealt AS (SELECT pool, b, k AS permutation, numbers, row_number() OVER (PARTITION BY k, pool, b ORDER BY md5(k || ':' || draw_id), draw_id) AS r FROM x0, range(1, {PERMUTATIONS + 1}) s(k)),
ev AS (SELECT d.pool, permutation, c.cat, numbers FROM dealt d JOIN cats c ON c.pool = d.pool AND c.b = d.b AND c.r = d.r UNION ALL SELECT pool, 0, cat, numbers FROM x0),
ct AS (SELECT pool, permutation, cat, label, count(*)::DOUBLE AS c FROM (SELECT pool, permutation, cat, unnest(numbers) AS label FROM ev) GROUP BY ALL),
nn AS (SELECT pool, cat, count(*)::DOUBLE AS n FROM x0 GROUP BY ALL),
ch AS (SELECT q.pool, permutation, round(sum(q.q / (n * 5 / 47) - n * 5), 6) AS chi2 FROM (SELECT pool, permutation, cat, sum(c * c) AS q FROM ct GROUP BY ALL) q JOIN nn ON nn.pool = q.pool AND nn.cat = q.cat GROUP BY ALL)"""


@query("equipment_permutation", sql(f", {PERMUTED} SELECT o.pool, o.chi2 AS observed, round((any_value(o.chi2) - avg(n.chi2)) / greatest(stddev_samp(n.chi2), 1e-12), 4) AS z, count(*) FILTER (n.chi2 >= o.chi2)::BIGINT AS b, round((count(*) FILTER (n.chi2 >= o.chi2) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM ch o JOIN ch n ON n.pool = o.pool AND n.permutation > 0 WHERE o.permutation = 0 GROUP BY ALL"))
def equipment_permutation(spark, sf_dir):
    """Whether labels depend on the machine: its chi-square against permutations of the machines of the real draws in a week."""
    d = views.eligible(spark, sf_dir).withColumn("week", F.date_trunc("week", "t"))
    c = cut(models.permuted_chi2(d, MATRIX, "week", "machine", PERMUTATIONS).withColumn("chi2", F.round("chi2", 6)), "permuted")
    observed = c.where("permutation = 0").select("pool", F.col("chi2").alias("observed"))
    nulls = c.where("permutation > 0").select("pool", F.col("chi2").alias("value"))
    p = inference.mc_pvalue(nulls, observed, ["pool"]).join(inference.z_scores(nulls, observed, ["pool"]), "pool")
    return p.join(observed, "pool").select("pool", "observed", F.round("z", 4).alias("z"), "b", F.round("p", 6).alias("p"))


@query("special_rank_metrics", sql(", o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t, draw_id) AS k FROM h), g AS (SELECT o.pool, o.draw_id, o.k, o.special, s.label, (s.label = o.special)::INT AS hit FROM o CROSS JOIN (SELECT unnest(range(1, 16)) AS label) s), c AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY pool, label ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY pool, draw_id ORDER BY c DESC, label) AS r FROM c) SELECT pool, round(avg(r), 6) AS mean_rank, count(*) FILTER (r <= 5)::BIGINT AS top5, count(*)::BIGINT AS n FROM r WHERE hit = 1 GROUP BY pool"))
def special_rank_metrics(spark, sf_dir):
    r = models.special_ranks(views.history(spark, sf_dir), MATRIX)
    return r.groupBy("pool").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank") <= 5).alias("top5"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ audit
@query("audit_checks", "SELECT 'orders_unique' AS \"check\", count(*) = 0 AS passed, count(*)::BIGINT AS n_violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'customers_exist', count(*) = 0, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines_unique', count(*) = 0, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def audit_checks(spark, sf_dir):
    t = lambda n: views.table(spark, sf_dir, n)
    return audit.checks({"orders_unique": audit.unique(t("orders"), ["o_orderkey"]), "customers_exist": audit.orphans(t("orders"), t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"), "lines_unique": audit.unique(t("lineitem"), ["l_orderkey", "l_linenumber"])})
