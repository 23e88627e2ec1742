"""Features of the draws so far, and walk-forward scores of models that weigh labels by how often they were drawn.

P(S) is proportional to the product of the weights of the labels in S; its normaliser is an elementary symmetric
polynomial of all weights, which Newton's identities give from power sums. Draws are walked through in buckets, each
from what earlier buckets sum up to, and no task walks through a pool.
"""

from __future__ import annotations

import hashlib
import zlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.functions import exact
from tumbler.functions.exact import Matrix
from tumbler.operators.history import running, spine
from tumbler.scratch import cut

WARMUP, POOLS = 100, (10, 15, 20)
#: Draws' worth of fair expectation mixed into the frequency and the decayed model, and draws in which a count decays by
#: half (fixed values).
FREQUENCY_PSEUDO, DECAYED_PSEUDO, HALF_LIFE = 100.0, 25.0, 50
#: Draws of a bucket. Counts from more than REACH buckets back have decayed to less than a double shows.
BUCKET, REACH = 1000, 4


def features(hist: DataFrame, m: Matrix) -> DataFrame:
    """pool, draw_id, label, n, c, decayed, gap, prev, hit: what earlier draws of the pool say of each label.

    n earlier draws, c of them with the label, decayed the same with each draw's weight halved every HALF_LIFE draws, gap draws
    since the last one (n if none), prev whether the draw just before had it. Totals run over buckets of BUCKET draws, then
    inside a bucket, so no window holds a pool; the grid of draws and labels is shuffled once.
    """
    numbered = running(hist, ["pool"], F.date_trunc("day", "t"), ["t", "draw_id"], {"__n": F.lit(1)})
    grid = spine(numbered.select("pool", "draw_id", "__n", "numbers"), m.low, m.high)
    bucket, place = F.floor((F.col("__n") - 1) / BUCKET), F.col("__n") - F.col("__b") * BUCKET - 1
    halved = lambda draws: F.pow(F.lit(2.0), -draws / F.lit(float(HALF_LIFE)))
    grid = grid.select("pool", "draw_id", "label", "__n", bucket.alias("__b"), F.array_contains("numbers", F.col("label").cast("long")).cast("int").alias("hit"))
    grid = grid.withColumn("__w", F.when(F.col("hit") == 1, halved(-place)).otherwise(0.0)).withColumn("__at", F.when(F.col("hit") == 1, F.col("__n")))
    # A bucket's decayed count, at its end; one that isn't full is followed by none.
    totals = grid.groupBy("pool", "label", "__b").agg(F.sum("hit").alias("tc"), F.max("__at").alias("tl"), (F.sum("__w") * 2.0 ** (-(BUCKET - 1) / HALF_LIFE)).alias("td"))
    by = Window.partitionBy("pool", "label").orderBy("__b")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    decayed = sum((F.coalesce(F.lag("td", i).over(by), F.lit(0.0)) * 2.0 ** (-BUCKET * (i - 1) / HALF_LIFE) for i in range(1, REACH + 1)), F.lit(0.0))
    starts = totals.select("pool", "label", "__b", F.coalesce(F.sum("tc").over(earlier), F.lit(0)).alias("sc"), F.max("tl").over(earlier).alias("sl"), decayed.alias("sd"))
    inner = Window.partitionBy("pool", "label", "__b").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    seen = grid.join(starts, ["pool", "label", "__b"])
    seen = seen.withColumns({"ic": F.sum("hit").over(inner), "il": F.max("__at").over(inner), "iw": F.sum("__w").over(inner)})
    n, last = F.col("__n") - 1, F.coalesce(F.greatest("il", "sl"), F.lit(0))
    both = F.coalesce("iw", F.lit(0.0)) * halved(place - 1) + F.col("sd") * halved(place)
    return seen.select("pool", "draw_id", "label", n.alias("n"), (F.coalesce("ic", F.lit(0)) + F.col("sc")).alias("c"), both.alias("decayed"), (n - last).alias("gap"), ((n > 0) & (last == n)).alias("prev"), "hit")


def walked(hist: DataFrame, m: Matrix, scores: bool = True, by: str = "c") -> DataFrame:
    """pool, draw_id, hits (drawn labels among the 10, 15 and 20 with the largest c or decayed of features(), ties: smaller label
    first) and scores (log_frequency, log_decayed; see walk_forward()) of every draw after WARMUP.

    A task works out the draws of one bucket from what it starts with: sums of each bucket, carried over the table of buckets. Draws are
    shuffled, not draws times labels.
    """
    numbered = running(hist.select("pool", "draw_id", "t", "numbers"), ["pool"], F.date_trunc("day", "t"), ["t", "draw_id"], {"__n": F.lit(1)})
    inside = F.transform(F.filter("numbers", lambda x: x.between(m.low, m.high)), lambda x: (x - m.low).cast("int"))
    d = cut(numbered.select("pool", "draw_id", (F.col("__n") - 1).alias("n"), F.floor((F.col("__n") - 1) / BUCKET).alias("b"), F.coalesce(inside, F.array().cast("array<int>")).alias("hits")), "draws")
    size, length, warmup, p = m.n, BUCKET, WARMUP, m.k / m.n
    fade = 0.5 ** (1 / HALF_LIFE)

    def opened(rows: pa.Table) -> tuple:
        rows = rows.sort_by("n")
        n, hits = rows.column("n").to_numpy(), rows.column("hits").combine_chunks()
        hit = np.zeros((len(n), size))
        hit[hits.value_parent_indices().to_numpy(), hits.flatten().to_numpy()] = 1
        return rows, n, hit, (n % length)[:, None] / HALF_LIFE

    def summed(rows: pa.Table) -> pa.Table:
        rows, n, hit, at = opened(rows)
        own = {"c": hit.sum(0), "decayed": (hit * 2.0**at).sum(0) * 2.0 ** (-(length - 1) / HALF_LIFE)}
        return pa.table({"pool": [rows.column("pool")[0].as_py()] * 2, "b": [rows.column("b")[0].as_py()] * 2, "line": list(own), "v": [x.tobytes() for x in own.values()]}, lines)

    def carried(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("b")
        v = np.array([np.frombuffer(x) for x in rows.column("v").to_pylist()])
        keep, out = 1.0 if rows.column("line")[0].as_py() == "c" else 2.0 ** (-length / HALF_LIFE), np.zeros_like(v)
        for i in range(1, len(v)):
            out[i] = out[i - 1] * keep + v[i - 1]
        return pa.table({"p": rows.column("pool"), "b": rows.column("b"), "line": rows.column("line"), "v": [x.tobytes() for x in out]})

    def walk(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows, n, hit, at = opened(rows)
        of = {line: np.frombuffer(v) for line, v in zip(start.column("line").to_pylist(), start.column("v").to_pylist())}
        before = lambda x: np.vstack([np.zeros((1, size)), np.cumsum(x, 0)[:-1]])
        seen = {"c": before(hit) + of["c"], "decayed": before(hit * 2.0**at) * 2.0 ** (1 / HALF_LIFE - at) + of["decayed"] * 2.0**-at}
        ranked = np.take_along_axis(hit, np.argsort(-seen[by], 1, kind="stable"), 1)
        out = {"pool": rows.column("pool"), "draw_id": rows.column("draw_id"), **{f"hits{s}": ranked[:, :s].sum(1).astype("i8") for s in POOLS}}
        if scores:
            mass = ((1 - fade**n) / (1 - fade))[:, None]
            weights = {"frequency": (seen["c"] + FREQUENCY_PSEUDO * p) / (n[:, None] + FREQUENCY_PSEUDO) / p, "decayed": (seen["decayed"] + DECAYED_PSEUDO * p) / (mass + DECAYED_PSEUDO) / p}
            for model, w in weights.items():
                e, sums = [1.0], [(w**i).sum(1) for i in range(1, m.k + 1)]
                for k in range(1, m.k + 1):
                    e.append(sum((1 if i % 2 else -1) * e[k - i] * sums[i - 1] for i in range(1, k + 1)) / k)
                drawn = np.where(hit.any(1), (np.log(w) * hit).sum(1), np.nan)
                out[f"log_{model}"] = pa.array(drawn - np.log(e[m.k]) + np.log(float(comb(m.n, m.k))), from_pandas=True)
        return pa.table(out).filter(pa.array(n >= warmup))

    lines = pa.schema([("pool", pa.string()), ("b", pa.int64()), ("line", pa.string()), ("v", pa.binary())])
    text = "b bigint, line string, v binary"
    carry = d.groupBy("pool", "b").applyInArrow(summed, f"pool string, {text}").groupBy("pool", "line").applyInArrow(carried, f"p string, {text}")
    schema = "pool string, draw_id bigint, " + ", ".join([*(f"hits{s} bigint" for s in POOLS), *(["log_frequency double", "log_decayed double"] if scores else [])])
    return d.groupBy("pool", "b").cogroup(carry.groupBy("p", "b")).applyInArrow(walk, schema)


def walk_forward(hist: DataFrame, m: Matrix) -> DataFrame:
    """pool, draw_id, model, log_score: the log probability of every draw after WARMUP under the frequency and the decayed model,
    less that of an even draw. Each draw is scored from the draws before it only."""
    per = [F.struct(F.lit(model).alias("model"), F.col(f"log_{model}").alias("log_score")) for model in ("frequency", "decayed")]
    return walked(hist, m).select("pool", "draw_id", F.inline(F.array(*per)))


def e_values(scores: DataFrame) -> DataFrame:
    """pool, model: draws, cumulative log score and the e-value exp(sum), its exponent held at 700."""
    s = F.sum("log_score")
    return scores.groupBy("pool", "model").agg(F.count(F.lit(1)).alias("n"), s.alias("log_e"), F.exp(F.least(s, F.lit(700.0))).alias("e_value"))


def e_process(scores: DataFrame, times: DataFrame) -> DataFrame:
    """pool, draw_id, log_mix and peak: the log of the mean over models of exp(cumulative log score), after every scored draw,
    and the largest so far. times has pool, draw_id and t; draws are ordered by (t, draw_id).

    Sums and maxima run in days and over the table of days, so no window holds a pool. Exponents are taken from the largest model's,
    so none overflows.
    """
    rows = scores.join(times, ["pool", "draw_id"]).withColumn("__day", F.date_trunc("day", "t"))
    order = ["t", "draw_id"]

    def carried(df: DataFrame, by: list[str], x: str, f, zero: float, name: str) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        starts = df.groupBy(*by, "__day").agg(f(x).alias("__x")).select(*by, "__day", F.coalesce(f("__x").over(earlier), F.lit(zero)).alias("__start"))
        inner = f(x).over(Window.partitionBy(*by, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        both = F.col("__start") + inner if f is F.sum else F.greatest("__start", inner)
        return df.join(starts, [*by, "__day"]).withColumn(name, both).drop("__start")

    sums = carried(rows, ["pool", "model"], "log_score", F.sum, 0.0, "s").groupBy("pool", "draw_id", "t", "__day").agg(F.collect_list("s").alias("all"), F.max("s").alias("top"))
    mean = F.aggregate("all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))) / F.size("all")
    mixed = sums.select("pool", "draw_id", "t", "__day", (F.col("top") + F.ln(mean)).alias("log_mix"))
    return carried(mixed, ["pool"], "log_mix", F.max, float("-inf"), "peak").select("pool", "draw_id", "log_mix", "peak")


def pool_tails(hits: DataFrame, m: Matrix, sizes: tuple[int, ...] = POOLS) -> DataFrame:
    """One row for each size of a candidate pool: n, mean hits, the exact expectation, relative lift, mean improvement with its 95 %
    interval, observed and exact chances of at least 3, 4 and 5 hits (up to k), and of all but one."""
    rows = hits.select(F.inline(F.array(*[F.struct(F.lit(s).alias("size"), F.col(f"hits{s}").cast("double").alias("x")) for s in sizes])))
    tails = [h for h in (3, 4, 5) if h <= m.k]
    n, mean, sd = F.count(F.lit(1)), F.avg("x"), F.stddev_samp("x")
    seen = rows.groupBy("size").agg(n.alias("n"), mean.alias("mean_hits"), (1.96 * sd / F.sqrt(n.cast("double"))).alias("__half"), *[F.avg((F.col("x") >= h).cast("double")).alias(f"seen_{h}") for h in tails], F.avg((F.col("x") >= m.k - 1).cast("double")).alias("all_but_one"))
    pmfs = {s: exact.pool_pmf(m, s) for s in sizes}
    even = hits.sparkSession.createDataFrame([(s, exact.moments(p)[0], *[exact.tail(p, h) for h in tails], exact.tail(p, m.k - 1)) for s, p in pmfs.items()], f"size int, expected double, {', '.join(f'even_{h} double' for h in tails)}, even_all_but_one double")
    gain = F.col("mean_hits") - F.col("expected")
    return seen.join(F.broadcast(even), "size").withColumns({"lift": F.col("mean_hits") / F.col("expected") - 1, "gain": gain, "low": gain - F.col("__half"), "high": gain + F.col("__half")}).drop("__half")


#: Bounds of the gate's conditions (fixed values): e-value of a model and of the mixture, draws of a pool that counts, share of
#: such pools that gain, share of all gains that one pool may have, lift of 15 labels.
GATE = {"e_model": 80.0, "e_mix": 20.0, "draws": 50, "pools": 0.6, "concentration": 0.5, "lift": 0.02}


def gate_conditions(scores: DataFrame, hits: DataFrame, m: Matrix) -> DataFrame:
    """model and the conditions it meets: a positive pooled score, its e-value and the mixture's, the share of pools with enough draws
    that gain, no pool with most of the gains, and the lift of 15 labels and its interval (hits: model, hits15). passed: all seven.

    That models see no later draw is a matter of the walk; controls on invented histories are not here.
    """
    x = F.col("log_score")
    pools = scores.groupBy("model", "pool").agg(F.count(x).alias("n"), F.sum(x).alias("s"))
    enough = F.col("n") >= GATE["draws"]
    pos = F.sum(F.greatest("s", F.lit(0.0)))
    g = pools.groupBy("model").agg(F.sum("s").alias("log_e"), F.coalesce(F.avg(F.when(enough, (F.col("s") > 0).cast("double"))), F.lit(0.0)).alias("gaining"), F.when(pos > 0, F.max("s") / pos).otherwise(1.0).alias("concentration"))
    capped = F.exp(F.least("log_e", F.lit(700.0)))
    mix = g.agg(F.avg(capped).alias("e_mix"))
    lift = hits.groupBy("model").agg(F.avg("hits15").alias("mean"), F.stddev_samp("hits15").alias("sd"), F.count(F.lit(1)).cast("double").alias("h"))
    even = 15 * m.k / m.n
    both = g.crossJoin(F.broadcast(mix)).join(lift, "model")  # mix is one row
    rules = {
        "score": F.col("log_e") > 0, "e_model": capped >= GATE["e_model"], "e_mix": F.col("e_mix") >= GATE["e_mix"], "pools": F.col("gaining") >= GATE["pools"],
        "concentration": F.col("concentration") <= GATE["concentration"], "lift": F.col("mean") / even - 1 >= GATE["lift"], "interval": F.col("mean") - even - 1.96 * F.col("sd") / F.sqrt("h") > 0,
    }
    met = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return both.select("model", "log_e", "gaining", "concentration", (F.col("mean") / even - 1).alias("lift"), F.array_join(met, ";").alias("met"), (F.size(met) == len(rules)).alias("passed"))


def gate(scores: DataFrame) -> DataFrame:
    """model: mean log score, its standard error, the share of pools it gains in, the conditions met, and passed."""
    x = F.col("log_score")
    pools = scores.groupBy("model", "pool").agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n, s = F.sum("n"), F.sum("s")
    out = pools.groupBy("model").agg((s / n).alias("mean"), F.sqrt((F.sum("q") - s * s / n) / (n - 1) / n).alias("se"), s.alias("log_e"), F.mean((F.col("s") > 0).cast("double")).alias("pools_gained"))
    rules = {"gains": F.col("mean") > 0, "above_error": F.col("mean") > 1.96 * F.col("se"), "evidence": F.col("log_e") > 3.0, "most_pools": F.col("pools_gained") > 0.5}
    met = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return out.withColumn("met", F.array_join(met, ";")).withColumn("passed", F.size(met) == len(rules))


def pool_hits(hist: DataFrame, m: Matrix, by: str = "c") -> DataFrame:
    """pool, draw_id, hits10, hits15, hits20: drawn labels among the most frequent before, or the first by another of features()
    (ties: smaller label first)."""
    return walked(hist, m, False, by)


def candidate(scored: DataFrame, by: str = "pool") -> DataFrame:
    """The row that comes first by log_e (largest), then lift (largest), then name."""
    return scored.orderBy(F.desc("log_e"), F.desc("lift"), by).limit(1)


def special_ranks(hist: DataFrame, m: Matrix) -> DataFrame:
    """pool, draw_id, rank: the drawn special's place among all by earlier counts (ties: smaller label first)."""
    numbered = hist.select("pool", "draw_id", "t", "special")
    grid = spine(numbered, 1, m.specials)
    seen = running(grid, ["pool", "label"], F.date_trunc("day", "t"), ["t", "draw_id"], {"__c": (F.col("label") == F.col("special")).cast("int")})
    c = F.col("__c") - (F.col("label") == F.col("special")).cast("int")
    own = F.max_by(c, (F.col("label") == F.col("special")).cast("int"))
    rows = seen.withColumn("c", c).groupBy("pool", "draw_id").agg(own.alias("own"), F.max("special").alias("special"), F.collect_list(F.struct("c", "label")).alias("all"))
    ahead = F.filter("all", lambda x: (x["c"] > F.col("own")) | ((x["c"] == F.col("own")) & (x["label"] < F.col("special"))))
    return rows.select("pool", "draw_id", (F.size(ahead) + 1).cast("long").alias("rank"))


#: Draws of a block up to which all are ranked, and blocks whose counts a task holds before it sends them.
WHOLE, HELD = 1024, 200


def permuted_chi2(hist: DataFrame, m: Matrix, block: str, category: str, permutations: int) -> DataFrame:
    """pool, permutation (0: as observed), chi2: the category's label chi-square with categories permuted inside blocks.

    A permutation orders the draws of a (pool, block) by the MD5 of its number and the draw's id, and deals them the
    categories in their own order; so reruns agree. The draws of larger blocks are first counted by the first byte of their MD5, which
    tells the category of all but those who share it with a category's last draw. Only those are ranked, so no task holds a block.
    Label counts are summed before they are shuffled. Categories are few: a block's row carries their list.
    """
    rows = hist.select("pool", F.col(block).alias("b"), F.col(category).alias("cat"), "draw_id", "numbers")
    sizes = rows.groupBy("pool", "b", "cat").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy("pool", "b").orderBy("cat"))
    blocks = sizes.withColumn("end", end).groupBy("pool", "b").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("end", "cat"))).alias("ends"))
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = rows.join(blocks.select("pool", "b", "block", "n"), ["pool", "b"]).select("pool", "block", "n", F.col("draw_id").cast("string").alias("id"), F.col("numbers").cast("array<bigint>").alias("numbers"))
    # Each draw is work for all permutations, so draws are dealt out evenly.
    large = cut(draws.where(F.col("n") > WHOLE).drop("n").repartition(parts, "id"), "draws")

    def digests(ids: list[str]):
        raw = [x.encode() for x in ids]
        for k in range(1, permutations + 1):
            head = b"%d:" % k
            yield b"".join([hashlib.md5(head + x).digest() for x in raw])

    def count(batches):
        held: dict[int, np.ndarray] = {}

        def out():
            keys = list(held)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) * permutations + 1, dtype="i4") * 256), pa.array(np.concatenate([held[x].ravel() for x in keys])))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, permutations), pa.int64()), pa.array(np.tile(np.arange(1, permutations + 1), len(keys)), pa.int32()), flat], names=["block", "permutation", "counts"])

        for batch in batches:
            keys, place = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            for k, raw in enumerate(digests(batch.column("id").to_pylist())):
                c = np.bincount(place * 256 + np.frombuffer(raw, "u1")[::16], minlength=len(keys) * 256).reshape(-1, 256)
                for x, row in zip(keys.tolist(), c):
                    if x not in held:
                        held[x] = np.zeros((permutations, 256), "i8")
                    held[x][k] += row
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    seen = large.select("block", "id").mapInArrow(count, "block bigint, permutation int, counts array<bigint>")
    seen = seen.select("block", "permutation", F.posexplode("counts").alias("byte", "c")).where("c > 0").groupBy("block", "permutation", "byte").agg(F.sum("c").alias("c"))
    start = F.sum("c").over(Window.partitionBy("block", "permutation").orderBy("byte")) - F.col("c")
    bytes_ = seen.withColumn("start", start).join(blocks.select("block", "ends"), "block")
    # The byte in which each category ends, in order.
    edges = cut(bytes_.select("block", "permutation", "byte", "start", F.inline(F.filter("ends", lambda x: (x["end"] > F.col("start")) & (x["end"] <= F.col("start") + F.col("c"))))), "edges")
    cats = [r[0] for r in sizes.select("cat").distinct().orderBy("cat").collect()]
    code = F.array_position(F.array(*map(F.lit, cats)), F.col("cat")) - 1 if None not in cats else F.lit(None).cast("long")
    if None in cats:
        for i, x in enumerate(cats):
            code = F.when(F.col("cat").eqNullSafe(F.lit(x)), i).otherwise(code)
    lists = edges.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("permutation", "end", "byte", code.alias("code")))), lambda x: F.struct(x["byte"].cast("int").alias("byte"), x["code"].cast("int").alias("code"))).alias("edges"))
    lists = lists.select("block", F.transform("edges", lambda x: x["byte"]).alias("edge"), F.transform("edges", lambda x: x["code"]).alias("code"))
    kinds, names = len(cats), ["pool", "permutation", "cat", "label", "c", "block", "byte", "h", "numbers"]

    def deal(batches):
        """Label counts of draws whose category is sure, and the other draws."""
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            pools, blocks_ = np.array(batch.column("pool").to_pylist(), object), batch.column("block").to_numpy()
            numbers = batch.column("numbers")
            sizes_ = np.array([len(x) if x is not None else 0 for x in numbers.to_pylist()])
            flat = numbers.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes_)), sizes_)
            keys, first, place = np.unique(blocks_, return_index=True, return_inverse=True)
            edge = [np.array(batch.column("edge")[i].as_py()).reshape(permutations, -1) for i in first]
            kind = [np.array(batch.column("code")[i].as_py()).reshape(permutations, -1) for i in first]
            mine = [np.flatnonzero(place == i) for i in range(len(keys))]
            cells, cell = np.unique(np.array([f"{p}|{x}" for p, x in zip(pools[owner], flat)]), return_inverse=True)
            which = [(pools[owner[i]], int(flat[i])) for i in np.unique(cell, return_index=True)[1]]
            for k, raw in enumerate(digests(batch.column("id").to_pylist())):
                byte = np.frombuffer(raw, "u1")[::16]
                given, open_ = np.empty(len(byte), "i8"), np.empty(len(byte), bool)
                for i, at in enumerate(mine):
                    j = np.searchsorted(edge[i][k], byte[at], "left")  # the last category ends in the last byte there is
                    given[at], open_[at] = kind[i][k][j], edge[i][k][j] == byte[at]
                sure = ~open_[owner]
                c = np.bincount(cell[sure] * kinds + given[owner[sure]], minlength=len(cells) * kinds).reshape(-1, kinds)
                for x, row in zip(which, c):
                    if x not in sums:
                        sums[x] = np.zeros((permutations, kinds), "i8")
                    sums[x][k] += row
                at = np.flatnonzero(open_)
                if len(at):
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(pools[at], pa.string()), pa.array([k + 1] * len(at), pa.int32()), none, none, none, pa.array(blocks_[at], pa.int64()), pa.array(byte[at].astype("i4")), pa.array([raw[16 * i : 16 * i + 16].hex() for i in at]), numbers.take(pa.array(at))], names=names)
        for (pool, label), table in sums.items():
            at = np.flatnonzero(table)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([pool] * len(at), pa.string()), pa.array((at // kinds + 1).astype("i4")), pa.array(at % kinds), pa.array([label] * len(at), pa.int64()), pa.array(table.ravel()[at]), none, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.list_(pa.int64()))], names=names)

    out = cut(large.join(lists, "block").mapInArrow(deal, "pool string, permutation int, cat bigint, label bigint, c bigint, block bigint, byte int, h string, numbers array<bigint>"), "dealt")
    sure = out.where("block IS NULL").select("pool", "permutation", F.element_at(F.array(*map(F.lit, cats)), (F.col("cat") + 1).cast("int")).alias("cat"), "label", "c")
    edge_starts = edges.groupBy("block", "permutation", "byte").agg(F.min("start").alias("start"))
    close = out.where("block IS NOT NULL").select("pool", "permutation", "block", "byte", "h", "numbers").join(edge_starts, ["block", "permutation", "byte"])
    whole = draws.where(F.col("n") <= WHOLE).select("pool", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"), "block", F.lit(0).alias("byte"), "id", "numbers")
    whole = whole.select("pool", "permutation", "block", "byte", F.md5(F.concat_ws(":", "permutation", "id")).alias("h"), "numbers", F.lit(0).cast("long").alias("start"))
    inner = Window.partitionBy("block", "permutation", "byte").orderBy("h", "numbers")
    close = close.select(*whole.columns).unionByName(whole).withColumn("r", F.col("start") + F.row_number().over(inner)).join(blocks.select("block", "ends"), "block")
    close = close.select("pool", "permutation", F.filter("ends", lambda x: x["end"] >= F.col("r"))[0]["cat"].alias("cat"), "numbers")
    every = close.unionByName(rows.select("pool", F.lit(0).alias("permutation"), "cat", "numbers"))
    counts = every.select("pool", "permutation", "cat", F.explode(F.col("numbers").cast("array<bigint>")).alias("label"), F.lit(1).cast("long").alias("c")).unionByName(sure).groupBy("pool", "permutation", "cat", "label").agg(F.sum("c").alias("c"))
    n = rows.groupBy("pool", "cat").agg(F.count(F.lit(1)).alias("n"))
    e = F.col("n").cast("double") * m.k / m.n
    # Labels that a category lacks add their expectation: sum of (c - e)^2 / e over all is sum of c^2 / e less the draws' labels.
    parts = counts.groupBy("pool", "permutation", "cat").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("q")).join(n, ["pool", "cat"])
    return parts.groupBy("pool", "permutation").agg(F.sum(F.col("q") / e - F.col("n") * m.k).alias("chi2"))


#: Labels of kinds of draws and permutations worked on at once, as numbers in a task.
DEALT = 4_000_000


def permuted_margins(hist: DataFrame, m: Matrix, block: str, category: str, permutations: int) -> DataFrame:
    """pool, permutation (0: as observed), chi2: the same statistic for many permutations, each of which deals the draws of a
    (pool, block) their categories anew.

    Draws of a block with the same labels are one kind: how many of a kind a category is dealt is hypergeometric, given what is left of
    the kind and the category. So work and a task's memory follow the kinds of a block, not its draws, and the law is that of
    dealing draw by draw. Counts of (permutation, category, label) are all that is shuffled after. The generator is seeded with the
    block, so reruns agree. Null categories and labels outside m don't count.
    """
    cats = [r[0] for r in hist.select(category).where(F.col(category).isNotNull()).distinct().orderBy(category).collect()]
    place = {c: i for i, c in enumerate(cats)}
    inside = F.transform(F.filter("numbers", lambda x: x.between(m.low, m.high)), lambda x: (x - m.low).cast("int"))
    rows = hist.where(F.col(category).isNotNull()).select("pool", F.col(block).cast("string").alias("b"), F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col(category)].alias("cat") if cats else F.lit(0).alias("cat"), F.coalesce(F.array_sort(F.array_distinct(inside)), F.array().cast("array<int>")).alias("hits"))
    kinds = rows.groupBy("pool", "b", "hits", "cat").agg(F.count(F.lit(1)).alias("c"))
    # The rows are few and much work each, so partitions are not left to their size.
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kinds.repartition(parts, "pool", "b").sortWithinPartitions("pool", "b", "hits", "cat")
    size, k = m.n, len(cats)

    def run(batches):
        pool = None
        sums = None

        def out():
            table = sums.reshape(permutations + 1, -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype="i4")), pa.array(table.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([pool] * len(table), pa.string()), pa.array(np.arange(len(table)), pa.int32()), flat], names=["pool", "permutation", "counts"])

        def add(key, table, hits):
            h = np.zeros((len(hits), size))
            for i, labels in enumerate(hits):
                h[i, labels] = 1
            table = np.array(table)
            sums[0] += (table.T @ h).astype("i8")
            rng, step = np.random.default_rng(zlib.crc32("|".join(map(str, key)).encode())), max(1, DEALT // len(hits))
            each, every = table.sum(1), table.sum(0)
            for first in range(1, permutations + 1, step):
                n = min(step, permutations + 1 - first)
                left = np.repeat(each[:, None], n, 1)  # of each kind, in each permutation
                for c in range(k - 1):
                    rest, wanted = left.sum(0), np.full(n, every[c])
                    given = np.empty_like(left)
                    for i in range(len(hits)):
                        rest -= left[i]
                        given[i] = rng.hypergeometric(left[i], rest, wanted)
                        wanted -= given[i]
                    left -= given
                    sums[first : first + n, c] += (given.T @ h).astype("i8")
                sums[first : first + n, k - 1] += (left.T @ h).astype("i8")

        held: tuple | None = None
        table: list = []
        hits: list = []
        for batch in batches:
            for p, b, x, c, many in zip(*(batch.column(n).to_pylist() for n in ("pool", "b", "hits", "cat", "c"))):
                if held != (p, b):
                    if held is not None:
                        add(held, table, hits)
                    if held is None or held[0] != p:
                        if held is not None:
                            yield out()
                        pool, sums = p, np.zeros((permutations + 1, k, size), "i8")
                    held, table, hits = (p, b), [], []
                if not hits or hits[-1] != x:
                    hits.append(x)
                    table.append([0] * k)
                table[-1][c] += many
        if held is not None:
            add(held, table, hits)
            yield out()

    counts = dealt.mapInArrow(run, "pool string, permutation int, counts array<bigint>")
    # Position by position, so equal positions meet; k times n positions for each permutation and pool.
    cells = counts.select("pool", "permutation", F.posexplode("counts").alias("at", "c")).groupBy("pool", "permutation", "at").agg(F.sum("c").cast("double").alias("c"))
    parts = cells.groupBy("pool", "permutation", F.floor(F.col("at") / size).alias("cat")).agg(F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2")).where("s1 > 0")
    return parts.groupBy("pool", "permutation").agg(F.sum(F.col("s2") * m.n / F.col("s1") - F.col("s1")).alias("chi2"))
