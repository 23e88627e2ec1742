"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow routes the tokens of
each pattern to source quotas; the r-th copy of a pattern's tokens costs r * r, so the flow
repeats text only where quotas need it and as evenly as it can. Documents are then selected
by seeded buckets, in proportion over size classes, one task for each pattern.

The driver holds one number for each source and one for each pattern, not documents.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, drop, few_rows, words_of

WEIGHTS = (3, 1, 2)
BUCKETS = 256
#: Bits that hold the reachable sums of a pattern's small cells.
BITS = 1 << 30
BROADCAST_ROWS = 200_000


def fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight, none above most times its size; what is above is shared again by weight."""
    share, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not full:
            share.update({s: left * weights[s] / w for s in open_})
            break
        for s in full:
            share[s] = float(most * sizes[s])
        left -= sum(share[s] for s in full)
        open_ -= full
    return share


def route(capacity: dict, members: dict, quota: dict, most: int) -> dict:
    """Min-cost flow, pattern -> source. capacity: tokens of each pattern; returns (pattern, source) -> tokens.

    Start -> pattern: `most` edges of the pattern's tokens that cost 1, 4, 9, ...; pattern -> member sources, free; source ->
    end: its quota. A path's cost is that of its first edge, so the cheapest flow opens the edges in the order of their costs
    and each time augments as far as it can, by shortest paths in layers; flow that is there may be rerouted.
    """
    flow: dict = {(p, s): 0 for p in capacity for s in members[p]}
    holders: dict = {s: [] for s in quota}
    for p, s in flow:
        holders[s].append(p)
    spare, lacks = dict.fromkeys(capacity, 0), dict(quota)
    for _ in range(most):
        for p, n in capacity.items():
            spare[p] += n
        while _augment(flow, holders, members, spare, lacks):
            pass
    return flow


def _augment(flow: dict, holders: dict, members: dict, spare: dict, lacks: dict) -> int:
    """A blocking flow over shortest alternating paths: pattern -> source it may serve -> pattern that serves it now."""
    layer, edge = {("p", p): 0 for p, n in spare.items() if n > 0}, [("p", p) for p, n in spare.items() if n > 0]
    roots, out, done = list(edge), {}, False
    while edge and not done:
        new = []
        for x in edge:
            kind, name = x
            out[x] = [("s", s) for s in members[name]] if kind == "p" else [("p", p) for p in holders[name] if flow[p, name] > 0]
            for y in out[x]:
                if y not in layer:
                    layer[y] = layer[x] + 1
                    new.append(y)
                    done |= y[0] == "s" and lacks[y[1]] > 0
        edge = new
    if not done:
        return 0
    moved, at = 0, dict.fromkeys(layer, 0)
    for root in roots:
        path = [root]
        while path and spare[root[1]] > 0:
            x = path[-1]
            if x[0] == "s" and lacks[x[1]] > 0:
                back = [flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"]
                push = min([spare[root[1]], lacks[x[1]], *back])
                for a, b in zip(path, path[1:]):
                    flow[(a[1], b[1]) if a[0] == "p" else (b[1], a[1])] += push if a[0] == "p" else -push
                spare[root[1]] -= push
                lacks[x[1]] -= push
                moved += push
                path = [root]
                continue
            ways = out.get(x, [])
            while at[x] < len(ways):
                y = ways[at[x]]
                if layer[y] == layer[x] + 1 and (x[0] == "p" or flow[y[1], x[1]] > 0):
                    break
                at[x] += 1
            if at[x] < len(ways):
                path.append(ways[at[x]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1
    return moved


def nearest(sizes: list[int], want: int, most: int) -> list[int]:
    """How often (0 to most) each size is taken so that the sum is the nearest to want that there is; of the ways to reach
    it one that takes sizes about equally often, the last ones first. Bit n of a number says whether the sum n is reachable."""
    total = sum(sizes)
    bound = (1 << max(0, min(want + max(sizes, default=0), most * total)) + 1) - 1
    reach = [1]
    for n in sizes:
        now = reach[-1]
        for c in range(1, most + 1):
            now |= reach[-1] << c * n
        reach.append(now & bound)
    below, above = reach[-1] & (1 << max(0, want) + 1) - 1, reach[-1] >> max(0, want)
    low, high = below.bit_length() - 1, max(0, want) + (above & -above).bit_length() - 1
    at = low if not above or want - low <= high - want else high
    ways = sorted(range(most + 1), key=lambda c: abs(c - at / max(total, 1)))
    out = []
    for n, before in zip(reversed(sizes), reversed(reach[:-1])):
        out.append(next(c for c in ways if at >= c * n and before >> at - c * n & 1))
        at -= out[-1] * n
    return out[::-1]


def copies(have: dict[tuple[int, int], int], want: int, most: int) -> dict[tuple[int, int], int]:
    """How often each bucket (class, bucket) -> tokens is taken so that the tokens add up to nearly want.

    The largest buckets are taken in turn, each as often as its share of want and what the ones before it left over allow,
    and so that the smaller ones can make up the rest. The small ones, all of them where the sums they can have are at most
    BITS numbers in all, fill what is left as nearly as any way of taking them can.
    """
    keys = sorted(have, key=lambda k: (have[k], k))
    few, tokens, rest = 0, 0, sum(have.values())
    for k in keys:
        tokens += have[k]
        if (few + 1) * most * tokens > BITS:
            break
        few += 1
    out, left, carry, share = {}, want, 0.0, want / max(1, rest)
    for k in reversed(keys[few:]):
        rest -= have[k]
        carry += share * have[k]
        least, highest = -(-(left - most * rest) // have[k]), left // have[k]
        out[k] = max(0, min(most, highest, max(least, int(carry // have[k]))))
        left -= out[k] * have[k]
        carry -= out[k] * have[k]
    return out | dict(zip(keys[:few], nearest([have[k] for k in keys[:few]], left, most)))


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 4, keep: list[str] | None = None):
    """Copies to take of each document so that sources come near their targets.

    `sources` is an array of source names (a null name is a source of its own). Targets: share
    times all sizes by weight (weights repeat over the sources in code point order, null last),
    at most `most` times a source's size. Returns (rows, targets, members): rows has doc_id, size,
    pattern, copies and taken = copies * size; targets maps a source to (size, target), members a
    pattern to its sources. With `keep`, rows has these columns of docs in a struct named row as well.

    Sizes count words of whole texts, however long; null or blank texts have size 0 and take 0. Selection hashes id,
    size and a text hash with the seed, so reruns agree and equal rows are treated alike. An empty table gives no
    rows. Extra columns are not read, whatever their names. Any number of source sets is routed.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = F.size(words_of(text)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    wide = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.to_json(F.array_sort(F.array_distinct(sources))).alias("pattern"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("draw"), *row)
    wide = wide.select("doc_id", "size", F.coalesce("pattern", F.lit("[null]")).alias("pattern"), F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int").alias("class"), F.pmod("draw", F.lit(BUCKETS)).cast("int").alias("bucket"), *["row"] * bool(keep))
    sized = cut(wide.drop("row"), "mix")
    # At most 40 classes * BUCKETS rows of each pattern, whatever the input's size.
    cells = cut(sized.groupBy("pattern", "class", "bucket").agg(F.sum("size").alias("n")), "mix-cells")
    capacity = {r["pattern"]: r["n"] for r in cells.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()}
    members = {p: json.loads(p) or [None] for p in capacity}
    source_size: dict = {}
    for p, n in capacity.items():
        for s in members[p]:
            source_size[s] = source_size.get(s, 0) + n
    names = sorted(source_size, key=lambda s: (s is None, s or ""))
    target = fill(source_size, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(capacity.values()), most)
    flow = route(capacity, members, {s: round(t) for s, t in target.items()}, most)
    wants = docs.sparkSession.createDataFrame([(p, sum(flow[p, s] for s in members[p])) for p in capacity], "pattern string, want long")

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        have = {(c, b): n for c, b, n in zip(pdf["class"], pdf["bucket"], pdf["n"]) if n}
        taken = copies(have, int(pdf["want"].iloc[0]), most) if have else {}
        return pd.DataFrame({"pattern": pdf["pattern"], "class": pdf["class"], "bucket": pdf["bucket"], "copies": [taken.get(k, 0) for k in zip(pdf["class"], pdf["bucket"])]})

    wanted = cells.join(F.broadcast(wants) if len(capacity) <= BROADCAST_ROWS else wants, "pattern")
    plan = cut(wanted.groupBy("pattern").applyInPandas(chosen, "pattern string, class int, bucket int, copies int"), "mix-plan")
    rows = (wide if keep else sized).join(few_rows(plan, BROADCAST_ROWS), ["pattern", "class", "bucket"])
    rows = rows.select(*["row"] * bool(keep), "doc_id", "size", "pattern", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"))
    drop(cells, *[sized] * bool(keep))
    return rows.withColumn("taken", F.col("copies") * F.col("size")), {s: (source_size[s], target[s]) for s in names}, members


def op4_mix_flow(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, targets, members = mix(docs, F.array("source"))
    of = spark.createDataFrame([(p, *targets[s]) for p, (s,) in members.items()], "pattern string, source_size long, target double")
    return rows.join(few_rows(of, BROADCAST_ROWS), "pattern").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")
