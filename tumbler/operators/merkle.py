"""Seals as hash trees: a root that changes with any row, whatever the order and number of files.

Equal rows are one entry with a count. Entries are grouped by the first hex digits of their SHA-256, as many as leave
about LEAF rows in a leaf; sixteen nodes make one of the level above. So no group holds more than a few hundred hashes, at any
size, a single row can be proved by the nodes beside its path, and two versions are compared leaf by leaf.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tumbler.scratch import cut
from tumbler.sources.lines import numbered

LEAF, DEEPEST = 256, 12


def row_hash(cols: list[str]) -> Column:
    """SHA-256 of a row's values as strings, each with its length before it; '-' stands for a null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, cols)), 256)


def depth_of(total: Column) -> Column:
    """The least number of digits that leaves LEAF rows or fewer in a leaf on average."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(DEEPEST)), lambda d: total > F.lit(LEAF).cast("long") * F.pow(F.lit(16), d).cast("long")))


def _same(by: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Equality of the keys in by, which b has with '__' before them; nulls are equal."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def entries(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """by, h and c: every distinct row's hash and how often it occurs."""
    return df.select(*(by or []), row_hash(cols).alias("h")).groupBy(*(by or []), "h").agg(F.count(F.lit(1)).alias("c"))


def leaves(rows: DataFrame, by: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """by, level (digits), prefix, n and hash of the leaves over entries(); the depth follows each key's number of rows."""
    by = by or []
    if depth is None:
        sizes = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(depth_of(F.coalesce(F.sum("c"), F.lit(0))).alias("level"))
        rows = rows.join(sizes, _same(by, rows, sizes)).drop(*[f"__{c}" for c in by]) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    else:
        rows = rows.withColumn("level", F.lit(depth))
    entry = F.concat("h", F.lit("*"), F.col("c").cast("string"))
    return rows.groupBy(*by, "level", F.substring("h", F.lit(1), F.col("level")).alias("prefix")).agg(F.sum("c").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256).alias("hash"))


def above(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The nodes one level above nodes of one level: hashes of their children's last digits and hashes, in order."""
    children = F.sort_array(F.collect_list(F.struct("prefix", "hash")))
    joined = F.array_join(F.transform(children, lambda x: F.concat(F.right(x["prefix"], F.lit(1)), x["hash"])), "")
    up = F.col("level") - 1
    return nodes.groupBy(*(by or []), up.alias("level"), F.substring("prefix", F.lit(1), up).alias("up")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("hash")).withColumnRenamed("up", "prefix")


def tree(df: DataFrame, cols: list[str], by: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """by, level, prefix, n and hash of all nodes; level 0 is the root. Each level is written, a sixteenth of the one below."""
    low = cut(leaves(entries(df, cols, by), by, depth), "leaves")
    deepest = low.agg(F.max("level")).first()[0] or 0
    names = [*(by or []), "level", "prefix", "n", "hash"]
    here = low.where(F.col("level") == deepest).select(*names)
    out = here
    for level in range(deepest, 0, -1):
        here = cut(low.where(F.col("level") == level - 1).select(*names).unionByName(above(here, by).select(*names)), "nodes")
        out = out.unionByName(here)
    return out


def seal(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (or one for each `by`): n and seal, the SHA-256 of n and the root."""
    root = tree(df, cols, by).where("level = 0").select(*(by or []), "n", "hash")
    if not by:  # a table without rows has a seal too
        root = root.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("hash"))
    return root.select(*(by or []), "n", F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("hash")), 256).alias("seal"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def proof(df: DataFrame, cols: list[str], h: str) -> dict:
    """What shows that a row with hash h is sealed: the number of rows, its leaf's entries and the nodes beside its path, from the
    leaf's level up. A few hundred hashes at any size; raises if there is no such row."""
    rows = cut(entries(df, cols), "entries")
    total = rows.agg(F.sum("c")).first()[0] or 0
    depth = next(d for d in range(DEEPEST + 2) if total <= LEAF * 16**d)
    leaf = sorted(f"{r['h']}*{r['c']}" for r in rows.where(F.col("h").startswith(h[:depth])).collect())
    if not any(x.split("*")[0] == h for x in leaf):
        raise KeyError(f"no row with hash {h}")
    nodes = tree(df, cols, depth=depth)
    beside = [sorted((r["prefix"], r["hash"]) for r in nodes.where((F.col("level") == level) & F.col("prefix").startswith(h[: level - 1])).collect()) for level in range(depth, 0, -1)]
    return {"n": total, "leaf": leaf, "beside": beside}


def proves(found: dict, h: str, sealed: str) -> bool:
    """Whether a proof leads from a row's hash to a seal."""
    if not any(x.split("*")[0] == h for x in found["leaf"]):
        return False
    own, depth = _sha(",".join(found["leaf"])), len(found["beside"])
    for i, level in enumerate(found["beside"]):
        if (h[: depth - i], own) not in level:
            return False
        own = _sha("".join(p[-1] + x for p, x in level))
    return _sha(f"{found['n']}:{own}") == sealed


def differences(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """h, n_a and n_b: rows that two versions don't hold equally often. Only leaves with other hashes are looked into."""
    ea, eb = cut(entries(a, cols), "entries"), cut(entries(b, cols), "entries")
    total = max(x.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] for x in (ea, eb))
    depth = next(d for d in range(DEEPEST + 2) if total <= LEAF * 16**d)
    la, lb = (leaves(x, depth=depth).select("prefix", F.col("hash").alias(name)) for x, name in ((ea, "ha"), (eb, "hb")))
    other = la.join(lb, "prefix", "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("prefix")
    pick = lambda x, name: x.withColumn("prefix", F.substring("h", 1, depth)).join(other, "prefix", "left_semi").select("h", F.col("c").alias(name))
    both = pick(ea, "n_a").join(pick(eb, "n_b"), "h", "full")
    return both.select("h", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a <> n_b")


def lines(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """file, offset and line for every line of text files (of one text if joined): leaves of a seal of raw lines."""
    return numbered(spark, path, joined).select("file", "offset", "line")


def seal_lines(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """The seal of the raw lines of files, or of those whose first field (up to a comma) is an id: file, offset and line."""
    rows = lines(spark, path)
    if ids is not None:
        rows = rows.withColumn("__id", F.substring_index("line", ",", 1)).join(ids.select(F.col(ids.columns[0]).cast("string").alias("__id")).distinct(), "__id", "left_semi")
    return seal(rows, ["file", "offset", "line"])
