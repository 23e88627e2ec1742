"""Exact self join of documents on the Jaccard similarity of their word shingles.

1. Copies of a text are one document. A document's set is that of its 5-word shingles, as 64-bit hashes.
2. Prefix filter: of each set the lowest hashes, enough that similar sets share several of them, are
   counted over all documents. A document that shares too few is similar to none; nearly all end here.
3. Groups: the others are grouped by the most frequent of these hashes, large groups split in parts that each see
   the group's pivot. Inside a group every pair is compared, which links nearly all that belongs together. The
   group is stored as one row: the union of its sets, and which members hold each of its hashes.
4. Token-group matrix: for hashes still held by several components, (hash, group) with a bit for each member that
   must ask. Joined with itself by hash it names the pairs of groups, and the bits are or-ed over the hashes, so a
   hash of n documents makes (n / GROUP) squared rows at most. The members that ask are sent to the other group's row
   in slices; only if their overlap with the union reaches the bound is the group opened and each member compared.

Hashes, like the sizes, are exact but for collisions of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import SPACE, bucket_slices, cut, drop, few_rows, pieces, shuffles
from tumbler.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Members of a group and tokens of their sets, on average, beyond which it is split; members have MASK_BITS places.
GROUP, GROUP_TOKENS = 128, 2_000_000
LONGS = 4
MASK_BITS = 64 * LONGS
#: Documents that one task compares with a group.
SLICE = 256
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
BROADCAST_ROWS = 200_000
NULL_ID = -(1 << 63)
#: Words whose hashes a task remembers.
REMEMBERED = 100_000


def words_in(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.lower() touches A-Z only, and bytes.split() parts at ASCII white space."""
    return (text or "").encode().lower().split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of fewer words than a shingle, one of all."""
    words = words_in(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def least_shared(size: int) -> int:
    """How many of their lowest hashes two similar sets share at least, if the smaller has this size."""
    return max(1, 2 * size // 5)


def bound(size: int) -> int:
    """The overlap that a similar set must have with one of this size."""
    return -(-PERCENT * size // 100)


def lowest(tokens: np.ndarray) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - bound(n) + least_shared(n)]


def similar(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 matrices over the hashes that two sets or more hold."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    values, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.cumsum(count > 1) - 1
    use = count[of] > 1
    doc, col = doc[use], kept[of[use]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros((n, n), np.int64)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, chunk):
        a, b = np.searchsorted(col, [start, start + chunk])
        m = np.zeros((n, chunk), np.float32)
        m[doc[a:b], col[a:b] - start] = 1
        out += (m @ m.T).astype(np.int64)
    return out


class Forest:
    """Union-find that keeps the links which joined two trees."""

    def __init__(self):
        self.root, self.links = {}, []

    def top(self, i: int) -> int:
        root = self.root
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    def link(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((a, b))


def linked(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of a group: a spanning forest."""
    forest = Forest()
    if len(ids) > 1:
        size = np.array([len(s) for s in sets])
        for i, j in zip(*np.nonzero(np.triu(similar(overlaps(sets), size[:, None], size[None, :]), 1))):
            forest.link(ids[i], ids[j])
    return forest.links


def stored(ids: list[int], sets: list[np.ndarray]) -> dict:
    """A group as a row: its union (sorted hashes), how many members hold each hash and which, and their ids and sizes."""
    union, of, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets), dtype=np.uint8), [len(s) for s in sets])
    return {"union": union.tobytes(), "held": held.astype(np.uint16).tobytes(), "members": member[np.argsort(of, kind="stable")].tobytes(), "ids": np.array(ids, np.int64).tobytes(), "sizes": np.array([len(s) for s in sets], np.int64).tobytes()}


def opened(group: dict, queries: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of queries (id, set) with a stored group's members: a spanning forest of the similar pairs.

    A query whose overlap with the group's union is below its bound is similar to no member and opens nothing.
    """
    union, ids = np.frombuffer(group["union"], np.uint64), np.frombuffer(group["ids"], np.int64).tolist()
    forest, held = Forest(), None
    for q, tokens in queries:
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        here = at[union[at] == tokens]
        if len(here) < bound(len(tokens)):
            continue
        if held is None:
            held, members, size = (np.frombuffer(group[x], t) for x, t in (("held", np.uint16), ("members", np.uint8), ("sizes", np.int64)))
        hit = np.zeros(len(union), bool)
        hit[here] = True
        overlap = np.bincount(members[np.repeat(hit, held)], minlength=len(ids))
        for i in np.flatnonzero(similar(overlap, len(tokens), size)):
            forest.link(q, ids[i])
    return forest.links


def _key_bits(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 1:6])


def _sets(table: pa.Table) -> list[tuple]:
    """(key, digest, set) of each distinct text of a block, in a fixed order."""
    hashes, by = WordHashes(), {}
    for key, digest, text in zip(table.column("key").to_pylist(), table.column("digest").to_pylist(), table.column("text")):
        if digest not in by:
            by[digest] = (key, digest, shingles(text.as_py(), hashes))
    return [by[d] for d in sorted(by)]


def _prefixes(sets: list[tuple], buckets: int):
    """Distinct low hashes of a block, sorted, in how many sets each stands (255 at most), and each bucket's part of them."""
    low = [lowest(s) for _, _, s in sets if len(s)]
    tokens, count = np.unique(np.concatenate(low), return_counts=True) if low else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tokens, np.minimum(count, 255).astype(np.uint8), bucket_slices(tokens, buckets)


def chosen(tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Of a set's low hashes (df: in how many documents each stands), the rarest of which a similar set must hold one.

    Similar sets share `need` of them at least, so all but the need - 1 most frequent will do; those that no other
    document holds are left out. Empty if too few are shared. The last is the most frequent.
    """
    n = len(tokens)
    low = lowest(tokens)
    need = least_shared(bound(n))
    some = np.flatnonzero(df > 1)
    if len(some) < need:
        return low[:0]
    order = np.lexsort((low[some], df[some]))
    return low[some[order[: len(some) - need + 1]]]


FOUND = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("chosen", pa.list_(pa.int64())), ("anchor", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: What a group gives: a row for each member, one for the group (or each MASK_BITS members of it), and its links.
PACKED = pa.schema([
    ("anchor", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("chosen", pa.list_(pa.int64())),
    ("union", pa.binary()), ("held", pa.binary()), ("members", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("a", pa.int64()), ("b", pa.int64()),
])
GROUP_COLUMNS = ["anchor", "part", "union", "held", "members", "ids", "sizes"]


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=LINKS)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def pack(table: pa.Table, most: int) -> pa.Table:
    """A group's members (and its pivot, if it is a part) as PACKED rows; a group row has at most so many members."""
    part, parts = table.column("part")[0].as_py(), table.column("m")[0].as_py()
    rows = sorted(zip(table.column("pivot").to_pylist(), table.column("key").to_pylist(), table.column("digest").to_pylist(), range(len(table))))
    sets, chosen_ = _read(table), table.column("chosen")
    links = linked([key for _, key, _, _ in rows], [sets[i] for *_, i in rows])
    rows = [(key, i) for pivot, key, _, i in rows if not pivot]
    common, out = {"anchor": table.column("anchor")[0].as_py()}, []
    for sub, start in enumerate(range(0, len(rows), most)):
        own = rows[start : start + most]
        common["part"] = part + parts * sub
        out += [common | {"place": place, "key": key, "n": len(sets[i]), "tokens": sets[i].tobytes(), "chosen": chosen_[i].as_py()} for place, (key, i) in enumerate(own)]
        out.append(common | stored([key for key, _ in own], [sets[i] for _, i in own]))
    return pa.Table.from_pylist(out + [{"a": a, "b": b} for a, b in links], PACKED)


def _read(table: pa.Table, column: str = "tokens") -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column(column).to_pylist()]


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) for every document.

    Two documents link if the Jaccard similarity of their sets is PERCENT/100 or more. Null and blank texts have the
    empty set, link with nothing and are their own component. A null id counts as smaller than all others and makes a
    null component_id. Rows that share an id are one document with several sets; equal rows all have a row. A very long text is
    one set, held by one task at a time. Extra columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ids, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cols = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(NULL_ID)).alias("key"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    names = cut(cols.select("doc_id", "key", "digest", "n_bytes"), "names")
    copies = names.groupBy(F.col("digest").alias("copy_of")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("copy_of", "first")
    copies = cut(copies, "copies")
    total = names.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    kept = cols.join(few_rows(copies, BROADCAST_ROWS), F.col("digest") == F.col("copy_of"), "left").where("first IS NULL OR first = key")

    buckets = pieces(total, BUCKET_BYTES)
    parts = max(shuffles(spark), pieces(total, 8 * BLOCK_BYTES))
    number = F.pmod(F.xxhash64("digest"), F.lit(max(parts, pieces(total, BLOCK_BYTES)))).cast("int")
    blocks = kept.select(number.alias("block"), "key", "digest", "text").repartition(parts, "block")

    def send(table: pa.Table) -> pa.Table:
        tokens, count, at = _prefixes(_sets(table), buckets)
        block = table.column("block")[0].as_py()
        rows = [{"bucket": b, "block": block, "keys": _key_bits(tokens[i:j]).tobytes(), "counts": count[i:j].tobytes()} for b, (i, j) in at.items()]
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint8).reshape(-1, 5) for r in rows]
        wide = np.zeros((sum(map(len, keys)), 8), np.uint8)
        wide[:, :5] = np.concatenate(keys)
        _, of = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        df = np.bincount(of, weights=np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]))
        df = np.minimum(df[of], 65535).astype(np.uint16)
        parts_ = np.split(df, np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_pylist([{"block": r["block"], "bucket": r["bucket"], "df": d.tobytes()} for r, d in zip(rows, parts_)], pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("df", pa.binary())]))

    def prune(table: pa.Table, counts: pa.Table) -> pa.Table:
        sets = _sets(table) if len(table) else []
        all_tokens, _, _ = _prefixes(sets, buckets)
        df = [np.frombuffer(r["df"], np.uint16) for r in sorted(counts.to_pylist(), key=lambda r: r["bucket"])]
        df = np.concatenate(df) if df else np.zeros(0, np.uint16)
        rows = []
        for key, digest, s in sets:
            low = lowest(s) if len(s) else s
            own = df[np.searchsorted(all_tokens, low)]
            few = chosen(s, own) if len(s) else s
            # The most frequent of the low hashes: near copies agree on it, so they meet in one group.
            anchor = int(low.view(np.int64)[np.lexsort((low, own))[-1]]) if len(few) else None
            rows.append({"key": key, "digest": digest, "n": len(s), "tokens": s.tobytes() if len(few) else None, "chosen": few.view(np.int64) if len(few) else None, "anchor": anchor})
        return pa.Table.from_pylist(rows, FOUND)

    sent = blocks.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, counts binary")
    counts = sent.repartition(max(shuffles(spark), buckets), "bucket").groupBy("bucket").applyInArrow(count, "block int, bucket int, df binary")
    found = blocks.groupBy("block").cogroup(counts.repartition(parts, "block").groupBy("block")).applyInArrow(prune, "key long, digest binary, n long, tokens binary, chosen array<long>, anchor long")
    found = cut(found, "sets")

    # Groups by the most frequent low hash; large ones in parts.
    open_ = found.where("tokens IS NOT NULL")
    m = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    large = cut(open_.groupBy("anchor").agg(m.alias("m"), F.min(F.struct("key", "digest")).alias("pivot")).where("m > 1"), "groups")
    dealt = open_.join(few_rows(large.select("anchor", "m"), BROADCAST_ROWS), "anchor", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.select("anchor", F.pmod(F.xxhash64("key", "digest"), "m").cast("int").alias("part"), "m", F.lit(False).alias("pivot"), "key", "digest", "tokens", "chosen")
    pivots = few_rows(large.select(F.col("anchor").alias("g"), "m", "pivot.key", "pivot.digest"), BROADCAST_ROWS).join(open_.select("key", "digest", "tokens"), ["key", "digest"])
    pivots = pivots.select(F.col("g").alias("anchor"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"), "m", F.lit(True).alias("pivot"), "key", "digest", "tokens", F.lit(None).cast("array<long>").alias("chosen"))
    most = MASK_BITS
    packed = cut(dealt.unionByName(pivots).groupBy("anchor", "part").applyInArrow(lambda table: pack(table, most), _ddl(PACKED)), "packed")
    members = packed.where("place IS NOT NULL")

    # A copy's row is not compared, so an id that has other texts too is linked here to the copy's first id.
    several = names.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("key")
    copied = names.join(several, "key").join(copies, F.col("digest") == F.col("copy_of")).where("key <> first").select("key", "first", "digest")
    copied = copied.join(found.where("n > 0").select("digest"), "digest").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    first = cut(packed.where("a IS NOT NULL").select("a", "b").unionByName(copied), "pairs")
    roots = components(first)

    # Hashes held by several components: all members but those of each hash's largest component must ask.
    holders = members.select("anchor", "part", "place", "key", F.explode("chosen").alias("token")).join(roots, F.col("key") == F.col("node"), "left")
    holders = holders.select("token", "anchor", "part", "place", F.coalesce("root", "key").alias("root"))
    mixed = holders.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    masks = [F.expr(f"bit_or(CASE WHEN place div 64 = {i} THEN shiftleft(1L, place % 64) ELSE 0L END)").alias(f"m{i}") for i in range(LONGS)]
    cells = cut(holders.join(mixed, "token").groupBy("token", "anchor", "part", "root").agg(F.count(F.lit(1)).alias("c"), *masks), "cells")
    largest = cells.groupBy("token", "root").agg(F.sum("c").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("x")).select("token", F.col("x.root").alias("largest"))
    any_of = [F.expr(f"bit_or(CASE WHEN root <> largest THEN m{i} ELSE 0L END)").alias(f"m{i}") for i in range(LONGS)]
    matrix = cut(cells.join(largest, "token").groupBy("token", "anchor", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *any_of), "matrix")
    asking = matrix.where(" OR ".join(f"m{i} <> 0" for i in range(LONGS)))
    asking = asking.select("token", F.col("anchor").alias("own"), F.col("part").alias("own_part"), F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"), *(f"m{i}" for i in range(LONGS)))
    # A member's own group has been compared; groups that hold the hash in one and the same component need not be.
    other = "NOT (anchor = own AND part = own_part) AND NOT (lo = hi AND own_lo = own_hi AND lo = own_lo)"
    asked = asking.join(matrix.select("token", "anchor", "part", "lo", "hi"), "token").where(other)
    asked = asked.groupBy("own", "own_part", "anchor", "part").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(LONGS)))
    places = F.expr(f"filter(sequence(0, {MASK_BITS - 1}), p -> bit_get(element_at(array({', '.join(f'm{i}' for i in range(LONGS))}), cast(p div 64 AS int) + 1), p % 64) = 1)")
    asked = asked.select(F.col("anchor").alias("q_anchor"), F.col("part").alias("q_part"), F.col("own").alias("anchor"), F.col("own_part").alias("part"), F.explode(places).alias("place"))
    asked = cut(asked.join(members.select("anchor", "part", "place", "key", "n"), ["anchor", "part", "place"]), "asked")
    slices = F.greatest(F.ceil(F.count(F.lit(1)) / SLICE), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    targets = cut(asked.groupBy("q_anchor", "q_part").agg(slices.alias("slices")), "targets")
    queries = asked.drop("n").join(few_rows(targets, BROADCAST_ROWS), ["q_anchor", "q_part"]).join(members.select("anchor", "part", "place", "tokens"), ["anchor", "part", "place"])
    queries = queries.select("q_anchor", "q_part", F.pmod(F.xxhash64("anchor", "part", "place"), "slices").cast("int").alias("slice"), "key", "tokens")
    groups = packed.where("union IS NOT NULL").select(*GROUP_COLUMNS).join(targets, (F.col("anchor") == F.col("q_anchor")) & (F.col("part") == F.col("q_part")))
    groups = groups.select(*GROUP_COLUMNS, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def open_group(group: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(group) or not len(asks):
            return _links([])
        return _links(opened(group.select(GROUP_COLUMNS).to_pylist()[0], list(zip(asks.column("key").to_pylist(), _read(asks)))))

    second = cut(groups.groupBy("anchor", "part", "slice").cogroup(queries.groupBy("q_anchor", "q_part", "slice")).applyInArrow(open_group, "a long, b long"), "pairs")
    if second.limit(1).count():
        old, roots = roots, components(first.unionByName(second))
        drop(old)
    drop(copies, large, packed, first, cells, matrix, asked, targets, second)
    by_text = found.join(roots, F.col("key") == F.col("node"), "left").select("digest", F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("root"))
    out = names.join(by_text, "digest")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.nullif("root", F.lit(NULL_ID)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op3_group_matrix(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """DuckDB SQL for op3_group_matrix: all pairs that share a shingle, then everything that links reach."""
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS j FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT way.b, reach.root FROM reach JOIN way ON way.a = reach.node)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id"""


def brute(docs: list[tuple]) -> list[tuple]:
    """For tests: the same rows by comparing all pairs of shingle sets."""
    def cut_up(text):
        w = words_in(text)
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    sets = [cut_up(t) for _, t in docs]
    key = [NULL_ID if i is None else i for i, _ in docs]
    label = dict(zip(key, key))
    pairs = [(key[i], key[j]) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= PERCENT * len(sets[i] | sets[j])]
    while True:
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return [(i, len(s), i if not s else None if label[k] == NULL_ID else label[k]) for (i, _), s, k in zip(docs, sets, key)]
