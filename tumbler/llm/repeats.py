"""Removal of long repeats by longest-previous-factor arrays over a partitioned suffix order.

A string of LENGTH bytes holds at least one anchor: a k-gram whose hash is the smallest of the
string's k-grams. Equal strings have equal anchors at equal places, so suffixes can be dealt out by
anchor, and each part sorted by itself. Three passes over blocks of documents:

1. each block sends its distinct anchor hashes to buckets; those in one block or document only are dropped;
2. the rest send their context, all bytes that a string around the anchor may cover; each bucket sorts the
   suffixes of its distinct contexts and works out their longest-previous-factor array in document order, from the
   previous and next smaller positions in suffix order and the prefixes that neighbours share;
3. each block marks the strings whose factor reaches LENGTH and cuts out the bytes they cover.

Documents are dealt to blocks once; the passes read the same exchange. Buckets are ranges of a second hash of the
anchor: the first is a minimum, so it crowds at the low end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import bucket_slices, cut, pieces, shuffles

LENGTH, K = 50, 25
LEFT = LENGTH - K  # bytes of context before an anchor; LENGTH bytes from it on
WIDE = LEFT + LENGTH + 2
BLOCK_BYTES, BUCKET_BYTES, CHUNK = 2 << 20, 4 << 20, 1 << 19
#: Suffixes sorted at once (more only if one anchor has more).
SUFFIXES = 400_000
#: Copies of whole texts are found by a join that is broadcast up to so many distinct repeated texts (64 bytes each).
BROADCAST_ROWS = 200_000
NULL_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()

_TABLE = np.random.default_rng(6).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the K = 25 bytes from each place on (fewer entries than bytes by K - 1)."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    one = _TABLE[raw]
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    n = len(raw) - K + 1
    h = (sixteen[:n] * power(8) + eight[16 : 16 + n]) * power(1) + one[24 : 24 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def second_hash(h: np.ndarray) -> np.ndarray:
    """A one-to-one remix of 64 bits."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(27)


def slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` neighbours."""
    have = 1
    n = len(x) - width + 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[:n], x[width - have : width - have + n])


class Block:
    """The anchors of a block of documents, in document order."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.order, self.texts = order, [texts[i] for i in order]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        pad = np.zeros(LEFT + LENGTH, np.uint8)
        self.raw = np.concatenate([pad[:LEFT], np.frombuffer(b"".join(self.texts), np.uint8), pad[:LENGTH]])
        found = [self._anchors(a, min(a + CHUNK, int(lengths.sum()))) for a in range(0, int(lengths.sum()), CHUNK)]
        self.at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        self.hash = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.ids = np.array([ids[i] for i in order], np.int64)

    def _anchors(self, a: int, b: int):
        """Places in [a, b) whose k-gram is the smallest of some whole string in its document, and their hashes.

        Works on the bytes that such strings may cover, so a block's arrays stay small however long its texts are.
        """
        low, high = max(0, a - LEFT), min(int(self.ends[-1]), b + LEFT)
        place = np.arange(low, high)
        left = self.ends[np.searchsorted(self.ends, place, "right")] - place  # bytes to the document's end
        h = gram_hashes(self.raw[LEFT + low : LEFT + high + K - 1])
        h = np.where(left >= K, h, np.uint64(2**64 - 1))
        least = slide(np.concatenate([h, np.full(LEFT, 2**64 - 1, np.uint64)]), LEFT + 1, np.minimum)
        least = np.where(left >= LENGTH, least, np.uint64(0))
        most = slide(np.concatenate([np.zeros(LEFT, np.uint64), least]), LEFT + 1, np.maximum)
        own = slice(a - low, b - low)
        at = np.flatnonzero((most[own] == h[own]) & (most[own] > 0) & (left[own] >= K))
        return at + a, second_hash(h[own][at])

    def distinct(self, buckets: int):
        """Sorted distinct hashes, which of them stand in two documents here, and each bucket's part of them."""
        if not len(self.hash):
            return self.hash, np.zeros(0, bool), {}
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.doc[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        return h[at], several, bucket_slices(h[at], buckets)

    def contexts(self, flagged: np.ndarray, buckets: int):
        """Distinct contexts of the anchors whose hash is flagged (a sorted array), by bucket.

        Returns the anchors' numbers, each one's context number, and by context: bytes, first document, each bucket's part.
        """
        use = np.flatnonzero(np.isin(self.hash, flagged, assume_unique=False))
        at, doc = self.at[use], self.doc[use]
        before = np.minimum(LEFT, at - self.starts[doc])
        after = np.minimum(LENGTH, self.ends[doc] - at)
        place = np.arange(-LEFT, LENGTH)
        wide = np.zeros((len(use), WIDE), np.uint8)
        wide[:, :-2] = np.lib.stride_tricks.sliding_window_view(self.raw, LEFT + LENGTH)[at]
        edge = np.flatnonzero((before < LEFT) | (after < LENGTH))
        inside = (place >= -before[edge, None]) & (place < after[edge, None])
        wide[edge, :-2] *= inside
        wide[:, -2], wide[:, -1] = before, after
        _, first, of = np.unique(wide.view(f"V{WIDE}").ravel(), return_index=True, return_inverse=True)
        by = np.lexsort((first, self.hash[use][first]))  # by hash, so by bucket; then as they come
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = first[by]
        return use, rank[of.ravel()], wide[first], doc[first], bucket_slices(self.hash[use][first], buckets)


def key_bits(h: np.ndarray) -> np.ndarray:
    """Five bytes of each hash; with the bucket's number enough to tell them apart. Equal ones only cost a context."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 1:6])


def repeated(keys: list[np.ndarray], several: list[np.ndarray]) -> list[np.ndarray]:
    """For each block's distinct keys: which stand in another block too or in several documents of their own."""
    wide = np.zeros((sum(map(len, keys)), 8), np.uint8)
    wide[:, :5] = np.concatenate(keys)
    _, of, n = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    flags = (n[of] > 1) | np.concatenate(several)
    return np.split(flags, np.cumsum([len(k) for k in keys])[:-1])


def shared_prefixes(words: np.ndarray) -> np.ndarray:
    """For each row but the first of sorted suffixes (big-endian words of eight bytes): the bytes it shares with the one
    before it. The first shares 0."""
    if not len(words):
        return np.zeros(0, np.int64)
    differ = words[1:] ^ words[:-1]
    first = np.argmax(differ != 0, axis=1)
    x = differ[np.arange(len(differ)), first]
    zeros = np.full(len(x), 8, np.int64)  # leading zero bytes of the first differing word
    for n in range(7, -1, -1):
        zeros[x >> np.uint64(8 * (7 - n)) != 0] = n
    shared = np.where(x == 0, 8 * words.shape[1], 8 * first + zeros)
    return np.concatenate([[0], np.minimum(shared, LENGTH)])


def longest_previous(shared: np.ndarray, docs: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: the longest prefix that each shares with a suffix of a
    document with a smaller id; exact where it is at least `least`, else some smaller number.

    It is shared with the previous or the next smaller position. Those are found by following all suffixes' candidates at
    once: what lies between a suffix and its candidate has no smaller document. A chain ends where less than `least` is shared.
    """
    n, best = len(docs), np.zeros(len(docs), np.int64)
    for way in (1, -1):
        d, link = (docs, shared) if way > 0 else (docs[::-1], np.concatenate([[0], shared[:0:-1]]))
        to, common = np.arange(n) - 1, link.astype(np.int64)
        open_ = np.flatnonzero((to >= 0) & (common >= least))
        found = np.zeros(n, np.int64)
        while len(open_):
            smaller = d[to[open_]] < d[open_]
            found[open_[smaller]] = common[open_[smaller]]
            open_ = open_[~smaller]
            # The candidate's own candidate is next; the tables are read before they are written.
            over = to[open_]
            reach, new = np.minimum(common[open_], common[over]), to[over]
            common[open_], to[open_] = reach, new
            open_ = open_[(new >= 0) & (reach >= least)]
        best = np.maximum(best, found if way > 0 else found[::-1])
    return best


def previous_factors(wide: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context, bit o: its string starting o bytes before the anchor occurs in a document with a smaller id.

    Equal contexts are one to begin with. Of the rest, only those that share their anchor with another can share a
    string. Their suffixes (o bytes before the anchor on, LENGTH bytes) are sorted, and bit o is set where the
    suffix's longest previous factor reaches LENGTH. Suffixes of different o differ in where the anchor stands; that they
    are in one order does no harm.
    """
    if not len(wide):
        return np.zeros(0, np.uint32)
    before, after = wide[:, -2].astype(np.int64), wide[:, -1].astype(np.int64)
    offsets = np.arange(LEFT + 1)
    valid = (offsets <= before[:, None]) & (LENGTH - offsets <= after[:, None])
    full = (valid.astype(np.uint32) << offsets.astype(np.uint32)).sum(1, dtype=np.uint32)
    order = np.lexsort((docs,))
    _, first, of = np.unique(wide[order].view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    own = order[first]  # of equal contexts, the one of the smallest id
    group = np.empty(len(wide), np.int64)
    group[order] = of.ravel()
    out = np.where(docs > docs[own][group], full, np.uint32(0))
    # Distinct contexts that share an anchor.
    _, anchor, n = np.unique(np.ascontiguousarray(wide[own][:, LEFT : LEFT + K]).view(f"V{K}").ravel(), return_inverse=True, return_counts=True)
    some = own[n[anchor.ravel()] > 1]
    bits = np.zeros(len(wide), np.uint32)
    anchor = anchor.ravel()[n[anchor.ravel()] > 1]
    by = np.argsort(anchor, kind="stable")
    some, anchor = some[by], anchor[by]
    ends = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1 if len(some) else []
    start = 0
    while start < len(some):
        # Whole anchors, as many as fit.
        end = int(ends[max(np.searchsorted(ends, start + SUFFIXES // len(offsets), "right") - 1, np.searchsorted(ends, start, "right"))])
        part, start = some[start:end], end
        row, o = np.nonzero(valid[part])
        suffix = np.zeros((len(row), 56), np.uint8)
        for x in offsets:
            mine = o == x
            suffix[mine, :LENGTH] = wide[part[row[mine]], LEFT - x : LEFT - x + LENGTH]
        words = suffix.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        words, doc = words[order], docs[part[row]][order]
        repeats = order[longest_previous(shared_prefixes(words), doc) >= LENGTH]
        np.bitwise_or.at(bits, part[row[repeats]], np.uint32(1) << o[repeats].astype(np.uint32))
    # A context equal to an earlier one has all its bits; the first of its kind has what its factors say.
    return out | bits


def marked(block: Block, flagged: np.ndarray, masks: np.ndarray, buckets: int) -> np.ndarray:
    """Which bytes of the block are covered by a string that occurs earlier."""
    n = len(block.raw) - LEFT - LENGTH
    edge = np.zeros(n + LENGTH + 1, np.int32)
    use, of, wide, first, _ = block.contexts(flagged, buckets)
    before, after = wide[:, -2].astype(np.int64), wide[:, -1].astype(np.int64)
    at, own = block.at[use], masks[of]
    repeats = block.ids[block.doc[use]] > block.ids[first][of]
    start = np.zeros(n + 1, bool)
    for o in range(LEFT + 1):
        ok = (own >> np.uint32(o) & np.uint32(1)).astype(bool) | repeats & (o <= before[of]) & (LENGTH - o <= after[of])
        start[at[ok] - o] = True
    hits = np.flatnonzero(start)
    edge[hits] += 1
    edge[hits + LENGTH] -= 1
    return np.cumsum(edge)[:n] > 0


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _block(table: pa.Table) -> Block:
    return Block(table.column("key").to_pylist(), [t.encode() for t in table.column("text").to_pylist()])


def _join(rows: list[dict], block: Block, buckets: int) -> tuple[np.ndarray, list[int]]:
    """The flagged hashes named by the rows' bitmaps."""
    hashes, _, at = block.distinct(buckets)
    flags = np.zeros(len(hashes), bool)
    for r in rows:
        a, b = at[r["bucket"]]
        flags[a:b] = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=b - a).astype(bool)
    return hashes[flags], at


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, null unless keep_bytes) per document.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id; this
    is judged on the input. Null texts are empty. A null id is smaller than all others. Rows with one id never
    remove each other's bytes; equal rows all have a row. Very long texts are worked on in chunks of CHUNK bytes. Extra columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    cols = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(NULL_ID)).alias("key"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # Whole copies: all of their bytes stand in the first one. Counted in each task first, so a hot text is one row a task.
    copies = cols.where(F.col("n_bytes") >= LENGTH).groupBy(F.col("digest").alias("copy_of")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("copy_of", "first")
    copies = cut(copies, "copies")
    total, most = cols.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.max("n_bytes"), F.lit(0))).first()
    side = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    known = cols.join(side, F.col("digest") == F.col("copy_of"), "left").select("doc_id", "key", "text", "n_bytes", (F.col("first").isNotNull() & (F.col("key") > F.col("first")) & (F.col("n_bytes") >= LENGTH)).alias("copy"))
    gone = known.where("copy").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY).alias("kept_sha256"), (F.lit(b"") if keep_bytes else F.lit(None).cast("binary")).alias("kept"))

    buckets = pieces(total, BUCKET_BYTES)
    parts = max(shuffles(spark), pieces(total, 8 * BLOCK_BYTES))
    number = F.pmod(F.xxhash64("key", "n_bytes"), F.lit(max(parts, pieces(total, BLOCK_BYTES)))).cast("int")
    blocks = known.where(~F.col("copy")).select(number.alias("block"), "doc_id", "key", "text", "n_bytes").repartition(parts, "block")

    def send_hashes(table: pa.Table) -> pa.Table:
        hashes, several, at = _block(table).distinct(buckets)
        block = table.column("block")[0].as_py()
        rows = [{"bucket": b, "block": block, "keys": key_bits(hashes[i:j]).tobytes(), "several": _bits(several[i:j])} for b, (i, j) in at.items()]
        return _table(rows, "bucket int, block int, keys binary, several binary")

    def compare_hashes(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint8).reshape(-1, 5) for r in rows]
        several = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys)]
        flags = repeated(keys, several)
        return _table([{"block": r["block"], "bucket": r["bucket"], "flags": _bits(f)} for r, f in zip(rows, flags) if f.any()], "block int, bucket int, flags binary")

    def send_contexts(docs_: pa.Table, flags: pa.Table) -> pa.Table:
        rows = flags.to_pylist()
        if not len(docs_) or not rows:
            return _table([], "bucket int, block int, flags binary, wide binary, docs binary")
        block = _block(docs_)
        flagged, _ = _join(rows, block, buckets)
        _, _, wide, first, at = block.contexts(flagged, buckets)
        ids = block.ids[first]
        parts_ = [(r, slice(*at.get(r["bucket"], (0, 0)))) for r in rows]
        out = [{"bucket": r["bucket"], "block": r["block"], "flags": r["flags"], "wide": wide[x].tobytes(), "docs": ids[x].tobytes()} for r, x in parts_]
        return _table(out, "bucket int, block int, flags binary, wide binary, docs binary")

    def compare_contexts(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        wide = np.concatenate([np.frombuffer(r["wide"], np.uint8).reshape(-1, WIDE) for r in rows])
        ids = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
        masks = np.split(previous_factors(wide, ids), np.cumsum([len(r["docs"]) // 8 for r in rows])[:-1])
        return _table([{"block": r["block"], "bucket": r["bucket"], "flags": r["flags"], "masks": m.tobytes()} for r, m in zip(rows, masks)], "block int, bucket int, flags binary, masks binary")

    def cut_out(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs_):
            return _table([], RESULT)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        block = _block(docs_)
        gone = np.zeros(len(block.raw) - LEFT - LENGTH, bool)
        if rows:
            flagged, _ = _join(rows, block, buckets)
            gone = marked(block, flagged, np.concatenate([np.frombuffer(r["masks"], np.uint32) for r in rows]), buckets)
        ids, out = docs_.column("doc_id").to_pylist(), []
        for i, t, a, b in zip(block.order, block.texts, block.starts, block.ends):
            mine = gone[a:b]
            n = int(mine.sum())
            kept = np.frombuffer(t, np.uint8)[~mine].tobytes() if n else t
            out.append({"doc_id": ids[i], "n_bytes": len(t), "n_removed": n, "n_spans": int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if keep_bytes else None})
        return _table(out, RESULT)

    sent = blocks.groupBy("block").applyInArrow(send_hashes, "bucket int, block int, keys binary, several binary")
    flags = sent.repartition(max(shuffles(spark), buckets), "bucket").groupBy("bucket").applyInArrow(compare_hashes, "block int, bucket int, flags binary")
    sent = blocks.groupBy("block").cogroup(flags.repartition(parts, "block").groupBy("block")).applyInArrow(send_contexts, "bucket int, block int, flags binary, wide binary, docs binary")
    answers = sent.repartition(max(shuffles(spark), buckets), "bucket").groupBy("bucket").applyInArrow(compare_contexts, "block int, bucket int, flags binary, masks binary")
    left = blocks.groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(cut_out, RESULT)
    return left.unionByName(gone)


def op6_previous_factors(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def brute(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """For tests: the same rows by a table of every string's smallest id."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    first: dict[bytes, int] = {}
    key = lambda i: NULL_ID if i is None else i
    for i, t in raw:
        for q in range(len(t) - length + 1):
            s = t[q : q + length]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in raw:
        gone = [False] * len(t)
        for q in range(len(t) - length + 1):
            if first[t[q : q + length]] < key(i):
                gone[q : q + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
