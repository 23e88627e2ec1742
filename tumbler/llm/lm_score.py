"""Language-model scores by prediction by partial matching (PPM) over byte contexts.

Training counts every byte with its ORDER bytes before it. A shorter context counts the
distinct longer ones in which a byte follows, so the context trie is a set of sorted arrays, one per depth. A byte that a
context has not seen escapes to the next shorter one, with the bytes already tried excluded
(symbol exclusion); escapes are estimated by method D (half a count for each distinct byte).
Beside it, a word unigram gives a base score.

The model is never in one place. Grams are dealt to buckets by the SHARED bytes before the last one, so a bucket holds
all contexts of that length and longer that its grams need; contexts that are shorter have at most 256 ** SHARED codes and are
broadcast. Blocks of documents send each bucket their distinct grams and words in one packed row, which comes back with the values.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, intermediate, pieces, shuffles

ORDER = 5
#: Bytes before the last one that grams are dealt by: at most 256 ** 3 grams of order 5 share them, and as many shorter
#: codes are broadcast (16 bytes each).
SHARED = 3
#: Text bytes for each bucket of the model.
BUCKET_BYTES = 512 << 20
#: Blocks that ask one copy of a bucket; with more blocks there are more copies.
ASKERS = 10_000
#: Grams that a bucket looks up at once.
LOOKUP = 1 << 20
#: Text bytes that a task counts or scores at once.
CHUNK = 4 << 20
#: Grams or words that a task counts before it gives their counts.
TALLY = 1_500_000
#: Text bytes of a block, whose documents and vocabulary one task holds.
BLOCK_BYTES = 32 << 20


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.lower() touches A-Z only, and bytes.split() parts at ASCII white space."""
    return (text or "").encode().lower().split()


def byte_windows(raw: np.ndarray, width: int) -> np.ndarray:
    """The number that `width` bytes (1..7) from each place on make up, big end first."""
    two = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    out, at = np.zeros(max(0, len(raw) - width + 1), np.int64), 0
    for size, block in ((4, four), (2, two), (1, raw)):
        if width & size:
            out <<= 8 * size
            out |= block[at : at + len(out)]
            at += size
    return out


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte with the `order` bytes before it, and where each text's codes begin.

    A text is its words joined by blanks and ends with a line feed, which no word holds; before it stand
    line feeds.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(b"\n" * order + t + b"\n" for t in texts), np.uint8)
    code = byte_windows(raw, order + 1)
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths + order)
    real = np.ones(len(raw), bool)
    for j in range(order):
        real[ends - lengths - order + j] = False
    return code[real[order:]], np.cumsum(lengths) - lengths


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values, at)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin in a sorted array, and how long they are."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return first, np.diff(first, append=len(keys))


def by_gram(texts: list[bytes], log10, order: int) -> np.ndarray:
    """The sum over each text's codes of log10, which gets distinct sorted codes.

    Codes are sorted with their text's number in the bits that they leave free; only if there are more texts than
    fit there are they numbered by hashing. Sorted codes are found much faster in a model.
    """
    if not len(texts):
        return np.zeros(0)
    codes, begins = grams(texts, order)
    free = 64 - 8 * (order + 1)
    if len(texts) > 1 << max(0, free):
        places, distinct = pd.factorize(codes)
        by = np.argsort(distinct)
        value = np.empty(len(distinct))
        value[by] = log10(distinct[by])
        return np.add.reduceat(value[places], begins)
    keys = codes.astype(np.uint64) << np.uint64(free) | np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begins, append=len(codes)))
    keys.sort()
    codes = (keys >> np.uint64(free)).astype(np.int64)
    first, n = runs(codes)
    text = (keys & np.uint64((1 << free) - 1)).astype(np.int64)
    return np.bincount(text, weights=np.repeat(log10(codes[first]), n), minlength=len(texts))


class Ppm:
    """codes: distinct (order + 1)-byte codes; counts: how often each was seen. A shorter model, where given, has the
    contexts up to its own order; then codes may be those of some contexts of the next length only."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER, shorter: Ppm | None = None):
        self.order, self.depths = order, []
        for j in range(order, shorter.order if shorter else -1, -1):
            # Update exclusion: a shorter context counts the distinct longer ones that a byte was seen in.
            codes, counts = sums(codes & ((1 << 8 * (j + 1)) - 1), counts.astype(np.int64) if j == order else np.ones(len(codes), np.int64))
            contexts, n = sums(codes >> 8, counts)
            _, distinct = sums(codes >> 8, np.ones(len(codes), np.int64))
            self.depths.append({"codes": codes, "counts": counts, "contexts": contexts, "n": n, "distinct": distinct})
        new = len(self.depths)
        self.depths += shorter.depths if shorter else []
        # What a context excludes one depth shorter: the counts there of the bytes it has seen.
        for i in range(min(new, order)):
            longer, next_, j = self.depths[i], self.depths[i + 1], order - i
            at = find(next_["codes"], longer["codes"] & ((1 << 8 * j) - 1))
            longer["excluded"] = sums(longer["codes"] >> 8, next_["counts"][at])[1] if len(at) else np.zeros(0, np.int64)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the bytes before it."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        excluded, tried = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for i, depth in enumerate(self.depths):
            code = codes[open_] & ((1 << 8 * (self.order - i + 1)) - 1)
            context = find(depth["contexts"], code >> 8)
            known = context >= 0
            n = np.where(known, depth["n"][context] if len(depth["n"]) else 0, 0) - excluded[open_]
            fresh = np.where(known, depth["distinct"][context] if len(depth["n"]) else 0, 0) - tried[open_]
            at = find(depth["codes"], code)
            hit = at >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                if hit.any():
                    out[open_[hit]] += np.log10((depth["counts"][at[hit]] - 0.5) / n[hit])
                escape = ~hit & known & (n > 0)
                out[open_[escape]] += np.log10(0.5 * fresh[escape] / n[escape])
            tried[open_[known]] = depth["distinct"][context[known]]
            excluded[open_[known]] = depth["excluded"][context[known]] if "excluded" in depth else 0
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(1, 256 - tried[open_]))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return by_gram(texts, self.log10, self.order)


def _chunks(batches):
    """(ids, token lists) of about CHUNK characters each."""
    ids, words, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            ids.append(doc_id)
            words.append(tokens(text))
            n += len(text or "")
            if n >= CHUNK:
                yield ids, words
                ids, words, n = [], [], 0
    if ids:
        yield ids, words


def as_bytes(words: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(w) for w in words]


def flat(words: list[list[bytes]]) -> pa.Array:
    """All words of a chunk one after the other."""
    return pa.array(list(chain.from_iterable(words)), pa.binary())


def pack(numbers: np.ndarray) -> bytes:
    """Integers from 0 on in few bytes: their used byte planes, compressed."""
    if not len(numbers):
        return b""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[5:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def pack_sorted(codes: np.ndarray) -> bytes:
    return pack(np.diff(codes, prepend=0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def pack_values(values: np.ndarray) -> bytes:
    """Floating-point numbers, of which many are equal."""
    distinct, at = np.unique(values, return_inverse=True)
    body = pack(at)
    return len(body).to_bytes(4, "little") + body + distinct.tobytes()


def unpack_values(raw: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw[n:], np.float64)[unpack(raw[4:n])]


def pack_words(words: list[bytes]) -> bytes:
    """Words, which hold no line feed and are not empty."""
    raw = b"\n".join(words)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if words else b""


def unpack_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True).split(b"\n") if raw else []


def shares(codes: np.ndarray, words: list[bytes], buckets: int, order: int) -> dict[int, tuple[np.ndarray, list[bytes]]]:
    """bucket -> (places of its codes, its words), both in the order given."""
    context = (codes >> 8 & ((1 << 8 * min(SHARED, order)) - 1)).astype(np.uint64)
    of = ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    places = np.argsort(of, kind="stable")
    of = of[places]
    first, n = runs(of)
    out = {b: (places[i : i + m], []) for b, i, m in zip(of[first].tolist(), first.tolist(), n.tolist())}
    for word in words:
        out.setdefault(zlib.crc32(word) % buckets, (places[:0], []))[1].append(word)
    return out


def table_of(columns: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(columns), types)], names=columns)


COUNTS = ["bucket", "grams", "counts", "words", "tallies", "texts"]
COUNT_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]


class Tally:
    """Counts of grams and words over a task's chunks, in bounded memory."""

    def __init__(self, order: int):
        self.order, self.words, self.codes, self.n, self.texts = order, [], [], 0, 0

    def count(self, codes: np.ndarray, counts: np.ndarray, words: pa.Table, texts: int) -> bool:
        """Takes counts (word, n); True if it is time to give them."""
        self.codes.append((codes, counts))
        self.words.append(words)
        self.texts += texts
        self.n += len(codes) + len(words)
        return self.n >= TALLY

    def add(self, words: list[list[bytes]]) -> bool:
        codes = grams(as_bytes(words), self.order)[0]
        codes.sort()
        first, n = runs(codes)
        counted = pc.value_counts(flat(words))
        return self.count(codes[first], n, pa.table({"word": counted.field("values"), "n": counted.field("counts")}), len(words))

    def squeeze(self) -> None:
        """Sums what was taken so far."""
        codes, counts = sums(*(np.concatenate(x) for x in zip(*self.codes)))
        words = pa.concat_tables(self.words).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        self.codes, self.words, self.n = [(codes, counts)], [words], len(codes) + len(words)

    def give(self, buckets: int) -> pa.RecordBatch:
        """A row for each bucket."""
        self.squeeze()
        (codes, counts), words = self.codes[0], self.words[0].sort_by("word")
        n = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist()))
        rows = [
            (b, pack_sorted(codes[at]), pack(counts[at]), pack_words(mine), pack(np.array([n[w] for w in mine], np.int64)), 0)
            for b, (at, mine) in shares(codes, list(n), buckets, self.order).items()
        ]
        rows[0] = (*rows[0][:5], self.texts)
        self.words, self.codes, self.n, self.texts = [], [], 0, 0
        return table_of(COUNTS, COUNT_TYPES, rows)


def train(docs: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """The model, a row for each bucket: its grams and words in order and how often each was seen, packed; n_words (sum of
    the words' counts), distinct_words, and texts, whose sum over buckets counts the texts.

    Reads doc_id and text (the first two columns). Each task sums its chunks before anything is shuffled, and gives what it
    has whenever that reaches TALLY grams or words. What a bucket gets is summed as it comes in.
    """

    def run(batches):
        tally = Tally(order)
        for _, words in _chunks(batches):
            if tally.add(words):
                yield tally.give(buckets)
        if tally.n:
            yield tally.give(buckets)

    def whole(bucket: int, tally: Tally) -> pa.RecordBatch:
        tally.squeeze()
        (codes, counts), words = tally.codes[0], tally.words[0].sort_by("word")
        n = words.column("n").to_numpy()
        row = (bucket, pack_sorted(codes), pack(counts), pack_words(words.column("word").to_pylist()), pack(n), tally.texts, int(n.sum()), len(n))
        return table_of([*COUNTS, "n_words", "distinct_words"], [*COUNT_TYPES, pa.int64(), pa.int64()], [row])

    def merge(batches):
        of, tally, settled = None, Tally(order), 0
        for batch in batches:
            for bucket, codes, counts, words, tallies, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != of:
                    if of is not None:
                        yield whole(of, tally)
                    of, tally, settled = bucket, Tally(order), 0
                words = pa.table({"word": pa.array(unpack_words(words), pa.binary()), "n": pa.array(unpack(tallies), pa.int64())})
                tally.count(unpack_sorted(codes), unpack(counts), words, texts)
                if tally.n > 2 * settled + TALLY:
                    tally.squeeze()
                    settled = tally.n
        if of is not None:
            yield whole(of, tally)

    schema = "bucket int, grams binary, counts binary, words binary, tallies binary, texts long"
    parts = docs.mapInArrow(run, schema).repartition(shuffles(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(merge, schema + ", n_words long, distinct_words long")


def short_model(model: DataFrame, order: int = ORDER) -> Ppm:
    """The part of the model with contexts of fewer than SHARED bytes (or the order, if that is smaller), from sums over buckets."""
    width = min(SHARED, order)

    def suffixes(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                codes = np.unique(unpack_sorted(raw) & ((1 << 8 * (width + 1)) - 1)) & ((1 << 8 * width) - 1)
                codes, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    table = model.select("grams").mapInArrow(suffixes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    return Ppm(table.column("code").to_numpy(), table.column("n").to_numpy(), width - 1)


def distinct(batches, order: int) -> tuple[np.ndarray, list[bytes]]:
    """The distinct grams and words of a block, in order."""
    found, words = [np.zeros(0, np.int64)], [pa.array([], pa.binary())]
    for _, chunk in _chunks(batches):
        codes = grams(as_bytes(chunk), order)[0]
        codes.sort()
        found.append(codes[runs(codes)[0]])
        words.append(flat(chunk).unique())
    codes = np.sort(np.concatenate(found))
    return codes[runs(codes)[0]], sorted(pa.concat_arrays(words).unique().to_pylist())


def answers(model: DataFrame, asked: DataFrame, copies: int, short, order: int = ORDER) -> DataFrame:
    """Each (block, bucket) row of asked, with its grams and words, their log10 probabilities (values) and counts.

    A bucket's model row comes first and stays in memory while the blocks that ask it pass by.
    """

    def answer(batches):
        of, deep, n = None, None, {}
        for batch in batches:
            held, size, out = [], 0, []

            def flush():
                values = deep.log10(np.concatenate([codes for _, _, _, codes in held]))
                ends = np.cumsum([len(codes) for _, _, _, codes in held])
                for (block, asked, words, codes), end in zip(held, ends.tolist()):
                    out.append((block, asked, pack_values(values[end - len(codes) : end]), words, pack(np.array([n.get(w, 0) for w in unpack_words(words)], np.int64))))
                held.clear()

            for block, bucket, copy, codes, counts, words, tallies in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, copy) != of:
                    if held:
                        flush()
                    seen = block < 0
                    of, size = (bucket, copy), 0
                    deep = Ppm(unpack_sorted(codes if seen else b""), unpack(counts if seen else b""), order, short.value)
                    n = dict(zip(unpack_words(words), unpack(tallies).tolist())) if seen else {}
                if block >= 0:
                    held.append((block, codes, words, unpack_sorted(codes)))
                    size += len(held[-1][3])
                    if size >= LOOKUP:
                        flush()
                        size = 0
            if held:
                flush()
            yield table_of(["block", "grams", "values", "words", "counts"], [pa.int64(), *[pa.binary()] * 4], out)

    told = model.select(F.lit(-1).cast("long").alias("block"), "bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "grams", "counts", "words", "tallies")
    none = F.lit(None).cast("binary")
    asks = asked.select("block", "bucket", (F.col("block") % copies).cast("int").alias("copy"), "grams", none.alias("counts"), "words", none.alias("tallies"))
    met = told.unionByName(asks).repartition(shuffles(model.sparkSession), "bucket", "copy").sortWithinPartitions("bucket", "copy", "block")
    return met.mapInArrow(answer, "block long, grams binary, values binary, words binary, counts binary")


def block_count(n_bytes: int, parts: int) -> int:
    return max(2 * parts, pieces(n_bytes, BLOCK_BYTES))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) for every document.

    Learns from the documents whose crc32(id as text) mod 5 is not `fold`. A text is its words (A-Z lower-cased)
    and an end; null and blank texts have the end only. A null id hashes like an empty text. Repeated rows count
    as often as they occur. With nothing to learn from, base_score is 0 and score is uniform over bytes.
    Extra columns are not read; an empty table gives no rows. A very long text is a chunk of its own.

    Nothing that grows with the corpus is broadcast or collected: documents are dealt to blocks, each block asks the buckets of
    the model for its distinct grams and words, and the answers are grouped with the block's documents. The order is at least 1.
    """
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`").cast("long")
    cols = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == fold).alias("held_out"))
    parts = shuffles(spark)
    n_bytes = cols.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(2 * parts, pieces(n_bytes, BUCKET_BYTES))
    model = cut(train(cols.where(~F.col("held_out")), buckets, order), "lm")
    texts, total, words = model.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("texts", "n_words", "distinct_words"))).first()
    total, room = total + texts, total + texts + 0.5 * (words + (texts > 0) + 1)
    short = spark.sparkContext.broadcast(short_model(model, order))
    n_blocks = block_count(n_bytes, parts)
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.substring("text", 1, 64).cast("binary"))), F.lit(n_blocks))
    blocks = cols.withColumn("block", block).repartition(parts, "block")

    def ask(table: pa.Table) -> pa.Table:
        codes, words = distinct(table.select(["doc_id", "text"]).to_batches(), order)
        block = table.column("block")[0].as_py()
        rows = [(block, b, pack_sorted(codes[at]), pack_words(mine)) for b, (at, mine) in shares(codes, words, buckets, order).items()]
        return pa.Table.from_batches([table_of(["block", "bucket", "grams", "words"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)])

    asked = blocks.groupBy("block").applyInArrow(ask, "block long, bucket int, grams binary, words binary")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        texts_ = left.select(["doc_id", "text"])
        codes, values, seen = [], [], {}
        for grams_, values_, words, counts in zip(*(right.column(c).to_pylist() for c in ("grams", "values", "words", "counts"))):
            codes.append(unpack_sorted(grams_))
            values.append(unpack_values(values_))
            seen.update(zip(unpack_words(words), unpack(counts).tolist()))
        codes, values = np.concatenate(codes), np.concatenate(values)
        by = np.argsort(codes)
        codes, values = codes[by], values[by]
        out = {"base": [], "known": [], "n": [], "score": []}
        for _, words in _chunks(texts_.to_batches()):
            n = np.array([len(w) + 1 for w in words])
            count = np.full(n.sum(), texts)
            inner = np.ones(len(count), bool)
            inner[np.cumsum(n) - 1] = False  # where the ends stand
            coded = flat(words).dictionary_encode()
            count[inner] = np.array([seen[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            begins = np.cumsum(n) - n
            out["n"] += n.tolist()
            out["known"] += np.add.reduceat((count > 0).astype(np.int64), begins).tolist()
            out["base"] += np.add.reduceat(np.log10((count + 0.5) / room), begins).tolist()
            out["score"] += by_gram(as_bytes(words), lambda x: values[np.searchsorted(codes, x)], order).tolist()
        n = len(left)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(out["n"], pa.int64()), "n_known": pa.array(out["known"], pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(out["base"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    told = answers(model, asked, pieces(n_blocks, ASKERS), short, order)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_ppm_score(spark, sf_dir: str) -> DataFrame:
    """The scores, written; the model is deleted once they are."""
    with intermediate(spark) as kept:
        kept.append(cut(score(spark.read.parquet(f"{sf_dir}/documents.parquet")), "scores"))
    return kept[0]
