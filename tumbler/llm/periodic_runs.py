"""Periodic runs of words by block convolution.

A run has a smallest period q and at least max(6, 4 q) words. At scale D (1, 2, 4, ...) it has a period of D <= q < 2 D
and contains a whole block that begins at a multiple of 2 D and recurs q words later. Blocks and the windows that follow
them are transformed; the sum of squared differences between a block and each place of its window is

    sum of x^2 + sum of y^2 - 2 (x correlated with y)

over whole numbers modulo a prime. Every equal place gives zero, so none is missed; zeros seed an extension word by word,
which confirms them. A period that divides the distance of a seed inside a known run is that run again.

Transforms are number-theoretic ones of at most 4096 points, written as products with 64-point matrices. Entries are
residues around zero, so each sum of 64 products stays below 2^50 and is exact in doubles. Blocks beyond 2048 words
are represented by their first 2048, which are sought over the whole range of distances, piece by piece.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import words_of
from tumbler.llm.token_counts import SPLIT_AT

#: 7 * 2^20 + 1; 3 generates its residues.
PRIME, ROOT = 7340033, 3
RADIX, LONGEST_BLOCK = 64, 2048
SHORTEST, REPEATS = 6, 4
#: Words worked on together, and numbers in a slab of blocks.
CHUNK_WORDS, SLAB = 1 << 17, 1 << 17


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, between -PRIME / 2 and PRIME / 2, in place."""
    x -= np.rint(x * (1 / PRIME)) * PRIME
    return x


@cache
def powers(n: int, inverse: bool, rows: int, cols: int) -> np.ndarray:
    """w^(r c) for an n-th root of unity w (or its inverse)."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    table = [1]
    for _ in range(n - 1):
        table.append(table[-1] * (pow(w, -1, PRIME) if inverse else w) % PRIME)
    return reduced(np.array(table, "f8")[np.outer(np.arange(rows), np.arange(cols)) % n])


def forward(x: np.ndarray, n: int) -> np.ndarray:
    """Transforms of the rows, filled up with zeros to n points. x is (groups, rows, points)."""
    if n <= RADIX:
        return reduced(x @ powers(n, False, n, n)[: x.shape[2]])
    rest = n // RADIX
    out = np.zeros((x.shape[0] * x.shape[1], n))
    out[:, : x.shape[2]] = x.reshape(len(out), -1)
    out = reduced(powers(RADIX, False, RADIX, RADIX) @ out.reshape(-1, RADIX, rest))
    out *= powers(n, False, RADIX, rest)
    return reduced(reduced(out) @ powers(rest, False, rest, rest))


def backward(x: np.ndarray, n: int) -> np.ndarray:
    """n times the inverse of forward(), in the form (groups * rows, n)."""
    if n <= RADIX:
        return reduced(x @ powers(n, True, n, n)).reshape(-1, n)
    rest = n // RADIX
    out = reduced(x @ powers(rest, True, rest, rest))
    out *= powers(n, True, RADIX, rest)
    return reduced(powers(RADIX, True, RADIX, RADIX) @ reduced(out)).reshape(-1, n)


def zeros(words: np.ndarray, at: np.ndarray, ahead: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, t), 0 <= t < size, where words[at : at + size] may equal words[ahead + t : ahead + t + size]: no equal
    place is missing, another one is there by a chance of one in PRIME. words reaches 2 size beyond the last `ahead`."""
    n = 2 * size
    each = max(RADIX, SLAB // n // RADIX * RADIX)
    rows, places = [], []
    for k in range(0, len(at), each):
        a, b = at[k : k + each], ahead[k : k + each]
        real = len(a)
        fill = -real % RADIX
        a, b = (np.concatenate([z, np.repeat(z[-1:], fill)]) for z in (a, b))
        x = words[a[:, None] + np.arange(size - 1, -1, -1)].astype("f8")  # the block backwards
        y = words[b[:, None] + np.arange(n)].astype("f8")
        reduced(x), reduced(y)
        shape = (len(a) // RADIX, RADIX, -1)
        product = forward(x.reshape(shape), n)
        product *= forward(y.reshape(shape), n)
        mixed = backward(reduced(product), n)[:, size - 1 :]
        squares = np.zeros((len(a), n + 1))
        np.cumsum(reduced(y * y), axis=1, out=squares[:, 1:])
        total = reduced(x * x).sum(1)[:, None] + squares[:, size:n] - squares[:, :size]
        # mixed is n times the correlation
        total = reduced(reduced(total) * n - 2 * mixed[:, :size])
        r, t = np.nonzero(total[:real] == 0)
        rows.append(r + k)
        places.append(t)
    return np.concatenate(rows), np.concatenate(places)


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words at the beginning of both arrays, which are compared in growing steps."""
    done, step, most = 0, 32, min(len(a), len(b))
    while done < most:
        other = np.flatnonzero(a[done : min(done + step, most)] != b[done : min(done + step, most)])
        if len(other):
            return done + int(other[0])
        done, step = min(done + step, most), 2 * step
    return most


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs, by document, start and period. words are whole numbers,
    document k holds words[bounds[k] : bounds[k + 1]]."""
    found: list[tuple[int, int, int]] = []  # start, end, period
    sizes = np.diff(bounds)
    wide = np.concatenate([words, np.zeros(2 * LONGEST_BLOCK + 2, words.dtype)])
    scale = 1
    while True:
        # A run of period q >= scale has max(6, 4 q) words, and a block starts in its first 2 * scale ones.
        docs = np.flatnonzero(sizes >= max(SHORTEST, REPEATS * scale))
        if not len(docs):
            break
        size = min(scale, LONGEST_BLOCK)
        n = np.maximum(0, (sizes[docs] - size - scale) // (2 * scale) + 1)
        doc = np.repeat(docs, n)
        at = bounds[doc] + 2 * scale * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        seeds = []
        for ahead in range(scale, 2 * scale, size):
            inside = at + ahead + size <= bounds[doc + 1]
            rows, t = zeros(wide, at[inside], at[inside] + ahead, size) if inside.any() else (np.zeros(0, "i8"),) * 2
            of = np.flatnonzero(inside)[rows]
            seeds.append(np.stack([doc[of], ahead + t, at[of]]))
        doc, d, at = np.concatenate(seeds, axis=1)
        keep = at + d + size <= bounds[doc + 1]
        if found:
            # By the periodicity lemma one run at most covers a seed, and it is the one that ends last of those that start before.
            found.sort()
            start, end, period = np.array(found).T
            last = np.maximum.accumulate(end)
            which = np.searchsorted(start, at, "right") - 1
            covering = np.searchsorted(last, last[which])  # the first run with that end
            covered = (which >= 0) & (last[which] >= at + d + size) & (d % period[covering] == 0)
            keep &= ~covered
        doc, d, at = doc[keep], d[keep], at[keep]
        order = np.lexsort((at, d, doc))
        before, until = (-1, -1), -1
        for k, q, i in zip(doc[order].tolist(), d[order].tolist(), at[order].tolist()):
            if (k, q) == before and i + size + q <= until:
                continue
            low, high = int(bounds[k]), int(bounds[k + 1])
            ahead = equal_ahead(words[i : high - q], words[i + q : high])
            if ahead < size:
                continue
            back = equal_ahead(words[low:i][::-1], words[low + q : i + q][::-1])
            before, until = (k, q), i + ahead + q
            if until - (i - back) >= max(SHORTEST, REPEATS * q):
                found.append((i - back, until, q))
        scale *= 2
    best: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        best[start, end] = min(q, best.get((start, end), q))
    found = sorted((start, end, q) for (start, end), q in best.items())
    of = np.searchsorted(bounds, [s for s, _, _ in found], "right") - 1
    return [(int(k), s - int(bounds[k]), e - s, q) for k, (s, e, q) in zip(of, found)]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (of its own type), n_words, runs (start, length, period in words, by start and period) and collapsed (the
    text's words joined by one space, without those that a run holds after its first period).

    Words are runs without ASCII white space, compared as they are. A null or blank text has no words, no runs and an empty
    collapsed text. Null ids, repeated rows and ids stay rows of their own; extra columns are not read, whatever their
    names; an empty table gives no rows. Texts are processed whole: one takes a few hundred bytes a word in its task,
    and work in proportion to its words times the number of scales. No shuffle.
    """
    cols = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def result(ids, texts):
        known: dict[str, int] = {}
        words = [[w for w in t.translate(SPLIT_AT).split(" ") if w] for t in texts]
        numbers = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], "i8")
        bounds = np.cumsum([0, *map(len, words)])
        runs: list[list[dict]] = [[] for _ in texts]
        for k, start, length, period in runs_of(numbers, bounds):
            runs[k].append({"start": start, "length": length, "period": period})
        collapsed = []
        for ws, rs in zip(words, runs):
            keep = np.ones(len(ws), bool)
            for r in rs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            collapsed.append(" ".join(w for w, k in zip(ws, keep.tolist()) if k) if rs else " ".join(ws))
        cols_ = [pa.array(list(map(len, words)), pa.int64()), pa.array(runs, RUNS_ARROW), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *cols_], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, texts, n = [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                n += len(texts[-1]) // 6 + 1
                if n >= CHUNK_WORDS:
                    yield result([*ids, batch.column(0).slice(first, i + 1 - first)], texts)
                    ids, texts, n, first = [], [], 0, i + 1
            if first < len(batch):
                ids.append(batch.column(0).slice(first))
        if texts:
            yield result(ids, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> Column:
    """The text, or for one document in ten its words with a periodic tail: the contract's own change of the input."""
    words, h = words_of("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.col("text"))


def op11_block_convolution(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs.select("doc_id", with_tails(docs).alias("text")))
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    found = found.withColumn("best", F.array_max(key))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
