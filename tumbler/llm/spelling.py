"""Groups of spelling variants: every pair of words one edit apart, found with a bidirectional FM-index.

One edit leaves one half of a word as it is. A word of length m is therefore sought twice: its first half is matched
exactly and extended to the right, its second half is matched exactly and extended to the left, either time with one
replaced or inserted letter in the other half. (A deleted letter is an inserted one seen from the other word.) The index
holds the vocabulary between delimiters in both directions; a match is an interval of suffix ranks, and when the far
delimiter is reached, the interval is the word. The place of an edit is unique: a letter that is inserted into a run of the
same letter counts as its last one. So no pair is found twice.

The vocabulary is dealt out by those halves: words that share one, of lengths m and m + 1, meet in one task, which indexes
only what it was dealt. Halves that too many words share are refined: the half with the edit is cut in two, and one part of
it is exact as well, down to single letters, where a group is bounded by the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, drop, few_rows, pieces, shuffles

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Distinct words that a task counts before it passes them on; rows dealt to a task; words that may share a key; keys to be broadcast.
COUNTED, DEALT, SHARED, BROADCAST_KEYS = 300_000, 100_000, 20_000, 1_000_000


class FmIndex:
    """Backward search over distinct words in ascending order, each preceded by the delimiter 0, read in a circle.

    With words and delimiters ordered alike, the suffix order is that of all rotations. order is a sorted array of
    (letter, rank) over the letters before each suffix: looking up (c, i) counts what is smaller and is the step to c.
    """

    def __init__(self, words: list[np.ndarray], letters: int):
        self.words, self.letters = len(words), letters
        sizes = np.fromiter(map(len, words), "i8", len(words))
        heads = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(words)
        text = np.zeros(n, "i8")
        inner = np.ones(n, bool)
        inner[heads] = False
        text[inner] = np.concatenate(words) if words else []
        rank = text + (len(words) - 1)
        rank[heads] = np.arange(len(words))
        ahead = 1
        while True:  # ranks by twice as many letters each time
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -ahead)
            suffixes = np.argsort(key)
            new = np.empty(n, bool)
            new[0] = False
            np.not_equal(key[suffixes[1:]], key[suffixes[:-1]], out=new[1:])
            rank = np.empty(n, "i8")
            rank[suffixes] = np.cumsum(new)
            if rank[suffixes[-1]] == n - 1:
                break
            ahead *= 2
        self.n, self.before = n, text[suffixes - 1]
        self.order = np.sort(self.before * n + np.arange(n))

    def step(self, low: np.ndarray, high: np.ndarray, letter) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the letter followed by what is matched."""
        base = letter * self.n
        return np.searchsorted(self.order, base + low), np.searchsorted(self.order, base + high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for every letter but the delimiter that stands before one of the disjoint intervals' suffixes."""
        width = high - low
        which = np.repeat(np.arange(len(low)), width)
        at = np.arange(len(which)) + np.repeat(low - np.cumsum(width) + width, width)
        pairs = np.unique(which * (self.letters + 1) + self.before[at])
        which, letter = np.divmod(pairs, self.letters + 1)
        return which[letter > 0], letter[letter > 0]


def one_edit(index: FmIndex, queries: np.ndarray, low_end: int, high_end: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) where one letter of the query between the ends is replaced, or one inserted there, to give the word.

    queries is an array of rows of m letters, each a word of the index; what stands outside the ends is exact. With
    `backwards`, queries, words and ends are mirrored, and an insertion's unique place mirrored with them.
    """
    k, m = queries.shape
    low, high = np.zeros(k, "i8"), np.full(k, index.words, "i8")  # the delimiter behind the word
    empty = np.zeros(0, "i8")
    of, at, to = empty, empty, empty  # matches that have their edit: query and interval, with the same letters left

    def join(*parts):
        return (np.concatenate(x) for x in zip(*parts))

    for left in range(m, -1, -1):
        inserts = (low_end < left <= high_end or left == low_end == 0) if backwards else (low_end <= left < high_end or left == high_end == m)
        replaces = low_end <= left - 1 < high_end
        changed = (empty, empty, empty)
        if inserts or replaces:
            starts, first, which = np.unique(low, return_index=True, return_inverse=True)
            interval, letter = index.letters_before(starts, high[first])
            child_low, child_high = index.step(starts[interval], high[first][interval], letter)
            n = np.bincount(interval, minlength=len(starts))
            mine = n[which]
            query = np.repeat(np.arange(k), mine)
            child = np.arange(len(query)) + np.repeat((np.cumsum(n) - n)[which] - np.cumsum(mine) + mine, mine)
            if inserts:
                beside = left - 1 if backwards else left
                keep = letter[child] != queries[query, beside] if 0 <= beside < m else slice(None)
                of, at, to = join((of, at, to), (query[keep], child_low[child[keep]], child_high[child[keep]]))
            if replaces:
                keep = letter[child] != queries[query, left - 1]
                changed = query[keep], child_low[child[keep]], child_high[child[keep]]
        letter = queries[:, left - 1] if left else np.zeros(k, "i8")
        at, to = index.step(at, to, letter[of])
        live = to > at
        of, at, to = join((of[live], at[live], to[live]), changed)
        if left:
            low, high = index.step(low, high, letter)
    return of, at


def near_pairs(words: list[str], queries: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places in the sorted distinct words, in both directions, for queries (word, m, low, high): words that
    equal the query's but for one replaced or inserted letter at low <= place < high (an insertion at the end counts to
    high = m). A query's word has m letters."""
    sizes = np.fromiter(map(len, words), "i8", len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    alphabet, codes = np.unique(points, return_inverse=True)
    codes = codes.astype("i8") + 1
    heads = np.cumsum(sizes) - sizes
    straight = [codes[h : h + n] for h, n in zip(heads.tolist(), sizes.tolist())]
    turned_order = np.array(sorted(range(len(words)), key=lambda i: words[i][::-1]), "i8")
    found_a, found_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    kinds: dict[tuple[int, int, int], list[int]] = {}
    for word, *kind in queries:
        kinds.setdefault(tuple(kind), []).append(word)
    for backwards in (False, True):
        mine = [k for k in kinds if (k[1] >= k[0] - k[2]) == backwards]  # begin with the longer exact side
        if not mine:
            continue
        index = FmIndex([straight[i][::-1] for i in turned_order.tolist()] if backwards else straight, len(alphabet))
        for m, low, high in mine:
            which = np.array(kinds[m, low, high], "i8")
            rows = codes[heads[which][:, None] + (np.arange(m - 1, -1, -1) if backwards else np.arange(m))]
            of, hit = one_edit(index, rows, *((m - high, m - low) if backwards else (low, high)), backwards)
            a, b = which[of], turned_order[hit] if backwards else hit
            longer = sizes[b] > m
            found_a += [a, b[longer]]
            found_b += [b, a[longer]]
    return np.concatenate(found_a), np.concatenate(found_b)


def changed(word: str, seed: int) -> str:
    """The contract's own spelling errors: a word whose checksum 31 divides loses one letter."""
    h = zlib.crc32(word.encode(), seed)
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, errors: bool = False) -> DataFrame:
    """word and n (occurrences) of every maximal run of RUN's letters with `least` or more code points, A-Z lower-cased.

    Null texts have none; whole texts are read, however long; repeated rows count each; extra columns are not read; an empty
    table gives no rows. errors: with the contract's spelling errors (a null id is the empty string there). A task sums up to
    COUNTED distinct words at once, so frequent words are few rows in the shuffle.
    """

    def run(batches):
        find, total = re.compile(RUN).findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                found = Counter(find((text.as_py() or "").translate(LOWER)))
                seed = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for word, n in found.items():
                    if len(word) >= least:
                        if errors:
                            word = changed(word, seed)
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    cols = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return cols.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of what is exact: all words that one search may find share it."""
    return rows.withColumn("key", F.expr("xxhash64(m, low, high, left(word, low), right(word, m - high))"))


def dealt(vocabulary: DataFrame, shared: int = SHARED) -> DataFrame:
    """word, n, m, low, high and key: a word of length L as member of the groups of lengths m = L and m = L - 1, once for each
    half that may hold the edit, or for each part of it where more than `shared` words have the same key."""
    lengths = F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {LEAST_LETTERS})")
    rows = vocabulary.select("word", "n", F.explode(lengths).alias("m"))
    halves = "array(struct(0 AS low, m DIV 2 AS high), struct(m DIV 2 AS low, m AS high))"
    rows = keyed(rows.select("*", F.inline(F.expr(halves))).withColumns({c: F.col(c).cast("int") for c in ("low", "high")}))
    while True:
        hot = cut(rows.where("high - low > 1").groupBy("key").count().where(F.col("count") > shared).select(F.col("key").alias("hot")), "hot-keys")
        if hot.isEmpty():
            drop(hot)
            return rows
        two = "array(struct(low AS a, (low + high) DIV 2 AS b), struct((low + high) DIV 2 AS a, high AS b))"
        parts = F.expr(f"if(hot IS NULL, array(struct(low AS a, high AS b)), {two})")
        rows = rows.join(few_rows(hot, BROADCAST_KEYS), rows["key"] == hot["hot"], "left").select("word", "n", "m", F.inline(parts))
        rows = keyed(rows.select("word", "n", "m", F.col("a").cast("int").alias("low"), F.col("b").cast("int").alias("high")))


def near_words(vocabulary: DataFrame, shared: int = SHARED) -> DataFrame:
    """word, n_near (words of the vocabulary one edit apart), near and near_n (the most frequent of them, the first by code
    point among equals) for words that have any.

    vocabulary has distinct words of at least LEAST_LETTERS code points (not null) and n; write it first, as it is read more than once. Words of
    any length are handled, in work that grows with their letters; extra columns are not read; none give no rows.
    """
    rows = dealt(vocabulary.select("word", "n"), shared)
    tasks = max(shuffles(vocabulary.sparkSession), pieces(4 * vocabulary.count(), DEALT))

    def run(batches):
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        key = got.column("key").to_numpy()
        _, place, n = np.unique(key, return_inverse=True, return_counts=True)
        got = got.filter(pa.array(n[place] > 1))  # a word with a key of its own has no pair there
        if not got.num_rows:
            return
        encoded = got.column("word").combine_chunks().dictionary_encode()
        values = encoded.dictionary.to_pylist()
        order = sorted(range(len(values)), key=values.__getitem__)
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        words, of = [values[i] for i in order], rank[encoded.indices.to_numpy()]
        m, low, high = (got.column(c).to_numpy() for c in ("m", "low", "high"))
        sizes = np.fromiter(map(len, words), "i8", len(words))
        asks = sizes[of] == m
        a, b = near_pairs(words, list(zip(of[asks].tolist(), m[asks].tolist(), low[asks].tolist(), high[asks].tolist())))
        if not len(a):
            return
        counts = np.empty(len(words), "i8")
        counts[of] = got.column("n").to_numpy()
        by = np.lexsort((b, -counts[b], a))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in a[first].tolist()]), pa.array(np.diff(np.r_[first, len(a)])), pa.array([words[i] for i in b[first].tolist()]), pa.array(counts[b[first]])],
            names=["word", "n_near", "near", "near_n"],
        )

    parts = rows.repartition(tasks, "key").mapInArrow(run, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root for rows of word and form: the last one from form to form. Each round doubles the steps, and as a form is
    at least RATIO times as frequent as its word, five rounds are the most. Words are distinct."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        new = cut(roots.join(further, roots["root"] == further["at"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop(roots)
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def group_spellings(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a written vocabulary (word, n). A word's form is its most
    frequent near word if that is at least `ratio` times as frequent; its root is the last of the forms from it on."""
    near = near_words(vocabulary)
    joined = vocabulary.select("word", "n").join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    book = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = rooted(book.where("form IS NOT NULL"))
    return book.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_search_schemes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = word_counts(docs, errors=True).where(F.col("n") >= LEAST_COUNT)
    return group_spellings(cut(counts, "vocabulary"))
