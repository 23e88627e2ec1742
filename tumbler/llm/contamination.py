"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every benchmark item. Streaming a document's words
through it gives, at each word, the longest run ending there that some item contains. A run of
at least `window` words ends in a full window; shorter items count when matched whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, drop

WINDOW = 13
#: A word: ASCII letters and digits and everything beyond ASCII. A-Z are lower-cased first.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Benchmark words in one automaton (about 150 MB in a worker); larger benchmarks are streamed in several blocks.
BLOCK_WORDS = 200_000


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton of word sequences; size is linear in their words."""

    def __init__(self, items: list[tuple[int | None, list[str]]], window: int = WINDOW):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        codes = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in items if words]
        for _, code in codes:
            last = 0
            for c in code:
                last = self._extend(last, c)
        # Items by the state that holds their windows: at the state's shortest-window ancestor, or whole for short items.
        self.items: dict[int, set] = {}
        self.short: dict[int, int] = {}
        for item, code in codes:
            state, need = 0, min(window, len(code))
            for i, c in enumerate(code):
                state = self.next[state][c]
                if i + 1 >= need:
                    self.items.setdefault(self._owner(state, need), set()).add(item)
            if len(code) < window:
                self.short[self._owner(state, len(code))] = len(code)
        # For each state: its ancestor that holds runs of `window` words, and the short items that end its run.
        n = len(self.next)
        self.full, self.ends = [-1] * n, [()] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.full[v] = v if self.length[up] < window <= self.length[v] else self.full[up]
            self.ends[v] = self.ends[up] + (((self.short[v], v),) if v in self.short else ())

    def _owner(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = len(self.next), last
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Spans [a, b) of words in occurring windows (sorted by b, may overlap), and the states that hold those windows."""
        spans, found = [], set()
        get, nexts, link, length, full, ends, window = self.words.get, self.next, self.link, self.length, self.full, self.ends, self.window
        state = n = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = n = 0
                continue
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(c)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                found.add(full[state])
            for m, v in ends[state]:
                if n >= m:
                    spans.append((i + 1 - m, i + 1))
                    found.add(v)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """Automata over at most BLOCK_WORDS words each (one item more at most); the items arrive one by one."""
    items, n = [], 0
    for item, text in benchmark.select(f"`{item_col}`", f"`{text_col}`").toLocalIterator():
        words = words_in(text)
        items.append((item, words))
        n += len(words)
        if n >= BLOCK_WORDS:
            yield Automaton(items, window)
            items, n = [], 0
    if items:
        yield Automaton(items, window)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges inside occurring windows, merged), items (ids, sorted as strings) and clean.
    clean is the text without its spans of at least `window` words, null if it has none. `keep` names columns to carry
    along in a struct named row.

    Null or blank texts have no words and no spans; repeated rows stay. Items with null or blank
    text match nothing; an item with a null id marks words but is not listed. An item_id on several
    rows is listed once. Empty tables give an empty result or no spans. Extra columns are not read.
    Very long texts are streamed whole; a task holds one of them at a time beside its batch. Larger benchmarks are
    streamed in blocks of BLOCK_WORDS words, one broadcast automaton each and one at a time, with a written table between.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("clean"), F.struct(*[F.col(f"`{c}`") for c in keep or [id_col]]).alias("row"))
    blocks, before = _blocks(benchmark, item_col, item_text, window), None
    shared = spark.sparkContext.broadcast(next(blocks, None) or Automaton([], window))
    out = _streamed(out, shared)
    for automaton in blocks:
        # What one block found is written before the next is streamed, so a worker holds one automaton at any time.
        written = cut(out, "streamed")
        shared.unpersist()
        drop(*[before] * (before is not None))
        before, shared = written, spark.sparkContext.broadcast(automaton)
        out = _streamed(written, shared)
    return out if keep else out.drop("row")


def _streamed(df: DataFrame, shared) -> DataFrame:
    def run(batches):
        automaton = shared.value
        for batch in batches:
            x = {name: batch.column(name) for name in ("doc_id", "text", "spans", "items", "row")}
            n_words, spans, items, clean = [], [], [], []
            for text, old, was in zip(x["text"], x["spans"], x["items"]):
                text = text.as_py()
                words = words_in(text)
                own, states = automaton.match(words)
                if old.is_valid:
                    own += [(s["a"], s["b"]) for s in old.as_py()]
                n_words.append(len(words))
                own = merged(own)
                spans.append([{"a": a, "b": b} for a, b in own])
                long = [(a, b) for a, b in own if b - a >= automaton.window]
                clean.append(clean_text(text, long) if long else None)
                ids = {str(i) for v in states for i in automaton.items[v] if i is not None}
                items.append(sorted(ids | set(was.as_py() or ())))
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["text"], pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(clean, pa.string()), x["row"]], names=["doc_id", "text", "n_words", "spans", "items", "clean", "row"])

    return df.mapInArrow(run, df.schema)


def judged(found: DataFrame, most: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (some hit, and hits at least one in `most` words). A document
    without words or spans has 0 hits, no items (the hash of an empty text) and is not contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(most) * F.col("n_hit") >= F.col("n_words")))


def clean_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the characters from each span's first word to its last."""
    if not text or not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join(out) + text[done:]


def remove_spans(found: DataFrame, most: int = 20) -> DataFrame:
    """Adds left: the text with its long spans cut out, null for texts over the coverage limit (and for null texts)."""
    return judged(found, most).withColumn("left", F.when(~F.col("contaminated"), F.coalesce("clean", "text")))


def op10_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = judged(find(docs, items).drop("text", "clean"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def sql() -> str:
    """DuckDB SQL for op10_suffix_automaton."""
    words = lambda table, key: f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""
    return f"""
    WITH d AS ({words("documents", "doc_id")}), i AS ({words("benchmark", "item_id")}),
    iw AS (SELECT item_id, {WINDOW} AS m, array_to_string(w[j : j + {WINDOW - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS j FROM i WHERE len(w) >= {WINDOW})
        UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND {WINDOW - 1}),
    dw AS (SELECT doc_id, j, m, array_to_string(w[j : j + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
    hit AS (SELECT DISTINCT dw.doc_id, dw.j, dw.m, iw.item_id FROM dw JOIN iw ON iw.m = dw.m AND iw.s = dw.s),
    n AS (SELECT doc_id, count(DISTINCT j + k) AS n_hit FROM hit, range({WINDOW}) r(k) WHERE k < m GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """For tests: the same rows by comparing every window with every place."""
    out = []
    for doc_id, text in docs:
        words, hit, ids = words_in(text), set(), set()
        for item, item_text in items:
            code = words_in(item_text)
            m = min(window, len(code))
            for j in range(len(code) - m + 1) if m else ():
                for i in range(len(words) - m + 1):
                    if words[i : i + m] == code[j : j + m]:
                        hit |= set(range(i, i + m))
                        ids |= {str(item)} if item is not None else set()
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(words)))
    return out
