"""Operators 1, 2, 4, 5, 7, 9 and 10 against brute force, round trips and SQL."""

import gzip
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, clashing, rows, saved, table
from tumbler.llm import contamination, quality_rules, token_counts, token_store, warc

SPACE = re.compile("[\\x20\\x09-\\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


def test_word_pieces_match_greedy(spark):
    rng = random.Random(3)
    pieces = list({("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))).encode(), rng.random() < 0.5) for _ in range(12)})
    automaton = token_counts.LongestMatch(pieces)
    have = {tuple(p) + ((token_counts.END,) if e else ()) for p, e in pieces}

    def greedy(word):
        left, n = (*word, token_counts.END), 0
        while left:
            k = next((k for k in range(len(left), 0, -1) if left[:k] in have), 0)
            if not k:
                return 0
            left, n = left[k:], n + 1
        return n

    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))).encode()
        assert automaton.count(word) == greedy(word), word
    out = token_counts.count_pieces(clashing(table(spark)), [(bytes([b]), False) for b in range(256)] + [(bytes([b]), True) for b in range(256)])
    want = [(i, len(split(t)), sum(len(w.encode()) for w in split(t))) for i, t, *_ in rows()]
    assert [r[:3] for r in got(out)] == want
    assert token_counts.count_pieces(table(spark).limit(0), pieces).count() == 0


def test_registered_word_pieces(spark, tmp_path):
    """With the production vocabulary, against greedy matching of the same pieces."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    have = {tuple(p) + ((token_counts.END,) if ends else ()) for p, ends in token_counts.read_pieces(path)}

    def greedy(word):
        left, n = (*word.encode(), token_counts.END), 0
        while left:
            k = next((k for k in range(min(len(left), 80), 0, -1) if left[:k] in have), 0)
            if not k:
                return 1
            left, n = left[k:], n + 1
        return n

    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    want = []
    for i, text, *_ in rows():
        got_ = [greedy(w) for w in split((text or "").translate(lower))]
        want.append((i, len(got_), sum(got_), max(got_, default=0)))
    assert got(token_counts.op1_word_pieces(spark, saved(spark, tmp_path))) == want


def test_quality_rules(spark, tmp_path):
    def repeats(words):
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(wins)
        return len({i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(8)})

    book = quality_rules.apply_policy(quality_rules.ledger(quality_rules.measure(clashing(table(spark)))))
    for r in book.collect():
        text = dict((x[0], x[1]) for x in rows())[r["doc_id"]] or ""
        words = split(text)
        lines = [x for x in text.split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), repeats(words))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 20 or 100 * repeats(words) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    sf = saved(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.sql(quality_rules.sql())
    out = quality_rules.op2_quality_rules(spark, sf).select(want.columns)
    assert got(out) == sorted(want.fetchall())
    # Policies and ablations read the stored ledger, not the texts.
    stored = quality_rules.store(clashing(table(spark)))
    assert all("/ledger-" in f for f in stored.inputFiles()) and "text" not in stored.columns
    for version in quality_rules.POLICIES:
        judged = quality_rules.apply_policy(stored, version).collect()
        sole = Counter(r["sole_rule"] for r in judged)
        only = {r["rule"]: r["n_only"] for r in quality_rules.ablation(stored, version).collect()}
        assert only == {rule: sole[rule] for rule in quality_rules.POLICIES[version]}
    long = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    assert [(r["n_words"], r["n_repeat_words"], r["longest_word"]) for r in quality_rules.measure(long).collect()] == [(100_000, 100_000, 4)]
    masks = [r["fail_mask"] for r in book.collect()]
    for r in quality_rules.ablation(book).collect():
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r["rule"])
        assert (r["n_failed"], r["n_only"]) == (sum(m & bit > 0 for m in masks), sum(m == bit for m in masks))
    assert quality_rules.measure(table(spark).limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big, other = "<p>ü\r\n\r\nx</p>" * 100, "y" * 1000
    pages = [(1, "u1", big), (2, "u2", big), (9, "u3", big), (3, "u4", "small"), (4, "u5", "small"), (5, None, None), (6, "", ""), (7, "a\r\nb", other), (8, "z", other[:-1]), (10, "z", other[:-1]), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id IS NOT NULL")
    out = got(warc.op5_warc_revisits(spark, str(tmp_path)))
    key = lambda r: r[0]
    assert sorted((r for r in out if r[0] is not None), key=key) == sorted(con.sql(warc.sql()).fetchall(), key=key)
    assert out[0][0] is None and out[0][3:] == ("revisit", 9)
    where = f"{tmp_path}/archives"
    warc.write_archives(warc.resolve(df), where)
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(where).collect())
    # Every record is a gzip member of its own, and each can be opened alone.
    offsets = [at for at, one in warc.members(raw) if one]
    found = [next(warc.records(gzip.GzipFile(fileobj=io.BytesIO(raw[at:])).read())) for at in offsets]
    with pytest.raises(ValueError):
        list(warc.members(raw[:-5]))
    assert len(found) == len(pages) and sum(f["warc-type"] == "revisit" for f, _ in found) == 3
    assert sorted(block for f, block in found if f["warc-type"] == "response") == sorted([big.encode(), b"small", b"small", b"", b"", other.encode(), other[:-1].encode(), other[:-1].encode()])
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert got(warc.op5_warc_revisits(spark, str(tmp_path))) == out
    path = f"{tmp_path}/empty"
    warc.write_archives(warc.resolve(clashing(df).limit(0)), path)
    assert warc.read_archives(spark, path).count() == 0


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_shards(spark, tmp_path):
    path, t = tokenizer()
    out, start = got(token_store.op7_token_shards(spark, saved(spark, tmp_path))), 0
    for (i, text, *_), r in zip(sorted(rows()), out, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    where = f"{tmp_path}/shards"
    token_store.write_shards(clashing(table(spark).unionByName(spark.createDataFrame([(None, "null id", "", "", 0)], SCHEMA))), open(path).read(), where, shards=3)
    shards = [token_store.Shard(bytes(r["content"])) for r in spark.read.format("binaryFile").load(where).collect()]
    for i, text, *_ in [*rows(), (None, "null id")]:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x.tolist() for s in shards if (x := s.get(i)) is not None] == [want]
    assert all(s.get(10**9) is None for s in shards)
    token_store.write_shards(table(spark).limit(0), open(path).read(), f"{tmp_path}/none")
    assert token_store.read_shards(spark, f"{tmp_path}/none").count() == 0


def test_registered_decontamination(spark, tmp_path):
    sf = saved(spark, tmp_path)
    items = [(1, rows()[6][1]), (2, "One two"), (None, rows()[10][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(contamination.op10_suffix_automaton(spark, sf)) == sorted(contamination.brute([r[:2] for r in rows()], items))


def test_contamination(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(n)).upper()) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 30])] + [(20, None), (21, " - "), (22, "Zé"), (None, "lonely q1 q2")]
    items += [(100, " ".join(["r"] * 20)), (101, " ".join(["r"] * 5))]
    docs = [(i, ", ".join(words(rng.randint(0, 90)) + (items[rng.randrange(9)][1].split() * rng.randint(0, 2)) + words(rng.randint(0, 20)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "zÉ ZÉ zé"), (73, "lonely q1 q2"), (74, " ".join(["r"] * 40)), (75, " ".join(["r"] * 4)), (74, " ".join(["r"] * 40))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(contamination.brute(docs, items))
    out = contamination.judged(contamination.find(clashing(d), clashing(b)).drop("text")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(out) == want
    contamination.BLOCK_WORDS, was = 20, contamination.BLOCK_WORDS
    try:
        found = contamination.find(d, b)
        assert len(list(contamination._blocks(b, "item_id", "text", 13))) > 3
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one automaton in a worker
        assert got(contamination.judged(found).select(out.columns)) == want
    finally:
        contamination.BLOCK_WORDS = was
    assert got(contamination.judged(contamination.find(d, b.limit(0))).select("n_hit").distinct()) == [(0,)]
    assert contamination.find(d.limit(0), b).count() == 0
    texts = {r["doc_id"]: r["left"] for r in contamination.remove_spans(contamination.find(d, b)).collect()}
    assert texts[74] is None and texts[71] == "" and texts[70] is None
    # Below the coverage limit the window goes and what is around it stays.
    word = [f"x{i}" for i in range(400)]
    mixed = " ".join([*word[:200], *["r"] * 15, *word[200:]])
    kept = {r["doc_id"]: r for r in contamination.remove_spans(contamination.find(spark.createDataFrame([(1, mixed), (2, " ".join(word)), (3, "zé " + " ".join(word)), (4, "z " * 400_000)], "doc_id long, text string"), b)).collect()}
    assert kept[1]["left"].split() == word and kept[1]["n_hit"] == 15 and not kept[1]["contaminated"]
    assert kept[2]["left"] == " ".join(word) and kept[3]["left"].startswith("zé x0") and kept[3]["n_hit"] == 1 and kept[4]["n_words"] == 400_000
    assert contamination.clean_text("a, b! c d.", [(1, 3)]) == "a,  d."
