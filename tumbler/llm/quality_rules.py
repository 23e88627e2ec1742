"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger holds the measurements and a
bit for each failed rule, and is written. A policy is a named set of rules, so a new policy version
reads only the stored ledger; ablations are bitwise aggregations over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import SPACE, cut, words_of

WINDOW = 8

#: name -> SQL predicate over the measurements that is true if the rule fails; the bit is the place in this list.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("digits", "4 * n_digits > word_chars"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("longest_word", "longest_word > 200"),
    ("bullets", "10 * n_bullets > 9 * n_lines"),
]

#: version -> names of the rules that reject a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols"],
    "v2": ["few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines"],
    "v3": ["few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "digits", "capitals", "longest_word", "bullets"],
}


def policy_mask(rules: list[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _count(text: str, chars: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _covered(windows: str) -> Column:
    """Words in windows that occur twice or more: sort the windows, keep equal neighbours, add up their spans."""
    return F.expr(f"""
        transform(array(sort_array(transform({windows}, (x, i) -> struct(x AS w, i AS p)))), s ->
          aggregate(
            sort_array(transform(
              filter(s, (x, i) -> (i > 0 AND x.w = s[i - 1].w) OR (i < size(s) - 1 AND x.w = s[i + 1].w)),
              x -> x.p)),
            named_struct('e', -1, 't', 0),
            (a, p) -> named_struct('e', p + {WINDOW}, 't', a.t + p + {WINDOW} - greatest(p, a.e)),
            a -> a.t))[0]""")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the id and the measurements (long).

    Null and blank texts have no words and all measurements 0. Repeated rows and null
    ids stay as they are. Whole texts are measured, however long; a text's windows are held in its row only. An empty table
    gives no rows. Extra columns are not read, whatever their names; `keep` names those to carry along.
    """
    ids = [F.col(f"`{id_col}`")] if not keep else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")]
    names = [id_col] if not keep else ["__row"]
    split = docs.select(*ids, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), words_of(f"`{text_col}`").alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    hashed = split.select(
        *[f"`{c}`" for c in names],
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _count("__text", "0123456789").alias("n_digits"),
        _count("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.coalesce(F.array_max(F.transform("__words", F.length)), F.lit(0)).cast("long").alias("longest_word"),
        lines.alias("__lines"),
        F.expr(f"""CASE WHEN size(__words) > {WINDOW}
            THEN transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW})))
            ELSE cast(array() AS array<bigint>) END""").alias("__hashes"),
    )
    # Distinct hashes prove distinct windows; only texts with equal hashes compare the windows themselves.
    exact = f"transform(sequence(1, size(__words) - {WINDOW - 1}), i -> array_join(slice(__words, i, {WINDOW}), ' '))"
    return hashed.select(
        *[f"`{c}`" for c in names],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_digits",
        "n_capitals",
        "longest_word",
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__lines", lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* "))).cast("long").alias("n_bullets"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__hashes")) == F.size("__hashes"), F.lit(0)).otherwise(_covered(exact)).cast("long").alias("n_repeat_words"),
    )


def ledger(measured: DataFrame) -> DataFrame:
    """Adds fail_mask (long): bit i is set if rule i of RULES fails. Measurements are never null, so neither is a rule."""
    mask = " | ".join(f"(CASE WHEN {rule} THEN {1 << i}L ELSE 0L END)" for i, (_, rule) in enumerate(RULES))
    return measured.withColumn("fail_mask", F.expr(mask))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of docs, written to the shared folder: every policy and ablation reads this table instead of the texts."""
    return cut(ledger(measure(docs, id_col, text_col)), "ledger")


def apply_policy(book: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed, policy, kept and sole_rule (the rule that alone rejects the document, null if none or several
    do). The base rules reject under every policy."""
    base, mask = policy_mask(POLICIES["base"]), policy_mask(POLICIES[version]) | policy_mask(POLICIES["base"])
    failed = lambda m: F.col("fail_mask").bitwiseAND(F.lit(m).cast("long")) != 0
    hit = F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long"))
    sole = F.coalesce(*[F.when(hit == 1 << i, F.lit(name)) for i, (name, _) in enumerate(RULES)])
    return book.withColumns({"base_failed": failed(base), "policy": F.lit(version), "kept": ~failed(mask), "sole_rule": sole})


def kept_rows(docs: DataFrame, version: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns.

    The partition number in the condition keeps the optimizer from moving the condition below the measurements, where
    it would work them out again inside each lambda.
    """
    measured = measure(docs, id_col, text_col, keep=docs.columns).withColumn("__part", F.spark_partition_id())
    return apply_policy(ledger(measured), version).where(F.col("kept") & (F.col("__part") >= 0)).select("__row.*")


def ablation(book: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents failing it, and those that only it rejects.

    The ledger is first counted by mask, so at most 2 ** len(RULES) rows are shuffled.
    An empty ledger gives a row of zeros for each rule.
    """
    mask = policy_mask(POLICIES[version])
    masked = F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long"))
    by_mask = book.groupBy(masked.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in POLICIES[version]]
    sums = [F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("n"))), F.lit(0)).alias(f"f{bit}") for _, bit in rules]
    sums += [F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias(f"s{bit}") for _, bit in rules]
    stack = ", ".join(f"'{name}', f{bit}, s{bit}" for name, bit in rules)
    return by_mask.agg(*sums).select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, n_failed, n_only)"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = apply_policy(store(docs))
    v1 = F.col("fail_mask").bitwiseAND(F.lit(policy_mask(POLICIES["v1"])).cast("long")) == 0
    v3 = F.col("fail_mask").bitwiseAND(F.lit(policy_mask(POLICIES["v3"])).cast("long")) == 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_digits", "n_capitals", "longest_word", "n_bullets", "fail_mask", "sole_rule", v1.alias("kept_v1"), v3.alias("kept_v3"))


def sql() -> str:
    """DuckDB SQL for op2_quality_rules."""
    mask = " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES))
    fails = lambda v: " OR ".join(f"({rule})" for name, rule in RULES if name in POLICIES[v])
    count = lambda v: " + ".join(f"({rule})::INT" for name, rule in RULES if name in POLICIES[v])
    sole = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in RULES if name in POLICIES["v2"])
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM l WHERE len(w) > 7)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
    m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (length(t) - length(translate(t, '0123456789', '')))::BIGINT AS n_digits,
                 (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
                 coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word,
                 len(list_filter(ls, lambda x: starts_with(ltrim(x), '- ') OR starts_with(ltrim(x), '* ')))::BIGINT AS n_bullets,
                 len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN rep ON l.doc_id = rep.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT ({fails("v2")}) AS kept, n_lines, n_digits, n_capitals, longest_word, n_bullets, ({mask})::BIGINT AS fail_mask,
           CASE WHEN {count("v2")} = 1 THEN CASE {sole} END END AS sole_rule,
           NOT ({fails("v1")}) AS kept_v1, NOT ({fails("v3")}) AS kept_v3 FROM m"""
