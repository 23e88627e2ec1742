"""A training-corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents. run() writes each stage's table as Parquet and reads it back for the next, and deletes what the stage wrote on
its way. In all stages nulls are values (a null text counts as empty), texts are processed whole, repeated rows are rows of
their own unless stated, an empty table gives an empty table, and extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm import contamination, jaccard_join, mixing, quality_rules, sharding
from tumbler.llm.common import cut, drop, few_rows, intermediate

#: Ids that a stage drops are broadcast up to so many (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the quality ledger keeps. Null and blank texts have too few words and go."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id. Of repeated rows one stays; documents
    without words are similar to none and all stay."""
    found = cut(jaccard_join.join_components(docs), "components")
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone")).distinct()
    side = few_rows(gone, BROADCAST_IDS)
    left = docs.join(side, docs["doc_id"].eqNullSafe(side["gone"]), "left_anti")
    repeated = found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    return left.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else left


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves. Where one holds less of a benchmark item than the rule allows, spans of
    a whole window are cut out of its text and n_chars counts what is left. Null and blank texts stay as they are."""
    found = contamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[c for c in docs.columns if c != "text"])
    out = contamination.remove_spans(found).where("NOT contaminated")
    new = {"text": F.col("left"), "n_chars": F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0, 1 or 2 rows. Texts without words have no size and are not taken; a null
    source is a source of its own, the last."""
    rows, _, _ = mixing.mix(docs, F.array("source"), keep=docs.columns)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def shards(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row; other columns end here."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(narrow, ["doc_id", "source", "size", "text_crc32"])


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("sharding", shards),
]

#: Components, the mix and the seeded shuffle have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with intermediate(spark) as kept:
            kept.append(cut(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if i:
            drop(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
