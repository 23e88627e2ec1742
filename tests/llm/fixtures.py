"""Rows that are awkward in every way the operators promise to handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    base, shared = words(120), words(30)
    near = [*base[:60], "changed", *base[61:]]
    return [
        None, "", " \t\n ", "one", "One TWO\tthree\x0bfour", "a" * 5000, " ".join(base), " ".join(base), " ".join(near),
        "\n".join(" ".join(words(9)) for _ in range(20)), " ".join(words(40) + shared + words(40)), " ".join(shared + words(10)),
        " ".join(["same words again here now then why not"] * 12), "line\nline\n\nline x\n# $ | <>", " ".join(words(30_000)), "x y z w v u t s r q x y z w v u t s",
        "Ünïcode   words stay\x00together \U0001f600", "\r\n\r\n", "<|endoftext|> is text",
        *(" ".join(words(rng.randint(1, 200))) for _ in range(30)),
    ]


def rows(seed: int = 1) -> list[tuple]:
    return [(i * 3, t, "en", [None, "b", "a", "é"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts(seed))]


def table(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def saved(spark, tmp_path, seed: int = 1) -> str:
    table(spark, seed).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def clashing(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("n_words", "size", "shard", "slot", "copies", "pattern", "component_id", "kept", "text_", "value", "spans", "items"):
        df = df.withColumn(name, F.lit("x"))
    return df
