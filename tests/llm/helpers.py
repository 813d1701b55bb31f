"""Small fixtures shared by the operator tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# names that the operators use themselves
CLASHES = ["size", "kept", "digest", "region", "keep_id", "rate", "row_id", "sequence_id", "_words", "shard", "copies", "component_id", "n_words", "stratum", "pattern", "word", "word_c"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "One two", "en", "a", 7), (5, "one TWO", "en", "b", 7)]
    rows += [(6, prose(rng, 9000), "en", "b", 0), (7, prose(rng, 60) + "\u00a0\u0085x \x1c y é", "fr", "c", 0)]
    for i in range(10, 60):
        rows.append((i, prose(rng, rng.choice([4, 5, 12, 40, 130])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0))
    long = prose(rng, 120).split()
    for i in range(60, 90):  # near copies of one text
        w = list(long)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(90 + i, rows[-1][1].upper(), "en", "b", 0) for i in range(5)]
    rows += [rows[10], rows[10], (None, "no id here", "en", "a", 1), (None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def data(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
