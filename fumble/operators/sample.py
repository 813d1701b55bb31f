"""Sampling and row selection (B1–B9), job ``sample``.

Sampling is exact and deterministic: every candidate row gets a rank key
``md5(seed, 'sample', round, doc_id)`` and the first ``k`` per stratum are kept
with ``row_number() <= k``. Catalyst plans that as a partial + final
``WindowGroupLimit``: each map task keeps at most ``k`` rows per stratum, so
only ``k × tasks`` rows per stratum cross the shuffle, however skewed the
strata are (one source may hold a third of all documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rand_u
from ..session import cut_lineage


def _top_k(df: DataFrame, k: int, strata: list[str], rank_key, tie: str) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(rank_key, F.col(tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def sample_per_source(
    docs: DataFrame,
    k: int = 20,
    seed: int = 42,
    by: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """B1/B2: ``k`` uniformly random rows from each stratum, no replacement.

    Output keeps the input columns and adds ``round = 0``.
    """
    key = rand_u(seed, "sample", F.lit(0), F.col(id_col))
    return _top_k(docs, k, [by], key, id_col).withColumn("round", F.lit(0))


# A stratum above 1 / HEAVY of all rows has its draws cut before they are
# sorted; there are fewer than HEAVY such strata, whatever the input.
HEAVY = 4096


def narrow_keys(docs: DataFrame, by: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, stratum) of all rows, read once and written; what ``sampled_keys`` draws from."""
    return cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(by).alias("stratum")))


def sampled_keys(narrow: DataFrame, rounds: int, k: int = 20, seed: int = 42, by: str = "source", id_col: str = "doc_id",
                 spare: float = 8.0) -> DataFrame:
    """B3, keys only: ``(id, stratum, round)`` of ``rounds`` samples of ``k`` per stratum of ``narrow_keys``.

    Of the ``n`` draws of a heavy stratum and round only those below about
    ``(k + spare * sqrt(k) + spare) / n`` of the range are written, far fewer
    than are drawn but more than ``k`` except once in a very long while; only
    they are sorted. Where fewer than ``k`` were kept, the stratum and round are
    drawn again from all rows. The result is the same as without the cut.
    Strata that are not heavy are small and need none.
    """
    sizes = narrow.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = narrow.agg(F.count(F.lit(1)).alias("n"))
    heavy = cut_lineage(sizes.filter((F.col("n") * HEAVY > total.scalar()) & F.col("stratum").isNotNull()))
    # at most HEAVY entries, looked up where the rows are read
    size_of = heavy.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "n"))).alias("m")).scalar()
    keys = narrow.withColumn("n", size_of[F.col("stratum")]).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    draw = rand_u(seed, "sample", F.col("round"), F.col("id"))
    limit = F.lit(float(2**32)) * (k + spare * k**0.5 + spare) / F.col("n")
    cut = keys.withColumn("u", draw).filter(F.col("n").isNull() | (F.col("u") < limit))
    w = Window.partitionBy("stratum", "round").orderBy("u", "id")
    top = cut_lineage(cut.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("id", "stratum", "round"))
    # strata and rounds that the cut left with too few: at most HEAVY x rounds narrow rows
    got = top.groupBy("stratum", "round").agg(F.count(F.lit(1)).alias("got"))
    wanted = heavy.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    short = cut_lineage(wanted.join(got, ["stratum", "round"], "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n"))).select("stratum", "round"))
    picked = top
    if not short.isEmpty():
        again = narrow.join(short, "stratum").withColumn("u", draw)
        again = again.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("id", "stratum", "round")
        picked = top.join(short, ["stratum", "round"], "left_anti").select("id", "stratum", "round").unionByName(again)
    return picked.select(F.col("id").alias(id_col), F.col("stratum").alias(by), "round")


def sample_rounds(docs: DataFrame, rounds: int, k: int = 20, seed: int = 42, by: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``rounds`` independent samples of ``k`` per stratum.

    The same row may appear in several rounds (and in another split), as in the
    reference. The table is read twice: for its keys and for the sampled rows. Only narrow keys are multiplied by ``rounds``; the sampled keys
    (``k x strata x rounds`` rows) are joined back to the full rows, and AQE
    broadcasts them where their measured size allows.
    """
    picked = sampled_keys(narrow_keys(docs, by, id_col), rounds, k, seed, by, id_col).select(id_col, "round")
    return docs.join(picked, on=id_col, how="inner")


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order, or all if there are
    fewer (``TakeOrderedAndProject``); ``n = 1`` picks one row."""
    return df.orderBy(*order_by).limit(n)


def shuffled_head(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """B4 + B5: ``n`` rows of a random permutation, planned as one top-k."""
    return (
        df.withColumn("_key", rand_u(seed, "shuffle", F.col(id_col)))
        .orderBy("_key", id_col)
        .limit(n)
        .drop("_key")
    )


def clamped_heads(df: DataFrame, n: int, seed: int = 42, by: str = "source", id_col: str = "doc_id") -> DataFrame:
    """B6 after B4: the first ``min(n, size)`` rows of each stratum's permutation."""
    return _top_k(df, n, [by], rand_u(seed, "shuffle", F.col(id_col)), id_col)


def shuffled(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """A random permutation of all rows; adds ``position``, from 0.

    A range exchange on the draw deals the rows out and each task sorts its
    share, so no task holds the whole table. What is written there carries its
    place within its share; the shares' sizes - a row for each task - give the
    rows before. ``key`` names the rows; rows that repeat it are in no stated order."""
    draw = rand_u(seed, "shuffle", *[F.col(k) for k in key])
    dealt = df.withColumn("_draw", draw).repartitionByRange("_draw", *key).sortWithinPartitions("_draw", *key)
    placed = cut_lineage(dealt.drop("_draw").withColumn("_place", F.monotonically_increasing_id()))
    share, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(share.alias("_share")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_share", before.alias("_before"))
    return placed.withColumn("_share", share).join(F.broadcast(firsts), "_share").withColumn("position", F.col("_before") + place).drop("_share", "_before", "_place")


def disjoint_split(docs: DataFrame, test_share: float, seed: int = 42, text: Column | str = "text") -> DataFrame:
    """Q10 mended: adds ``side``, ``train`` or ``test``, drawn from the digest of
    a row's text, so that all rows with one text are on one side, without a
    shuffle. ``text`` may be any expression, for example a normalised text."""
    text = F.col(text) if isinstance(text, str) else text
    draw = rand_u(seed, "split", F.sha2(F.coalesce(text, F.lit("")), 256))
    return docs.withColumn("side", F.when(draw < F.lit(int(test_share * 2**32)), "test").otherwise("train"))


def leaks(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts of the test part (each counted once), and how many of them the training part has too."""
    digest = lambda df, side: df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), F.lit(side).alias("side"))
    sides = digest(train, 1).unionByName(digest(test, 2)).groupBy("digest").agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") >= 2).alias("test_texts"), F.count_if(F.col("sides") == 3).alias("shared_texts"))


def labelled_union(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Add a constant ``task`` label to each part and concatenate by name."""
    out = None
    for df, task in parts:
        df = df.withColumn("task", F.lit(task))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
